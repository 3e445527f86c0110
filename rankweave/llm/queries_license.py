"""op8: license scans."""

from __future__ import annotations

from rankweave.catalog.base import table
from rankweave.llm import license_scan
from rankweave.llm.base import LOWER, UPPER, query


def _sql_canonical(col: str) -> str:
    """The canonical form in the words of another engine."""
    lower = f"translate(coalesce({col}, ''), '{UPPER}', '{LOWER}')"
    out = f"concat(' ', regexp_replace(regexp_replace({lower}, '{license_scan.COPYRIGHT_LINE}', '', 'g'), '{license_scan.NO_WORD}', '  ', 'g'), ' ')"
    for variant, form in license_scan.SPELLINGS.items():
        if variant != form:
            out = f"replace({out}, ' {variant} ', ' {form} ')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


def _sql_forms(name: str, source: str, key: str) -> str:
    """``name``_lines (key, i, form) and ``name`` (key, form): holder lines (in the head or below a copyright line) are empty, the others as they are."""
    lower = f"translate(line, '{UPPER}', '{LOWER}')"
    return f"""
{name}_split AS (SELECT {key}, i, string_split(body, chr(10))[i] AS line FROM (SELECT {key}, body, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS i FROM {source})),
{name}_form AS (SELECT {key}, i, {_sql_canonical('line')} AS form, regexp_matches({lower}, '{license_scan.HOLDER_LINE}') AND contains({_sql_canonical('line')}, 'copyright') AS holder,
  coalesce(lag(regexp_matches({lower}, '{license_scan.COPYRIGHT_LINE}')) OVER (PARTITION BY {key} ORDER BY i), false) AS below FROM {name}_split),
{name}_head AS (SELECT {key}, min(i) FILTER (NOT holder AND len(string_split(form, ' ')) > {license_scan.TITLE_WORDS}) AS body_at FROM {name}_form GROUP BY 1),
{name}_lines AS (SELECT f.{key}, i, CASE WHEN holder AND (below OR body_at IS NULL OR i < body_at) THEN '' ELSE form END AS form FROM {name}_form f JOIN {name}_head h ON h.{key} = f.{key}),
{name} AS (SELECT {key}, coalesce(string_agg(form, ' ' ORDER BY i) FILTER (form <> ''), '') AS form FROM {name}_lines GROUP BY 1)"""


_KNOWN = ", ".join("({}, '{}', '{}')".format(i, name, body.replace("'", "''")) for i, (name, _, body) in enumerate(license_scan.KNOWN))
LICENSE_SQL = f"""
WITH bodies AS (SELECT * FROM (VALUES {_KNOWN}) AS t(n, license, body)), texts AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
{_sql_forms('kf', 'bodies', 'n')}, {_sql_forms('forms', 'texts', 'doc_id')},
known AS (SELECT form, min(license) AS license FROM kf JOIN bodies USING (n) GROUP BY 1),
notices AS (
  SELECT doc_id, count(DISTINCT i) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS names
  FROM forms_lines l JOIN known k ON k.form = l.form GROUP BY doc_id)
SELECT f.doc_id, sha256(f.form) AS digest, k.license, coalesce(n.n, 0) AS n_license_lines, coalesce(n.names, '') AS line_licenses
FROM forms f LEFT JOIN known k ON k.form = f.form LEFT JOIN notices n ON n.doc_id = f.doc_id
"""


@query("op8_license_scan", LICENSE_SQL)
def op8(spark, sf_dir):
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"), license_scan.known_digests(spark))
    return found.withColumnRenamed("id", "doc_id")
