"""Entity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankweave.catalog.base import q6, query, r6, sql_hash, table
from rankweave.functions.sampling import bucket
from rankweave.operators import entities as en


@query("E1_gazetteer_clean", "SELECT DISTINCT lower(trim(p_name)) AS value FROM part WHERE length(p_name) > 4 UNION SELECT DISTINCT lower(n_name) FROM nation")
def gazetteer(spark, sf):
    return en.gazetteer_clean(table(spark, sf, "part"), "p_name").union(en.gazetteer_clean(table(spark, sf, "nation"), "n_name")).distinct()


def examples(spark, sf):
    """One sentence per part: its name as merchant, a hash-chosen nation as location."""
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("n"), F.col("n_name").alias("location"))
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("merchant")).withColumn("n", bucket(11, 25, "id"))
    return en.template_expand(parts.join(nation, "n"))


_T = "[" + ", ".join(f"'{t}'" for t in en.TEMPLATES) + "]"
SQL_EX = f"""
x AS (SELECT p_partkey AS id, lower(p_name) AS m, lower(n_name) AS l, string_split({_T}[CAST({sql_hash(7, 'p_partkey')} % 12 + 1 AS INTEGER)], '{{}}') AS p FROM part JOIN nation ON n_nationkey = {sql_hash(11, 'p_partkey')} % 25),
ex AS (SELECT id, CASE WHEN len(p) = 3 THEN p[1] || m || p[2] || l || p[3] ELSE p[1] || m || p[2] END AS text, length(p[1]) AS s1, length(p[1]) + length(m) AS e1,
 CASE WHEN len(p) = 3 THEN length(p[1]) + length(m) + length(p[2]) END AS s2, CASE WHEN len(p) = 3 THEN length(p[1]) + length(m) + length(p[2]) + length(l) END AS e2 FROM x),
truth AS (SELECT id, s1 AS start, e1 AS "end", 'MERCHANT' AS label FROM ex UNION ALL SELECT id, s2, e2, 'LOCATION' FROM ex WHERE s2 IS NOT NULL)"""


def _spans(col):
    return F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"), s["label"])), ",")


@query("E2_template_expand", f"WITH {SQL_EX} SELECT id, text, s1 || ':' || e1 || ':MERCHANT' || CASE WHEN s2 IS NULL THEN '' ELSE ',' || s2 || ':' || e2 || ':LOCATION' END AS spans FROM ex")
def expand(spark, sf):
    return examples(spark, sf).select("id", "text", _spans("entities").alias("spans"))


SQL_BIO = f"""{SQL_EX}, w AS (SELECT id, unnest(string_split(text, ' ')) AS tok, generate_subscripts(string_split(text, ' '), 1) AS i FROM ex),
o AS (SELECT *, coalesce(sum(length(tok) + 1) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM w),
b AS (SELECT o.id, o.i, o.tok, coalesce(max(CASE WHEN o.st = t.start THEN 'B-' ELSE 'I-' END || t.label), 'O') AS tag FROM o LEFT JOIN truth t ON t.id = o.id AND o.st >= t.start AND o.st + length(o.tok) <= t."end" GROUP BY 1, 2, 3)"""


@query("E3_spans_to_bio", f"WITH {SQL_BIO} SELECT id, string_agg(tok, ' ' ORDER BY i) AS tokens, string_agg(tag, ' ' ORDER BY i) AS tags FROM b GROUP BY 1")
def bio(spark, sf):
    return en.spans_to_bio(examples(spark, sf)).select("id", F.array_join("tokens", " ").alias("tokens"), F.array_join("ner_tags", " ").alias("tags"))


@query("E4_bio_label_ids", f"WITH {SQL_BIO} SELECT tag AS label, CAST(row_number() OVER (ORDER BY tag <> 'O', tag) - 1 AS INTEGER) AS id FROM (SELECT DISTINCT tag FROM b)")
def bio_ids(spark, sf):
    return en.bio_label_ids(en.spans_to_bio(examples(spark, sf)))


def predictions(spark, sf):
    """Gold spans, with some dropped and some shifted by hash."""
    draw = bucket(23, 10, "id")
    return examples(spark, sf).withColumn("entities", F.transform(
        F.filter("entities", lambda s: (draw != 0) | (s["label"] == "MERCHANT")),
        lambda s: F.struct((s["start"] + F.when((draw == 1) & (s["label"] == "MERCHANT"), 1).otherwise(0)).alias("start"), s["end"].alias("end"), s["label"].alias("label"))))


SQL_PRED = f"""{SQL_EX}, pred AS (SELECT id, start + CASE WHEN {sql_hash(23, 'id')} % 10 = 1 AND label = 'MERCHANT' THEN 1 ELSE 0 END AS start, "end", label FROM truth WHERE {sql_hash(23, 'id')} % 10 <> 0 OR label = 'MERCHANT')"""


def flat(df):
    return df.select("id", F.explode("entities").alias("s")).select("id", "s.start", "s.end", "s.label")


@query("E5_entity_metrics", f"""WITH {SQL_PRED}, m AS (SELECT coalesce(p.label, t.label) AS label, p.id IS NOT NULL AS hp, t.id IS NOT NULL AS ht FROM pred p FULL JOIN truth t ON p.id = t.id AND p.start = t.start AND p."end" = t."end" AND p.label = t.label),
c AS (SELECT coalesce(label, 'overall') AS label, count(*) FILTER (hp AND ht) AS tp, count(*) FILTER (hp AND NOT ht) AS fp, count(*) FILTER (ht AND NOT hp) AS fn, count(*) FILTER (hp) AS np, count(*) FILTER (ht) AS nt FROM m GROUP BY ROLLUP(label))
SELECT label, tp AS true_positives, fp AS false_positives, fn AS false_negatives, np AS total_predictions, nt AS total_ground_truth, {q6('tp / (tp + fp)')} AS precision, {q6('tp / (tp + fn)')} AS recall, {q6('2.0 * tp / (2 * tp + fp + fn)')} AS f1_score FROM c""")
def metrics(spark, sf):
    out = en.entity_metrics(flat(predictions(spark, sf)), flat(examples(spark, sf)))
    return out.withColumns({c: r6(c) for c in ("precision", "recall", "f1_score")})


@query("E6_entity_errors", f"""WITH {SQL_PRED}, e AS (SELECT id FROM (SELECT * FROM pred EXCEPT SELECT * FROM truth) UNION SELECT id FROM (SELECT * FROM truth EXCEPT SELECT * FROM pred)),
fp AS (SELECT id, string_agg(start || ':' || "end" || ':' || label, ',') AS s FROM (SELECT * FROM pred EXCEPT SELECT * FROM truth) GROUP BY 1), fn AS (SELECT id, string_agg(start || ':' || "end" || ':' || label, ',') AS s FROM (SELECT * FROM truth EXCEPT SELECT * FROM pred) GROUP BY 1)
SELECT e.id, text, coalesce(fp.s, '') AS false_positives, coalesce(fn.s, '') AS false_negatives FROM e JOIN ex USING (id) LEFT JOIN fp USING (id) LEFT JOIN fn USING (id)""")
def errors(spark, sf):
    out = en.entity_errors(predictions(spark, sf), examples(spark, sf), None)
    return out.select("id", "text", _spans("false_positives").alias("false_positives"), _spans("false_negatives").alias("false_negatives"))


@query("E7_bio_metrics", f"""WITH {SQL_BIO}, g AS (SELECT *, {sql_hash(31, 'id', 'i')} % 20 AS d FROM b),
k AS (SELECT id, i, tag AS t, CASE WHEN d = 0 THEN 'O' WHEN d = 1 THEN 'I-LOCATION' ELSE tag END AS p, row_number() OVER (PARTITION BY id ORDER BY i) AS n FROM g WHERE d <> 2),
ts AS (SELECT id, n, t AS tag, lag(t) OVER (PARTITION BY id ORDER BY n) AS prev FROM k), ps AS (SELECT id, n, p AS tag, lag(p) OVER (PARTITION BY id ORDER BY n) AS prev FROM k),
tg AS (SELECT *, sum(CASE WHEN tag LIKE 'I-%' AND prev IS NOT NULL AND substr(prev, 3) = substr(tag, 3) AND prev <> 'O' THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY n) AS grp FROM ts),
pg AS (SELECT *, sum(CASE WHEN tag LIKE 'I-%' AND prev IS NOT NULL AND substr(prev, 3) = substr(tag, 3) AND prev <> 'O' THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY n) AS grp FROM ps),
tsp AS (SELECT id, min(n) AS a, max(n) AS z, any_value(substr(tag, 3)) AS l FROM tg WHERE tag <> 'O' GROUP BY id, grp), psp AS (SELECT id, min(n) AS a, max(n) AS z, any_value(substr(tag, 3)) AS l FROM pg WHERE tag <> 'O' GROUP BY id, grp),
c AS (SELECT (SELECT count(*) FROM (SELECT * FROM tsp INTERSECT SELECT * FROM psp)) AS tp, (SELECT count(*) FROM psp) AS np, (SELECT count(*) FROM tsp) AS nt)
SELECT tp AS true_positives, np - tp AS false_positives, nt - tp AS false_negatives, (SELECT {q6('avg(CASE WHEN t = p THEN 1.0 ELSE 0 END)')} FROM k) AS accuracy, {q6('tp / np')} AS precision, {q6('tp / nt')} AS recall, {q6('2.0 * tp / (np + nt)')} AS f1_score FROM c""")
def bio_scores(spark, sf):
    tagged = en.spans_to_bio(examples(spark, sf))
    draw = lambda i: F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("31"), F.col("id").cast("string"), (i + 1).cast("string"))), 1, 15), 16, 10).cast("long"), F.lit(20))
    noisy = F.transform("ner_tags", lambda t, i: F.when(draw(i) == 0, "O").when(draw(i) == 1, "I-LOCATION").otherwise(t))
    gold = F.transform("ner_tags", lambda t, i: F.when(draw(i) == 2, en.IGNORED).otherwise(t))
    out = en.bio_metrics(tagged.select(noisy.alias("predicted"), gold.alias("truth")))
    return out.withColumns({c: r6(c) for c in ("accuracy", "precision", "recall", "f1_score")})


def part_gazetteer(spark, sf):
    names = en.gazetteer_clean(table(spark, sf, "part"), "p_name").withColumn("label", F.lit("MERCHANT"))
    return names.union(en.gazetteer_clean(table(spark, sf, "nation"), "n_name").withColumn("label", F.lit("LOCATION")))


@query("E8_extract_entities", f"""WITH {SQL_EX}, g AS (SELECT DISTINCT lower(trim(p_name)) AS value, 'MERCHANT' AS label FROM part WHERE length(p_name) > 4 UNION SELECT DISTINCT lower(n_name), 'LOCATION' FROM nation WHERE length(n_name) > 4),
h AS (SELECT id, label, value, instr(' ' || text || ' ', ' ' || value || ' ') AS pos FROM ex, g WHERE contains(' ' || replace(text, '_', ' _') || ' ', ' ' || replace(value, '_', ' _') || ' '))
SELECT id, label, 0 AS part, string_agg(value, '|' ORDER BY pos, value) AS "values" FROM h GROUP BY 1, 2""")
def extract(spark, sf):
    found = en.extract_entities(examples(spark, sf).select("id", "text"), part_gazetteer(spark, sf))
    return found.select("id", "label", "part", F.array_join("values", "|").alias("values"))


SQL_NAMED = f"""{SQL_EX}, q AS (SELECT id AS query_id, text FROM ex),
g AS (SELECT DISTINCT lower(trim(p_name)) AS value, 'MERCHANT' AS label FROM part WHERE length(p_name) > 4 UNION SELECT DISTINCT lower(n_name), 'LOCATION' FROM nation WHERE length(n_name) > 4),
h AS MATERIALIZED (SELECT DISTINCT query_id, label, value FROM q, g WHERE contains(' ' || text || ' ', ' ' || value || ' ')),
es AS MATERIALIZED (SELECT query_id, string_agg(label || '=' || value, '; ' ORDER BY label, value) AS entities FROM h GROUP BY 1)"""


def named(spark, sf):
    asked = examples(spark, sf).select(F.col("id").alias("query_id"), "text")
    return en.entity_sets(en.understand_queries(asked, part_gazetteer(spark, sf)))


def _entity_text():
    return F.array_join(F.transform("entities", lambda e: F.concat_ws("=", e["label"], e["value"])), "; ").alias("entities")


@query("V17_query_entities", f"WITH {SQL_NAMED} SELECT query_id, entities FROM es")
def query_entities(spark, sf):
    return named(spark, sf).select("query_id", _entity_text())


@query("V17_query_understanding", f"""WITH {SQL_NAMED},
iv AS (SELECT p_partkey AS item_id, 'MERCHANT' AS label, lower(p_name) AS value FROM part UNION ALL SELECT p_partkey, 'LOCATION', lower(n_name) FROM part JOIN nation ON n_nationkey = {sql_hash(13, 'p_partkey')} % 25),
one AS (SELECT entities, min(query_id) AS query_id FROM es GROUP BY 1),
w AS (SELECT entities, label, value, count(DISTINCT label) OVER (PARTITION BY entities) AS n FROM one JOIN h USING (query_id))
SELECT entities, item_id FROM w JOIN iv USING (label, value) GROUP BY 1, 2 HAVING count(DISTINCT label) = any_value(n)""")
def understanding(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("n"), F.lower("n_name").alias("place"))
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.lower("p_name").alias("name")).withColumn("n", bucket(13, 25, "item_id")).join(nation, "n")
    values = parts.select("item_id", F.explode(F.array(
        F.struct(F.lit("MERCHANT").alias("label"), F.col("name").alias("value")), F.struct(F.lit("LOCATION").alias("label"), F.col("place").alias("value")))).alias("v"))
    return en.matching_items(named(spark, sf), values.select("item_id", "v.label", "v.value")).select(_entity_text(), "item_id")
