"""Registry and the views that several queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is already registered")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    naive = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a table of few files one partition per core before CPU-heavy row work.

    A table that already has as many splits as the cluster has cores is left alone, so large inputs
    are never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def r6(value: Column | str, places: int = 6) -> Column:
    col = F.col(value) if isinstance(value, str) else value
    return F.round(col.cast("double"), places)


def q6(expr: str, places: int = 6) -> str:
    """The SQL side of ``r6``; adding zero turns -0 into 0."""
    return f"(round(CAST({expr} AS DOUBLE), {places}) + CAST(0 AS DOUBLE))"


def sql_hash(seed: object, *cols: str) -> str:
    """The SQL side of ``md5_long``."""
    return f"CAST('0x' || substr({sql_md5(seed, *cols)}, 1, 15) AS BIGINT)"


def sql_md5(seed: object, *cols: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(f'CAST({c} AS VARCHAR)' for c in cols)}))"


# ---- session log built from events: one log line per event, so no line ever grows ----

CANDIDATES_PER_LINE = 6


def session_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested log lines: clicks, impressions and a short candidate list per event."""
    events = spread(table(spark, sf_dir, "events"), "event_id").select(
        "event_id",
        "ts",
        "event_type",
        "value",
        F.col("user_id").cast("string").alias("user_id"),
        F.concat_ws("_", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("session_id"),
        F.concat(F.lit("q"), F.pmod("user_id", F.lit(7)).cast("string")).alias("query"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        (F.col("event_id") % 10 + 1).alias("position"),
    )
    item = F.array(F.create_map(
        F.lit("nav_link"), F.concat(F.lit("k"), F.col("k").cast("string")),
        F.lit("position"), F.col("position").cast("string"),
        F.lit("timestamp"), F.unix_millis("ts").cast("string"),
        F.lit("dwell"), F.col("value").cast("string"),
    ))
    rank = lambda i: F.pmod(F.col("k") + i * 17, F.lit(100))
    pool = F.transform(
        F.sequence(F.lit(0), F.lit(CANDIDATES_PER_LINE - 1)),
        lambda i: F.create_map(
            F.lit("link"), F.concat(F.lit("k"), rank(i).cast("string")),
            F.lit("rank"), (1 + 10 * rank(i)).cast("string"),
        ),
    )
    return events.select(
        "session_id", "user_id", "query", F.date_format("ts", "yyyy-MM-dd").alias("timestamp"),
        F.when(F.col("event_type") == "click", item).alias("clicked_links"),
        F.when(F.col("event_type") == "view", item).alias("shown_but_not_clicked"),
        F.when(F.col("event_type").isin("click", "view"), pool).alias("candidates"),
    )


SQL_ITEMS = f"""
ev AS (
  SELECT event_id, ts, event_type, value, CAST(user_id AS VARCHAR) AS user_id,
         concat_ws('_', CAST(user_id AS VARCHAR), strftime(ts, '%Y-%m-%d')) AS session_id,
         'q' || CAST(user_id % 7 AS VARCHAR) AS query, strftime(ts, '%Y-%m-%d') AS session_time,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events),
ranked AS (
  SELECT *, event_id % 10 + 1 AS position FROM ev),
items AS (
  SELECT session_id, user_id, query, session_time, CASE event_type WHEN 'click' THEN 'clicked' ELSE 'shown' END AS role,
         'k' || CAST(k AS VARCHAR) AS link, position, epoch_us(ts) // 1000 AS event_ms,
         CASE event_type WHEN 'click' THEN value END AS dwell,
         CASE event_type WHEN 'view' THEN 'impression' END AS skip_type
  FROM ranked WHERE event_type IN ('click', 'view')
  UNION ALL
  SELECT session_id, user_id, query, session_time, 'candidate', 'k' || CAST((k + i * 17) % 100 AS VARCHAR),
         1 + 10 * ((k + i * 17) % 100), NULL, NULL, NULL
  FROM ranked, (SELECT unnest(range({CANDIDATES_PER_LINE})) AS i) WHERE event_type IN ('click', 'view'))
"""
SQL_PROP = "greatest(CAST(0.05 AS DOUBLE), least(CAST(1 AS DOUBLE), 1 / pow(1 + greatest(1, position), CAST(0.5 AS DOUBLE))))"
SQL_ISO = "strftime(make_timestamp({ms} * 1000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN {ms} % 1000 = 0 THEN '' ELSE '.' || lpad(CAST({ms} % 1000 AS VARCHAR), 3, '0') || '000' END || '+00:00'"
SQL_EXAMPLES = f"""{SQL_ITEMS},
clicked AS (SELECT DISTINCT session_id, link FROM items WHERE role = 'clicked'),
pos AS (
  SELECT 'positive' AS type, 1 AS label, session_id, user_id, query, session_time, link AS nav_link, position,
         {SQL_ISO.format(ms='event_ms')} AS click_time, dwell AS dwell_time,
         CAST(NULL AS VARCHAR) AS shown_time, CAST(NULL AS VARCHAR) AS skip_type
  FROM items WHERE role = 'clicked'),
neg AS (
  SELECT 'negative' AS type, 0 AS label, session_id, user_id, query, session_time, link AS nav_link, position,
         CAST(NULL AS VARCHAR) AS click_time, CAST(NULL AS DOUBLE) AS dwell_time,
         {SQL_ISO.format(ms='event_ms')} AS shown_time, skip_type
  FROM items i WHERE role = 'shown' AND NOT EXISTS (SELECT 1 FROM clicked c WHERE c.session_id = i.session_id AND c.link = i.link)),
best AS (
  SELECT session_id, link AS nav_link, min(user_id) AS user_id, min(query) AS query, min(session_time) AS session_time, min(position) AS position
  FROM items WHERE role = 'candidate' GROUP BY ALL),
pool AS (
  SELECT *, position BETWEEN 101 AND 1000 AS is_hard FROM best b
  WHERE NOT EXISTS (SELECT 1 FROM clicked c WHERE c.session_id = b.session_id AND c.link = b.nav_link)
    AND NOT EXISTS (SELECT 1 FROM neg c WHERE c.session_id = b.session_id AND c.nav_link = b.nav_link)),
quota AS (
  SELECT p.session_id, count(*) FILTER (is_hard) AS n_hard, 3 * greatest(1, coalesce(any_value(n_pos), 0)) AS k
  FROM pool p LEFT JOIN (SELECT session_id, count(*) AS n_pos FROM clicked GROUP BY 1) c ON c.session_id = p.session_id GROUP BY 1),
quota2 AS (SELECT *, least(n_hard, CAST(round_even(CAST(0.7 AS DOUBLE) * k, 0) AS BIGINT)) AS hard_k FROM quota),
draw1 AS (
  SELECT p.*, k, hard_k, is_hard AND row_number() OVER (PARTITION BY p.session_id, is_hard ORDER BY {sql_md5('7h', 'p.session_id', 'nav_link')}) <= hard_k AS is_taken
  FROM pool p JOIN quota2 q ON q.session_id = p.session_id),
draw2 AS (
  SELECT *, row_number() OVER (PARTITION BY session_id, is_taken ORDER BY {sql_md5('7r', 'session_id', 'nav_link')}) AS d FROM draw1),
sampled AS (
  SELECT 'negative' AS type, 0 AS label, session_id, user_id, query, session_time, nav_link, position,
         CAST(NULL AS VARCHAR) AS click_time, CAST(NULL AS DOUBLE) AS dwell_time, session_time AS shown_time,
         CASE WHEN is_taken THEN 'sampled_hard' ELSE 'sampled_random' END AS skip_type
  FROM draw2 WHERE is_taken OR d <= k - hard_k),
raw_examples AS (SELECT * FROM pos UNION ALL SELECT * FROM neg UNION ALL SELECT * FROM sampled),
weighted AS (SELECT *, {SQL_PROP} AS propensity, 1 / greatest({SQL_PROP}, 1e-6) AS ips_weight FROM raw_examples),
examples AS (SELECT *, ips_weight * count(*) OVER (PARTITION BY session_id) / sum(ips_weight) OVER (PARTITION BY session_id) AS snips_weight FROM weighted)
"""
