"""User feature and sequence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankweave.catalog.base import q6, query, r6, table
from rankweave.operators import features as ft

AS_OF = "2024-01-31 00:00:00"


def k_of(col="props"):
    return F.get_json_object(col, "$.k").cast("int")


def transactions(spark, sf):
    ev = table(spark, sf, "events").where(F.col("event_type") == "purchase")
    return ev.select("user_id", "ts", F.col("value").alias("amount"), F.concat(F.lit("c"), F.pmod(k_of(), F.lit(4)).cast("string")).alias("category"))


def interactions(spark, sf):
    ev = table(spark, sf, "events").where(F.col("event_type").isin("click", "view"))
    kind = F.when(F.col("event_type") == "click", "nav_click").otherwise("search")
    return ev.select("user_id", "ts", kind.alias("event_type"), F.concat(F.lit("k"), k_of().cast("string")).alias("detail"))


def users(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))


SQL_BASE = f"""
WITH tx AS (SELECT user_id, ts, value AS amount, 'c' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 AS VARCHAR) AS category FROM events WHERE event_type = 'purchase'),
ia AS (SELECT user_id, ts, CASE event_type WHEN 'click' THEN 'nav_click' ELSE 'search' END AS event_type, 'k' || json_extract_string(props, '$.k') AS detail FROM events WHERE event_type IN ('click', 'view')),
now AS (SELECT TIMESTAMP '{AS_OF}' AS t)
"""


def _sql_windows():
    tx, ia = [], []
    out = ["c_custkey AS user_id"]
    for w in ft.WINDOWS:
        inside = f"ts >= t - INTERVAL {w} DAY AND ts < t"
        tx.append(f"count(*) FILTER ({inside}) AS n{w}, avg(amount) FILTER ({inside}) AS a{w}")
        ia.append(f"count(*) FILTER ({inside} AND event_type = 'nav_click') AS c{w}, count(*) FILTER ({inside} AND event_type = 'search') AS s{w}, count(DISTINCT detail) FILTER ({inside} AND event_type = 'nav_click') AS u{w}")
        out.append(f"coalesce(n{w}, 0) AS transaction_count_{w}d, {q6(f'coalesce(a{w}, 0)')} AS avg_transaction_amount_{w}d, {q6(f'coalesce(n{w}, 0) / {w}.0')} AS transaction_velocity_{w}d, coalesce(c{w}, 0) AS nav_clicks_{w}d, coalesce(s{w}, 0) AS search_queries_{w}d, coalesce(u{w}, 0) AS unique_nav_links_{w}d")
    return f"""{SQL_BASE}, a AS (SELECT user_id, {', '.join(tx)} FROM tx, now GROUP BY 1), b AS (SELECT user_id, {', '.join(ia)} FROM ia, now GROUP BY 1)
SELECT {', '.join(out)} FROM customer LEFT JOIN a ON a.user_id = c_custkey LEFT JOIN b ON b.user_id = c_custkey"""


@query("U1_multi_window_counts", _sql_windows())
def window_counts(spark, sf):
    out = ft.window_features(users(spark, sf), transactions(spark, sf), interactions(spark, sf), AS_OF)
    return out.select(*[r6(c).alias(c) if c.startswith(("avg_", "transaction_velocity")) else F.col(c) for c in out.columns])


def _decay(w, ts="ts", t="t"):
    return f"coalesce(sum(amount * exp(-ln(2) / {w / 2} * (epoch_us(t) - epoch_us(ts)) / 86400000000.0)) FILTER (ts >= t - INTERVAL {w} DAY AND ts < t), 0)"


@query("U2_decayed_category_spend", f"""{SQL_BASE} SELECT user_id, category, {', '.join(f"{q6(_decay(w))} AS spending_decay_{w}d" for w in ft.WINDOWS)} FROM tx, now GROUP BY 1, 2""")
def decayed(spark, sf):
    out = ft.decayed_spend(transactions(spark, sf), AS_OF)
    return out.select("user_id", "category", *[r6(c).alias(c) for c in out.columns[2:]])


@query("U2_orders_decayed_priority_spend", f"""
WITH tx AS (SELECT o_custkey AS user_id, o_orderdate AS ts, o_totalprice AS amount, o_orderpriority AS category FROM orders), now AS (SELECT TIMESTAMP '2001-08-01' AS t)
SELECT user_id, category, {', '.join(f"{q6(_decay(w), 4)} AS spending_decay_{w}d" for w in ft.WINDOWS)} FROM tx, now GROUP BY 1, 2""")
def decayed_orders(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("category"))
    out = ft.decayed_spend(rows, "2001-08-01 00:00:00")
    return out.select("user_id", "category", *[r6(c, 4).alias(c) for c in out.columns[2:]])


@query("U3_trend_ratio", f"""{SQL_BASE}, a AS (SELECT user_id, count(*) FILTER (ts >= t - INTERVAL 7 DAY AND ts < t) AS n7, count(*) FILTER (ts >= t - INTERVAL 30 DAY AND ts < t) AS n30 FROM tx, now GROUP BY 1)
SELECT c_custkey AS user_id, {q6('coalesce(n7, 0) / greatest(coalesce(n30, 0), 1)')} AS transaction_trend_7d_vs_30d FROM customer LEFT JOIN a ON a.user_id = c_custkey""")
def trend(spark, sf):
    out = ft.trend_ratio(ft.window_features(users(spark, sf), transactions(spark, sf), interactions(spark, sf), AS_OF, (7, 30)))
    return out.select("user_id", r6("transaction_trend_7d_vs_30d").alias("transaction_trend_7d_vs_30d"))


def _since(d):
    return f"coalesce(CAST(floor((epoch_us(max(t)) - epoch_us(max(ts) FILTER (detail = '{d}'))) / 86400000000.0) AS BIGINT), -1)"


@query("U4_recency", f"""{SQL_BASE} SELECT c_custkey AS user_id, {_since('k1')} AS days_since_last_k1, {_since('k2')} AS days_since_last_k2
FROM customer CROSS JOIN now LEFT JOIN ia ON ia.user_id = c_custkey GROUP BY 1""")
def recency(spark, sf):
    return ft.recency(users(spark, sf), interactions(spark, sf), ["k1", "k2"], AS_OF)


@query("U5_profile_aggregate", f"""
SELECT o_custkey, {q6('avg(o_totalprice)')} AS o_totalprice, {q6('avg(month(o_orderdate))')} AS order_month, {q6('avg(day(o_orderdate))')} AS order_day,
  max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS has_final, max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS has_urgent FROM orders GROUP BY 1""")
def profile(spark, sf):
    rows = table(spark, sf, "orders").withColumns({
        "order_month": F.month("o_orderdate"), "order_day": F.dayofmonth("o_orderdate"),
        "has_final": (F.col("o_orderstatus") == "F").cast("int"), "has_urgent": (F.col("o_orderpriority") == "1-URGENT").cast("int"),
    })
    out = ft.profile_aggregate(rows, "o_custkey", ["o_totalprice", "order_month", "order_day"], ["has_final", "has_urgent"])
    return out.select("o_custkey", r6("o_totalprice").alias("o_totalprice"), r6("order_month").alias("order_month"), r6("order_day").alias("order_day"), "has_final", "has_urgent")


@query("U6_standard_scale", f"""
SELECT p_partkey, {q6('(p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER ()')} AS p_size_z, {q6('(p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER ()')} AS p_retailprice_z FROM part""")
def standard(spark, sf):
    out = ft.standard_scale(table(spark, sf, "part"), ["p_size", "p_retailprice"])
    return out.select("p_partkey", r6("p_size_z").alias("p_size_z"), r6("p_retailprice_z").alias("p_retailprice_z"))


@query("U7_minmax_scale", f"""
SELECT c_custkey, {q6('(c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ())')} AS c_acctbal_mm, CAST(0 AS DOUBLE) AS flat_mm FROM customer""")
def minmax(spark, sf):
    out = ft.minmax_scale(table(spark, sf, "customer").withColumn("flat", F.lit(3.0)), ["c_acctbal", "flat"])
    return out.select("c_custkey", r6("c_acctbal_mm").alias("c_acctbal_mm"), "flat_mm")


@query("U8_one_hot", """
WITH cats AS (SELECT DISTINCT c_mktsegment AS s FROM customer), rows AS (SELECT c_custkey, CASE WHEN c_nationkey = 0 THEN 'other' ELSE c_mktsegment END AS seg FROM customer)
SELECT c_custkey, seg, string_agg(CASE WHEN s = seg THEN '1' ELSE '0' END, '' ORDER BY s) AS hot FROM rows, cats GROUP BY 1, 2""")
def one_hot(spark, sf):
    customers = table(spark, sf, "customer")
    index = ft.category_index(customers, "c_mktsegment")
    seg = F.when(F.col("c_nationkey") == 0, "other").otherwise(F.col("c_mktsegment"))
    rows = ft.one_hot(customers.select("c_custkey", seg.alias("seg")), "seg", index, "vector")
    hot = F.array_join(F.transform(ft.dense(F.col("vector")), lambda x: x.cast("int").cast("string")), "")
    return rows.select("c_custkey", "seg", hot.alias("hot"))


@query("U9_cyclic_time", f"""
SELECT event_id, {q6('sin(2 * pi() * hour(ts) / 24)')} AS hour_sin, {q6('cos(2 * pi() * hour(ts) / 24)')} AS hour_cos, {q6('sin(2 * pi() * (isodow(ts) - 1) / 7)')} AS day_sin, {q6('cos(2 * pi() * (isodow(ts) - 1) / 7)')} AS day_cos FROM events""")
def cyclic_time(spark, sf):
    hour, day = ft.cyclic(F.hour("ts"), 24), ft.cyclic(F.weekday("ts"), 7)
    return table(spark, sf, "events").select("event_id", r6(hour[0]).alias("hour_sin"), r6(hour[1]).alias("hour_cos"), r6(day[0]).alias("day_sin"), r6(day[1]).alias("day_cos"))


@query("U10_assemble_user_vector", f"""
WITH ctx AS (SELECT event_id, user_id, event_type, hour(ts) AS h, isodow(ts) - 1 AS d FROM events),
st AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, avg(c_nationkey) AS mu, stddev_pop(c_nationkey) AS sd FROM customer),
cats AS (SELECT event_type AS cat, row_number() OVER (ORDER BY event_type) AS o, count(*) OVER () AS n FROM (SELECT DISTINCT event_type FROM events)),
j AS (SELECT ctx.*, customer.*, st.* FROM ctx JOIN customer ON c_custkey = user_id CROSS JOIN st),
n AS (SELECT max(n) AS n FROM cats)
SELECT event_id, 0 AS pos, {q6('(c_acctbal - lo) / (hi - lo)')} AS value FROM j
UNION ALL SELECT event_id, 1, {q6('(c_nationkey - mu) / sd')} FROM j
UNION ALL SELECT event_id, 1 + o, CASE WHEN cat = event_type THEN 1.0::DOUBLE ELSE 0 END FROM j, cats
UNION ALL SELECT event_id, 2 + n, CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0::DOUBLE ELSE 0 END FROM j, n
UNION ALL SELECT event_id, 3 + n, {q6('sin(2 * pi() * h / 24)')} FROM j, n UNION ALL SELECT event_id, 4 + n, {q6('cos(2 * pi() * h / 24)')} FROM j, n
UNION ALL SELECT event_id, 5 + n, {q6('sin(2 * pi() * d / 7)')} FROM j, n UNION ALL SELECT event_id, 6 + n, {q6('cos(2 * pi() * d / 7)')} FROM j, n""")
def assemble(spark, sf):
    people = table(spark, sf, "customer").withColumn("building", (F.col("c_mktsegment") == "BUILDING").cast("int"))
    contexts = table(spark, sf, "events").select("event_id", F.col("user_id").alias("c_custkey"), "event_type", F.hour("ts").alias("current_hour"), F.weekday("ts").alias("current_day_of_week"))
    encoder = ft.UserEncoder(["c_acctbal"], ["c_nationkey"], ["event_type"], ["building"]).fit(people, contexts)
    rows = encoder.transform(contexts.join(people, "c_custkey"))
    return rows.select("event_id", F.posexplode("vector").alias("pos", "v")).select("event_id", "pos", r6("v").alias("value"))


@query("U11_query_features", r"""
SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS word_count, CAST(regexp_matches(text, '\d') AS INTEGER) AS has_number,
  CAST(contains(text, 'save') OR contains(text, 'loan') AS INTEGER) AS has_financial_keyword FROM documents""")
def query_features(spark, sf):
    return ft.query_features(table(spark, sf, "documents"), "text").select("doc_id", "word_count", "has_number", "has_financial_keyword")


def monthly(spark, sf):
    rows = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("user_id"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return rows.agg(F.count(F.lit(1)).cast("double").alias("f1"), F.sum("o_totalprice").alias("f2"), F.avg("o_totalprice").alias("f3"), F.max("o_totalprice").alias("f4"))


FEATURES = ["f1", "f2", "f3", "f4"]
SQL_MONTHLY = """WITH m AS (SELECT o_custkey AS user_id, strftime(o_orderdate, '%Y-%m') AS month, CAST(count(*) AS DOUBLE) AS f1, sum(o_totalprice) AS f2, avg(o_totalprice) AS f3, max(o_totalprice) AS f4 FROM orders GROUP BY 1, 2)"""


@query("U12_monthly_history", f"""{SQL_MONTHLY}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY month DESC) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM m),
s AS (SELECT c_custkey AS user_id, unnest(range(9)) AS slot FROM customer)
SELECT s.user_id, CAST(slot AS INTEGER) AS slot, {', '.join(f"{q6(f'coalesce({f}, 0)', 4)} AS {f}" for f in FEATURES)}, CAST(least(coalesce(t.n, 0), 9) AS INTEGER) AS length
FROM s LEFT JOIN r ON r.user_id = s.user_id AND r.k = 9 - slot LEFT JOIN (SELECT user_id, count(*) AS n FROM m GROUP BY 1) t ON t.user_id = s.user_id""")
def history(spark, sf):
    out = ft.monthly_history(monthly(spark, sf), users(spark, sf), FEATURES)
    flat = out.select("user_id", "length", F.posexplode("history").alias("slot", "v"))
    return flat.select("user_id", "slot", *[r6(F.col("v")[i], 4).alias(f) for i, f in enumerate(FEATURES)], "length")


def sequences(spark, sf):
    """First eight months per customer, in month order."""
    from pyspark.sql import Window

    first = Window.partitionBy("user_id").orderBy("month")
    kept = monthly(spark, sf).withColumn("r", F.row_number().over(first)).where(F.col("r") <= 8)
    packed = kept.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("r", F.array(*FEATURES).alias("v")))).alias("l"))
    return packed.select("user_id", F.transform("l", lambda s: s["v"]).alias("seq"))


@query("U13_prefix_windows", f"""{SQL_MONTHLY}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY month) AS k FROM m),
t AS (SELECT user_id, k - 1 AS step, f2 AS target FROM r WHERE k BETWEEN 2 AND 8), s AS (SELECT *, unnest(range(7)) AS slot FROM t)
SELECT s.user_id, CAST(step AS INTEGER) AS step, CAST(slot AS INTEGER) AS slot, {q6('CASE WHEN slot < step THEN r.f2 ELSE 0 END', 4)} AS input, {q6('target', 4)} AS target
FROM s LEFT JOIN r ON r.user_id = s.user_id AND r.k = slot + 1""")
def prefixes(spark, sf):
    out = ft.prefix_windows(sequences(spark, sf), 8)
    flat = out.select("user_id", "step", "target", F.posexplode("input").alias("slot", "v"))
    return flat.select("user_id", "step", "slot", r6(F.col("v")[1], 4).alias("input"), r6(F.col("target")[1], 4).alias("target"))


@query("U14_item_user_index", "SELECT user_id, dense_rank() OVER (ORDER BY user_id) - 1 AS id FROM (SELECT DISTINCT user_id FROM events)")
def user_index(spark, sf):
    return ft.key_index(table(spark, sf, "events"), "user_id", F.floor(F.col("user_id") / 10000))
