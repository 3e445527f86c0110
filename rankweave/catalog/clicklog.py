"""Click-log labelling and debiasing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankweave.catalog.base import SQL_EXAMPLES, SQL_ITEMS, q6, query, r6, session_log
from rankweave.functions.text import tokenize_alnum
from rankweave.operators import clicklog as cl


def items(spark, sf, roles=("clicked", "shown", "candidate")):
    return cl.unnest_sessions(session_log(spark, sf), roles)


def logged_items(spark, sf):
    return items(spark, sf, ("clicked", "shown"))


def logged_examples(spark, sf):
    return cl.label_logged(logged_items(spark, sf))


LOGGED = f"WITH {SQL_EXAMPLES}, logged AS (SELECT * FROM weighted WHERE skip_type IS NULL OR skip_type = 'impression')"


@query("L1_explode_session_positives", f"""
WITH {SQL_EXAMPLES} SELECT type, label, session_id, user_id, query, session_time, nav_link, position, click_time, dwell_time FROM pos""")
def positives(spark, sf):
    return cl.label_positives(logged_items(spark, sf)).drop("record")


@query("L2_explode_session_negatives", f"""
WITH {SQL_EXAMPLES} SELECT type, label, session_id, user_id, query, session_time, nav_link, position, shown_time, skip_type FROM neg""")
def negatives(spark, sf):
    return cl.label_negatives(logged_items(spark, sf)).drop("record")


@query("L3_position_propensity", f"""
WITH {SQL_ITEMS}
SELECT session_id, role, link, position, {q6("greatest(0.05, least(1, 1/pow(1+position, 0.5)))")} AS power_law,
       {q6("greatest(0.05, least(1, 1/log2(position+1)))")} AS inverse_log,
       {q6("CASE position WHEN 1 THEN 0.9 WHEN 2 THEN 0.6 WHEN 11 THEN 0.1 ELSE 0.05 END")} AS from_map
FROM items""")
def position_propensity(spark, sf):
    position = F.col("position")
    return items(spark, sf).select(
        "session_id", "role", "link", "position",
        r6(cl.propensity(position)).alias("power_law"),
        r6(cl.propensity(position, cl.LabelConfig(propensity_model="inverse_log"))).alias("inverse_log"),
        r6(cl.propensity(position, cl.LabelConfig(position_map={1: 0.9, 2: 0.6, 11: 0.1}))).alias("from_map"),
    )


@query("L4_ips_weight", f"""
{LOGGED} SELECT session_id, nav_link, position, label, {q6('ips_weight')} AS ips_weight,
  {q6("CASE WHEN label = 1 THEN 0.8 ELSE 0.3 END / greatest(propensity, 1e-6)")} AS policy_weight FROM logged""")
def ips(spark, sf):
    policy = cl.LabelConfig(target_policy=lambda: F.when(F.col("type") == "positive", 0.8).otherwise(0.3))
    rows = cl.with_weights(logged_examples(spark, sf))
    return rows.select("session_id", "nav_link", "position", "label", r6("ips_weight").alias("ips_weight"),
                       r6(cl.ips_weight(F.col("propensity"), policy)).alias("policy_weight"))


@query("L5_snips_weight", f"""
{LOGGED} SELECT session_id, nav_link, position, label,
  {q6('ips_weight * count(*) OVER (PARTITION BY session_id) / sum(ips_weight) OVER (PARTITION BY session_id)')} AS snips_weight,
  {q6('ips_weight / sum(ips_weight) OVER (PARTITION BY session_id)')} AS share FROM logged""")
def snips(spark, sf):
    rows = cl.snips(cl.with_weights(logged_examples(spark, sf)))
    return rows.select("session_id", "nav_link", "position", "label", r6("snips_weight").alias("snips_weight"), r6("weight_share").alias("share"))


@query("L6_dedup_candidates", f"WITH {SQL_EXAMPLES} SELECT session_id, nav_link, position FROM best")
def dedup_candidates(spark, sf):
    return cl.best_candidates(items(spark, sf, ("candidate",))).select("session_id", "nav_link", "position")


@query("L7_mixed_negative_sampling", f"WITH {SQL_EXAMPLES} SELECT session_id, nav_link, position, shown_time, skip_type FROM sampled")
def mixed_negatives(spark, sf):
    return cl.sample_negatives(items(spark, sf)).select("session_id", "nav_link", "position", "shown_time", "skip_type")


@query("L8_build_click_dataset", f"""
WITH {SQL_EXAMPLES} SELECT type, label, session_id, user_id, query, session_time, nav_link, position, click_time, dwell_time, shown_time, skip_type,
  {q6('propensity')} AS propensity, {q6('ips_weight')} AS ips_weight, {q6('snips_weight')} AS snips_weight FROM examples""")
def build(spark, sf):
    rows = cl.build_dataset(items(spark, sf))
    return rows.withColumns({c: r6(c) for c in ("propensity", "ips_weight", "snips_weight")}).select(
        "type", "label", "session_id", "user_id", "query", "session_time", "nav_link", "position", "click_time", "dwell_time",
        "shown_time", "skip_type", "propensity", "ips_weight", "snips_weight")


@query("L_flagship_label_report", f"""
{LOGGED} SELECT type, position, count(*) AS examples, {q6('sum(w)')} AS snips_total
FROM (SELECT *, ips_weight * count(*) OVER (PARTITION BY session_id) / sum(ips_weight) OVER (PARTITION BY session_id) AS w FROM logged) GROUP BY 1, 2""")
def label_report(spark, sf):
    rows = cl.snips(cl.with_weights(logged_examples(spark, sf)))
    return rows.groupBy("type", "position").agg(F.count(F.lit(1)).alias("examples"), r6(F.sum("snips_weight")).alias("snips_total"))


@query("L9_engagement_labels", f"""
{LOGGED} SELECT session_id, nav_link, coalesce(user_id, 'unknown') AS user_id, CAST(label AS DOUBLE) AS clicked,
  CAST(CASE WHEN label = 1 AND coalesce(dwell_time, 0) >= 60 THEN 1 ELSE 0 END AS DOUBLE) AS completed,
  CAST(0 AS DOUBLE) AS crosssell, {q6('propensity')} AS propensity, CAST(position AS DOUBLE) AS position, coalesce(dwell_time, CAST(0 AS DOUBLE)) AS dwell_time FROM logged""")
def engagement(spark, sf):
    rows = cl.engagement_labels(cl.with_weights(logged_examples(spark, sf)))
    return rows.select("session_id", "nav_link", "user_id", "clicked", "completed", "crosssell", r6("propensity").alias("propensity"), "position", "dwell_time")


@query("L10_ranker_numeric_features", f"""
{LOGGED} SELECT session_id, nav_link, {q6('(position - 1) / 9.0')} AS pos_norm, {q6('propensity')} AS prop,
  {q6('least(1, greatest(0, coalesce(dwell_time, 0) / 180))')} AS dwell_norm FROM logged""")
def ranker_numeric(spark, sf):
    rows = cl.ranker_features(cl.engagement_labels(cl.with_weights(logged_examples(spark, sf))))
    return rows.select("session_id", "nav_link", r6("pos_norm").alias("pos_norm"), r6("prop").alias("prop"), r6("dwell_norm").alias("dwell_norm"))


@query("L11_dataset_summary", f"""
WITH {SQL_EXAMPLES} SELECT count(*) AS examples, count(DISTINCT user_id) AS users,
  count(DISTINCT query) + 2 AS query_vocab, count(DISTINCT nav_link) + 2 AS item_vocab FROM examples""")
def summary(spark, sf):
    rows = cl.build_dataset(items(spark, sf)).select("user_id", "query", "nav_link")
    return cl.dataset_summary(rows, tokenize_alnum(F.col("query")), tokenize_alnum(F.col("nav_link")))


@query("L12_bpr_pairs", f"""
WITH {SQL_ITEMS}, c AS (SELECT session_id, user_id, query, link, row_number() OVER (PARTITION BY session_id ORDER BY position, link) AS r FROM items WHERE role = 'clicked'),
s AS (SELECT session_id, link, row_number() OVER (PARTITION BY session_id ORDER BY position, link) AS r FROM items WHERE role = 'shown')
SELECT c.session_id, user_id, query, c.link AS pos_link, s.link AS neg_link FROM c JOIN s ON c.session_id = s.session_id AND c.r = 1 AND s.r = 1""")
def pairs(spark, sf):
    return cl.bpr_pairs(logged_items(spark, sf))


SQL_BCE = "-({t} * greatest(ln({p}), -100) + (1 - {t}) * greatest(ln(1 - {p}), -100))"


@query("L13_weighted_losses", f"""
{LOGGED}, s AS (SELECT CAST(label AS DOUBLE) AS clicked, CASE WHEN label = 1 AND coalesce(dwell_time, 0) >= 60 THEN 1.0::DOUBLE ELSE 0 END AS completed,
   propensity, (1 / (1 + position))::DOUBLE * 0.9 + 0.05 AS p1, 0.25 + 0.5 * least(1, coalesce(dwell_time, 0) / 180) AS p2, 0.1::DOUBLE AS p3, 1 / greatest(propensity, 1e-3) AS w FROM logged),
 l AS (SELECT sum(w * {SQL_BCE.format(t='clicked', p='p1')}) / sum(w) AS a, avg({SQL_BCE.format(t='completed', p='p2')}) FILTER (clicked = 1) AS b,
   avg(w * {SQL_BCE.format(t='0', p='p3')}) AS c FROM s)
SELECT {q6('a')} AS ctr_loss, {q6('b')} AS completion_loss, {q6('c')} AS crosssell_loss, {q6('a + 0.5 * b + 0.3 * c')} AS total_loss FROM l""")
def losses(spark, sf):
    rows = cl.engagement_labels(cl.with_weights(logged_examples(spark, sf))).withColumns({
        "p_click": F.lit(0.9) / (1.0 + F.col("position")) + 0.05,
        "p_completion": 0.25 + 0.5 * F.least(F.lit(1.0), F.col("dwell_time") / 180.0),
        "p_crosssell": F.lit(0.1),
    })
    out = cl.weighted_losses(rows)
    return out.select(*[r6(c).alias(c) for c in out.columns])
