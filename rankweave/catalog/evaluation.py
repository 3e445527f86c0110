"""Evaluation and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankweave import skew
from rankweave.catalog import clicklog as logs
from rankweave.catalog.base import SQL_ITEMS, q6, query, r6, sql_hash, table
from rankweave.catalog.features import FEATURES, SQL_MONTHLY, sequences
from rankweave.catalog.retrieval import SQL_RANKS, SQL_V, cross_rank, vectors
from rankweave.catalog.tags import SQL_Q, label_means
from rankweave.catalog.text import SQL_BM25, benchmark, bm25_ranking, documents
from rankweave.catalog.trainset import vector_faq
from rankweave.functions.sampling import bucket
from rankweave.functions.text import tokenize_alnum
from rankweave.functions.vectors import cosine
from rankweave.operators import clicklog as cl
from rankweave.operators import entities as en
from rankweave.operators import features as ft
from rankweave.operators import metrics as mt
from rankweave.operators import models
from rankweave.operators import tags as tg
from rankweave.session import cut_lineage


def ranked(spark, sf):
    return cut_lineage(bm25_ranking(spark, sf, 20).select("query_id", F.col("doc_id").alias("item_id"), "rank"))


def truth(spark, sf):
    """The documents that hold a benchmark passage, its words one after the other, by id."""
    docs = documents(spark, sf).select(F.col("doc_id").alias("id"), "text")
    passages = benchmark(spark, sf).select(F.col("text").alias("value"), F.col("query_id").cast("string").alias("label"))
    held = en.tag_with_dictionary(docs, passages).select(F.col("label").cast("long").alias("query_id"), F.col("id").alias("item_id")).distinct()
    return cut_lineage(skew.numbered(held, [F.col("item_id")], "place", ["query_id"]))


SQL_DICTIONARY_WORDS = r"' ' || array_to_string(list_filter(regexp_split_to_array(lower({t}), '[^\p{{L}}\p{{N}}#&''-]+'), lambda w: w <> ''), ' ') || ' '"
SQL_EVAL = f"""{SQL_BM25}, rk AS (SELECT query_id, doc_id AS item_id, rank FROM bm_ranked WHERE rank <= 20),
tr AS MATERIALIZED (SELECT b.query_id, d.doc_id AS item_id, row_number() OVER (PARTITION BY b.query_id ORDER BY d.doc_id) AS place, count(*) OVER (PARTITION BY b.query_id) AS size
 FROM (SELECT item_id AS query_id, {SQL_DICTIONARY_WORDS.format(t='text')} AS w FROM benchmark) b JOIN (SELECT doc_id, {SQL_DICTIONARY_WORDS.format(t='text')} AS w FROM documents) d ON contains(d.w, b.w)),
hit AS (SELECT rk.*, place, size FROM rk JOIN tr USING (query_id, item_id)), qs AS (SELECT DISTINCT query_id, coalesce(size, 0) AS size FROM (SELECT query_id FROM tr UNION SELECT query_id FROM rk) LEFT JOIN (SELECT DISTINCT query_id, size FROM tr) USING (query_id))"""


@query("M1_ndcg_at_k", f"""WITH {SQL_EVAL}, d AS (SELECT query_id, sum((size + 1 - place) / log2(rank + 1)) AS dcg FROM hit WHERE rank <= 5 GROUP BY 1), i AS (SELECT query_id, sum((size + 1 - place) / log2(place + 1)) AS idcg FROM tr WHERE place <= 5 GROUP BY 1)
SELECT query_id, {q6('coalesce(dcg, 0)')} AS dcg, {q6('coalesce(idcg, 0)')} AS idcg, {q6('coalesce(dcg / idcg, 0)')} AS ndcg FROM qs LEFT JOIN d USING (query_id) LEFT JOIN i USING (query_id)""")
def ndcg(spark, sf):
    out = mt.ndcg_at_k(ranked(spark, sf), truth(spark, sf), 5)
    return out.select("query_id", *[r6(c).alias(c) for c in ("dcg", "idcg", "ndcg")])


def _at(k):
    return f"{q6(f'count(*) FILTER (rank <= {k}) / {k}.0')} AS precision_{k}, {q6(f'count(*) FILTER (rank <= {k}) / greatest(any_value(qs.size), 1)')} AS recall_{k}, CAST(CASE WHEN count(*) FILTER (rank <= {k}) > 0 THEN 1 ELSE 0 END AS DOUBLE) AS hitrate_{k}"


SQL_PER_K = f"WITH {SQL_EVAL}, pk AS (SELECT query_id, {', '.join(_at(k) for k in (1, 3, 5, 10))} FROM qs LEFT JOIN hit USING (query_id) GROUP BY 1)"


def per_k(spark, sf, ks):
    return mt.precision_recall_at_k(ranked(spark, sf), truth(spark, sf), ks)


@query("M2_precision_at_k", f"{SQL_PER_K} SELECT query_id, precision_5 FROM pk")
def precision(spark, sf):
    return per_k(spark, sf, [5]).select("query_id", r6("precision_5").alias("precision_5"))


@query("M3_recall_at_k", f"{SQL_PER_K} SELECT query_id, recall_10 FROM pk")
def recall(spark, sf):
    return per_k(spark, sf, [10]).select("query_id", r6("recall_10").alias("recall_10"))


SQL_AP = f"WITH {SQL_EVAL}, n AS (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM hit), ap AS (SELECT query_id, coalesce(sum(nth / rank), 0) / greatest(any_value(qs.size), 1) AS ap FROM qs LEFT JOIN n USING (query_id) GROUP BY 1)"


@query("M4_average_precision", f"{SQL_AP} SELECT query_id, {q6('ap')} AS ap FROM ap")
def ap(spark, sf):
    return mt.average_precision(ranked(spark, sf), truth(spark, sf)).withColumn("ap", r6("ap"))


@query("M4_mean_average_precision", f"{SQL_AP} SELECT {q6('avg(ap)')} AS map FROM ap")
def mean_ap(spark, sf):
    return mt.mean_average_precision(ranked(spark, sf), truth(spark, sf)).withColumn("map", r6("map"))


_KS = [f"{m}_{k}" for k in (1, 3, 5, 10) for m in ("precision", "recall", "hitrate")]


@query("M5_multi_k_eval", f"{SQL_PER_K} SELECT {', '.join(f'{q6(f'avg({c})', 4)} AS {c}' for c in _KS)} FROM pk")
def multi_k(spark, sf):
    out = mt.mean_at_k(per_k(spark, sf, [1, 3, 5, 10]))
    return out.select(*[r6(c, 4).alias(c) for c in out.columns])


@query("M6_rank_metrics", f"WITH {SQL_RANKS} SELECT {', '.join(f'{q6(f'avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0 END)')} AS recall_{k}' for k in (10, 50, 100))}, {q6('avg(CAST(1 AS DOUBLE) / rank)')} AS mrr, {q6('avg(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END)')} AS ndcg_10 FROM ranks")
def rank_report(spark, sf):
    out = mt.rank_metrics(cross_rank(spark, sf))
    return out.select(*[r6(c).alias(c) for c in out.columns])


SQL_BATCH = f"WITH {SQL_V}, f AS (SELECT a.id, a.vec AS av, b.vec AS pv, (row_number() OVER (ORDER BY a.id) - 1) // 32 AS batch FROM v a JOIN v b ON b.id = (a.id + 1) % a.n), s AS (SELECT q.id, q.batch, c.id AS other, list_dot_product(q.av, c.pv) AS score FROM f q JOIN f c ON c.batch = q.batch), r AS (SELECT s.id, s.batch, 1 + count(*) FILTER (round(s.score, 9) > round(o.score, 9)) AS rank FROM s JOIN s o ON o.id = s.id AND o.other = s.id GROUP BY 1, 2)"


@query("M7_in_batch_eval", f"{SQL_BATCH} SELECT {', '.join(f'{q6(f'avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0 END)')} AS accuracy_{k}' for k in (1, 3, 5, 10))}, {q6('avg(CAST(1 AS DOUBLE) / rank)')} AS mrr FROM r")
def in_batch(spark, sf):
    out = mt.in_batch_report(mt.in_batch_ranks(vector_faq(spark, sf), 32), 32)
    return out.select(*[r6(c).alias(c) for c in out.columns])


def quality(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") / (F.col("n_chars") + 1000)).alias("score"))
    return table(spark, sf, "labels").join(docs, "doc_id").select("doc_id", F.col("quality").cast("double").alias("label"), "toxic", "score")


SQL_QUAL = "WITH s AS (SELECT doc_id, CAST(quality AS DOUBLE) AS y, toxic, n_chars / (n_chars + 1000) AS p FROM labels JOIN documents USING (doc_id))"
SQL_AUC = "(SELECT (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) FROM (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM {src}))"
SQL_LL = "avg(-(y * ln(least(greatest(p, 1e-7), 1 - 1e-7)) + (1 - y) * ln(1 - least(greatest(p, 1e-7), 1 - 1e-7))))"
SQL_ACC = "avg(CASE WHEN (p >= 0.5) = (y >= 0.5) THEN 1.0 ELSE 0 END)"


@query("M8_auc", f"{SQL_QUAL} SELECT {q6(SQL_AUC.format(src='s'))} AS auc")
def auc(spark, sf):
    return mt.auc(quality(spark, sf)).withColumn("auc", r6("auc"))


@query("M9_logloss", f"{SQL_QUAL} SELECT {q6(SQL_LL)} AS logloss FROM s")
def logloss(spark, sf):
    return quality(spark, sf).agg(r6(mt.logloss(F.col("score"), F.col("label"))).alias("logloss"))


@query("M10_accuracy", f"{SQL_QUAL} SELECT {q6(SQL_ACC)} AS accuracy, {q6('avg(CASE WHEN y <> toxic THEN 1.0 ELSE 0 END)')} AS class_accuracy FROM s")
def accuracy(spark, sf):
    return quality(spark, sf).agg(
        r6(mt.binary_accuracy(F.col("score"), F.col("label"))).alias("accuracy"), r6(mt.class_accuracy(F.col("label"), 1.0 - F.col("toxic"))).alias("class_accuracy"))


def scored_clicks(spark, sf):
    rows = cl.engagement_labels(cl.with_weights(logs.logged_examples(spark, sf)))
    return rows.withColumns({"p_click": F.lit(0.9) / (1.0 + F.col("position")) + 0.05, "p_completion": F.col("dwell_time") / (F.col("dwell_time") + 100.0)})


@query("M11_ranker_report", f"""{logs.LOGGED}, a AS (SELECT CAST(label AS DOUBLE) AS y, CAST(0.9 AS DOUBLE) / (1 + position) + 0.05 AS p FROM logged),
b AS (SELECT CASE WHEN coalesce(dwell_time, 0) >= 60 THEN 1.0::DOUBLE ELSE 0 END AS y, coalesce(dwell_time, 0) / (coalesce(dwell_time, 0) + 100) AS p FROM logged WHERE label = 1)
SELECT 'ctr' AS task, count(*) AS n, {q6(SQL_AUC.format(src='a'))} AS auc, {q6(SQL_LL)} AS logloss, {q6(SQL_ACC)} AS accuracy FROM a
UNION ALL SELECT 'completion', count(*), {q6(SQL_AUC.format(src='b'))}, {q6(SQL_LL)}, {q6(SQL_ACC)} FROM b""")
def ranker_report(spark, sf):
    out = mt.ranker_report(cut_lineage(scored_clicks(spark, sf).select("clicked", "completed", "p_click", "p_completion")))
    return out.withColumns({c: r6(c) for c in ("auc", "logloss", "accuracy")})


SQL_TRI = f"{SQL_V}, t AS (SELECT a.id, list_cosine_similarity(a.vec, p.vec) AS ps, list_cosine_similarity(a.vec, g.vec) AS ns FROM v a JOIN v p ON p.id = (a.id + 1) % a.n JOIN v g ON g.id = (a.id + 2) % a.n)"


def triplets(spark, sf):
    v = vectors(spark, sf).select("id", "vec")
    n = v.agg(F.count(F.lit(1))).scalar()
    rows = v.select("id", F.col("vec").alias("anchor_vec"), ((F.col("id") + 1) % n).alias("p"), ((F.col("id") + 2) % n).alias("g"))
    return rows.join(v.select(F.col("id").alias("p"), F.col("vec").alias("positive_vec")), "p").join(v.select(F.col("id").alias("g"), F.col("vec").alias("negative_vec")), "g")


def triplet_scores(spark, sf):
    score = lambda side: cosine(F.col("anchor_vec"), F.col(side))
    return triplets(spark, sf).select("id", score("positive_vec").alias("pos_score"), score("negative_vec").alias("neg_score"))


@query("M12_pair_accuracy", f"WITH {SQL_TRI} SELECT {q6('avg(CASE WHEN ps > ns THEN 1.0 ELSE 0 END)')} AS pair_accuracy FROM t")
def pair_accuracy(spark, sf):
    return mt.pair_accuracy(triplet_scores(spark, sf)).withColumn("pair_accuracy", r6("pair_accuracy"))


@query("M13_triplet_accuracy", f"WITH {SQL_TRI} SELECT {q6('avg(CASE WHEN round(ps, 9) > round(ns, 9) THEN 1.0 ELSE 0 END)')} AS triplet_accuracy FROM t")
def triplet_accuracy(spark, sf):
    return mt.triplet_accuracy(triplets(spark, sf)).withColumn("triplet_accuracy", r6("triplet_accuracy"))


@query("M14_in_batch_softmax_loss", f"""WITH {SQL_V}, f AS (SELECT a.id, a.vec AS av, b.vec AS pv, c.vec AS gv, (row_number() OVER (ORDER BY a.id) - 1) // 32 AS batch FROM v a JOIN v b ON b.id = (a.id + 1) % a.n JOIN v c ON c.id = (a.id + 2) % a.n),
s AS (SELECT q.batch, q.id, c.id = q.id AS own, list_dot_product(q.av, c.pv) / CAST(0.05 AS DOUBLE) AS x FROM f q JOIN f c ON c.batch = q.batch UNION ALL SELECT q.batch, q.id, false, list_dot_product(q.av, c.gv) / CAST(0.05 AS DOUBLE) FROM f q JOIN f c ON c.batch = q.batch),
l AS (SELECT batch, id, ln(sum(exp(x))) - sum(x) FILTER (own) AS loss FROM s GROUP BY 1, 2) SELECT batch, {q6('avg(loss)')} AS loss, count(*) AS n FROM l GROUP BY 1""")
def softmax_loss(spark, sf):
    rows = triplets(spark, sf).withColumn("negatives", F.array("negative_vec"))
    return mt.in_batch_softmax_loss(rows, 32, 0.05, "negatives").withColumn("loss", r6("loss"))


@query("M15_bpr_loss", f"WITH {SQL_TRI} SELECT {q6('avg(ln(1 + exp(-(ps - ns))))')} AS bpr_loss FROM t")
def bpr_loss(spark, sf):
    return mt.bpr_loss(triplet_scores(spark, sf)).withColumn("bpr_loss", r6("bpr_loss"))


@query("M16_kl_divergence", f"WITH {SQL_Q}, t AS (SELECT id, cluster, q, q * q / sum(q) OVER (PARTITION BY cluster) AS t FROM q), p AS (SELECT *, t / sum(t) OVER (PARTITION BY id) AS p FROM t) SELECT {q6('sum(p * ln(p / q)) / count(DISTINCT id)', 9)} AS kl FROM p")
def kl(spark, sf):
    centroids = label_means(spark, sf)
    assigned = tg.soft_assign(vectors(spark, sf), centroids)
    sharp = tg.target_distribution(assigned)
    return mt.kl_divergence(assigned.join(sharp, "id")).withColumn("kl", r6("kl", 9))


@query("M16_smooth_l1", f"WITH {SQL_V}, e AS (SELECT unnest(a.vec) * 20 AS x, unnest(b.vec) * 20 AS y FROM v a JOIN v b ON b.id = (a.id + 1) % a.n) SELECT {q6('avg(CASE WHEN abs(x - y) < 1 THEN 0.5 * (x - y) * (x - y) ELSE abs(x - y) - 0.5 END)')} AS smooth_l1 FROM e")
def smooth_l1(spark, sf):
    wide = triplets(spark, sf).select(*[F.transform(c, lambda x: x.cast("double") * 20).alias(c) for c in ("anchor_vec", "positive_vec")])
    return mt.smooth_l1_loss(wide, "anchor_vec", "positive_vec").withColumn("smooth_l1", r6("smooth_l1"))


def pair_features(spark, sf):
    """Click and impression features per session pair: position and link number."""
    pairs = cl.bpr_pairs(logs.logged_items(spark, sf))
    number = lambda c: F.regexp_extract(c, r"(\d+)", 1).cast("double") / 100.0
    rows = logs.logged_items(spark, sf).groupBy("session_id", "link").agg(F.min("position").cast("double").alias("position"))
    side = lambda name: rows.select("session_id", F.col("link").alias(f"{name}_link"), F.array(F.col("position") / 10.0, number("link")).alias(f"{name}_features"))
    return pairs.join(side("pos"), ["session_id", "pos_link"]).join(side("neg"), ["session_id", "neg_link"])


def parted(rows, key):
    """(fit, held out): four fifths of the keys and the rest, by hash. Models are scored on rows they have not seen."""
    own = bucket(17, 5, key)
    return rows.where(own > 0), rows.where(own == 0)


def _sql_solved(name, source, d):
    """``name`` (x0, x1, ..): the solution of the d equations a{i}_{j}, the right side last, by elimination."""
    steps, before = [], source
    for k in range(d):
        row = {(i, j): f"a{k}_{j} / a{k}_{k}" if i == k else f"a{i}_{j} - a{i}_{k} * a{k}_{j} / a{k}_{k}" for i in range(d) for j in range(k + 1, d + 1)}
        steps.append(f"{name}_e{k} AS MATERIALIZED (SELECT {', '.join(f'{v} AS a{i}_{j}' for (i, j), v in row.items())} FROM {before})")
        before = f"{name}_e{k}"
    return ", ".join([*steps, f"{name} AS MATERIALIZED (SELECT {', '.join(f'a{i}_{d} AS x{i}' for i in range(d))} FROM {before})"])


def _sql_penalty(sum_of, reg, i, d, intercept):
    return "0" if intercept and i == d - 1 else f"CASE WHEN {sum_of} = 0 THEN 1 ELSE {reg} * {sum_of} END"


def _sql_logistic(name, source, d, reg=0.01, intercept=True, steps=8):
    """``name`` (x0, x1, ..): the weights after Newton steps over rows (f0, f1, .., y, w)."""
    out = [f"{name}_p AS MATERIALIZED (SELECT {', '.join(_sql_penalty(f'sum(w * f{i} * f{i})', reg, i, d, intercept) + f' AS p{i}' for i in range(d))} FROM {source})",
           f"{name}_b0 AS (SELECT {', '.join(f'CAST(0 AS DOUBLE) AS x{i}' for i in range(d))})"]
    for t in range(steps):
        score = " + ".join(f"f{i} * x{i}" for i in range(d))
        out.append(f"{name}_r{t} AS (SELECT s.*, 1 / (1 + exp(-({score}))) AS p FROM {source} s, {name}_b{t})")
        sums = [f"sum(w * p * (1 - p) * f{i} * f{j}) AS h{i}_{j}" for i in range(d) for j in range(d)] + [f"sum(w * (y - p) * f{i}) AS g{i}" for i in range(d)]
        out.append(f"{name}_h{t} AS MATERIALIZED (SELECT {', '.join(sums)} FROM {name}_r{t})")
        cells = [f"h{i}_{j}{f' + p{i}' if i == j else ''} AS a{i}_{j}" for i in range(d) for j in range(d)] + [f"g{i} - p{i} * x{i} AS a{i}_{d}" for i in range(d)]
        out.append(f"{name}_a{t} AS (SELECT {', '.join(cells)} FROM {name}_h{t}, {name}_p, {name}_b{t})")
        out.append(_sql_solved(f"{name}_d{t}", f"{name}_a{t}", d))
        out.append(f"{name}_b{t + 1} AS MATERIALIZED (SELECT {', '.join(f'b.x{i} + d.x{i} AS x{i}' for i in range(d))} FROM {name}_b{t} b, {name}_d{t} d)")
    return ", ".join([*out, f"{name} AS (SELECT * FROM {name}_b{steps})"])


def _sql_ridge(name, source, d, reg=1e-6):
    """``name`` (x0, x1, ..): the weights over rows (f0, f1, .., y), the last column being the intercept."""
    cells = [f"sum(f{i} * f{j}){' + ' + _sql_penalty(f'sum(f{i} * f{i})', reg, i, d, True) if i == j else ''} AS a{i}_{j}" for i in range(d) for j in range(d)]
    return f"{name}_a AS MATERIALIZED (SELECT {', '.join([*cells, *(f'sum(f{i} * y) AS a{i}_{d}' for i in range(d))])} FROM {source}), {_sql_solved(name, f'{name}_a', d)}"


@query("R1_pairwise_ranker", f"""
WITH {SQL_ITEMS}, c AS (SELECT session_id, link, row_number() OVER (PARTITION BY session_id ORDER BY position, link) AS r FROM items WHERE role = 'clicked'),
s AS (SELECT session_id, link, row_number() OVER (PARTITION BY session_id ORDER BY position, link) AS r FROM items WHERE role = 'shown'),
lk AS (SELECT session_id, link, min(position) / CAST(10 AS DOUBLE) AS a, CAST(regexp_extract(link, '(\\d+)', 1) AS DOUBLE) / 100 AS b FROM items WHERE role IN ('clicked', 'shown') GROUP BY 1, 2),
d AS (SELECT c.session_id, p.a AS pa, p.b AS pb, n.a AS na, n.b AS nb, {sql_hash(17, 'c.session_id')} % 5 AS own FROM c JOIN s ON s.session_id = c.session_id AND s.r = 1
 JOIN lk p ON p.session_id = c.session_id AND p.link = c.link JOIN lk n ON n.session_id = c.session_id AND n.link = s.link WHERE c.r = 1),
fit AS (SELECT pa - na AS f0, pb - nb AS f1, CAST(1 AS DOUBLE) AS y, CAST(1 AS DOUBLE) AS w FROM d WHERE own > 0), {_sql_logistic('m', 'fit', 2, intercept=False)}
SELECT {q6('avg(CASE WHEN pa * x0 + pb * x1 > na * x0 + nb * x1 THEN 1.0 ELSE 0 END)')} AS pair_accuracy FROM d, m WHERE own = 0""")
def pairwise(spark, sf):
    fit, held_out = parted(pair_features(spark, sf), "session_id")
    weights = models.pairwise_ranker(fit)
    scored = held_out.select("session_id", models.linear_score(weights, F.col("pos_features")).alias("pos_score"), models.linear_score(weights, F.col("neg_features")).alias("neg_score"))
    return mt.pair_accuracy(scored).withColumn("pair_accuracy", r6("pair_accuracy"))


@query("R2_debiased_ctr_model", f"""{logs.LOGGED},
e AS MATERIALIZED (SELECT (position - 1) / CAST(9 AS DOUBLE) AS f0, propensity AS f1, least(1, greatest(0, coalesce(dwell_time, 0) / CAST(180 AS DOUBLE))) AS f2, CAST(1 AS DOUBLE) AS f3, 1 / greatest(propensity, 1e-3) AS w,
 CAST(label AS DOUBLE) AS clicked, CASE WHEN label = 1 AND coalesce(dwell_time, 0) >= 60 THEN CAST(1 AS DOUBLE) ELSE 0 END AS completed, {sql_hash(17, 'session_id')} % 5 AS own FROM logged),
cf AS (SELECT *, clicked AS y FROM e WHERE own > 0), pf AS (SELECT *, completed AS y FROM e WHERE own > 0 AND clicked = 1),
{_sql_logistic('cm', 'cf', 4)}, {_sql_logistic('pm', 'pf', 4)},
a AS (SELECT clicked AS y, 1 / (1 + exp(-(f0 * x0 + f1 * x1 + f2 * x2 + f3 * x3))) AS p FROM e, cm WHERE own = 0),
b AS (SELECT completed AS y, 1 / (1 + exp(-(f0 * x0 + f1 * x1 + f2 * x2 + f3 * x3))) AS p FROM e, pm WHERE own = 0 AND clicked = 1)
SELECT 'ctr' AS task, count(*) AS n, {q6(SQL_AUC.format(src='a'))} AS auc, {q6(SQL_LL)} AS logloss, {q6(SQL_ACC)} AS accuracy FROM a
UNION ALL SELECT 'completion', count(*), {q6(SQL_AUC.format(src='b'))}, {q6(SQL_LL)}, {q6(SQL_ACC)} FROM b""")
def ctr_model(spark, sf):
    rows = cl.ranker_features(cl.engagement_labels(cl.with_weights(logs.logged_examples(spark, sf))))
    fit, held_out = parted(rows, "session_id")
    inputs = ["pos_norm", "prop", "dwell_norm"]
    click = models.predict_probability(models.debiased_click_model(fit, inputs, "clicked"), held_out, inputs, "p_click")
    both = models.predict_probability(models.debiased_click_model(fit.where(F.col("clicked") >= 0.5), inputs, "completed"), click, inputs, "p_completion")
    out = mt.ranker_report(cut_lineage(both.select("clicked", "completed", "p_click", "p_completion")))
    return out.withColumns({c: r6(c) for c in ("auc", "logloss", "accuracy")})


@query("R3_text_classifier")
def classifier(spark, sf):
    fit, held_out = parted(table(spark, sf, "documents").select("doc_id", tokenize_alnum(F.col("text")).alias("tokens"), "lang"), "doc_id")
    model = models.text_classifier(fit, "tokens", "lang")
    return model.transform(held_out).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), mt.class_accuracy(F.col("prediction"), F.col("label_id")).alias("accuracy"))


@query("R4_user_segments")
def segments(spark, sf):
    rows = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.avg("o_totalprice").alias("mean"), F.max("o_totalprice").alias("top"), F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.month("o_orderdate")).alias("month"))
    out = models.user_segments(rows, "o_custkey", ["mean", "top", "n", "month"], 2, 5)
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("users"), F.avg(F.array_max("q")).alias("mean_confidence"))


@query("R5_next_step_baselines", """WITH m AS (SELECT o_custkey AS user_id, strftime(o_orderdate, '%Y-%m') AS month, sum(o_totalprice) AS f FROM orders GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY month) AS k, lag(f) OVER (PARTITION BY user_id ORDER BY month) AS prev, avg(f) OVER (PARTITION BY user_id ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mean FROM m)
SELECT round(sqrt(avg((f - prev) * (f - prev))), 3) AS rmse_last, round(sqrt(avg((f - mean) * (f - mean))), 3) AS rmse_mean, count(*) AS rows FROM r WHERE k BETWEEN 2 AND 8""")
def baselines(spark, sf):
    out = models.next_step_baselines(ft.prefix_windows(sequences(spark, sf), 8), 1)
    return out.select(F.round(F.sqrt("mse_last"), 3).alias("rmse_last"), F.round(F.sqrt("mse_mean"), 3).alias("rmse_mean"), "rows")


def _sql_forecast(i, f):
    """Root mean squared error by step of feature ``f``, number ``i``."""
    inputs = ", ".join([*(f"CASE WHEN {j} < step THEN seq[{j + 1}].{f} ELSE 0 END AS f{j}" for j in range(7)), "CAST(step AS DOUBLE) AS f7", "CAST(1 AS DOUBLE) AS f8"])
    guess = " + ".join(f"f{j} * x{j}" for j in range(9))
    return (f"t{i} AS MATERIALIZED (SELECT step, own, seq[step + 1].{f} AS y, {inputs} FROM w), fit{i} AS (SELECT * FROM t{i} WHERE own > 0), {_sql_ridge(f'm{i}', f'fit{i}', 9)}",
            f"SELECT {i} AS feature, CAST(step AS INTEGER) AS step, round(sqrt(avg((y - ({guess})) * (y - ({guess})))), 2) AS rmse, count(*) AS rows FROM t{i}, m{i} WHERE own = 0 GROUP BY step")


_FORECASTS = [_sql_forecast(i, f) for i, f in enumerate(FEATURES)]


@query("R5_next_step_forecast", f"""{SQL_MONTHLY}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY month) AS k FROM m),
q AS (SELECT user_id, list(struct_pack(f1 := f1, f2 := f2, f3 := f3, f4 := f4) ORDER BY k) AS seq FROM r WHERE k <= 8 GROUP BY 1),
w AS MATERIALIZED (SELECT seq, unnest(range(1, len(seq))) AS step, {sql_hash(17, 'user_id')} % 5 AS own FROM q WHERE len(seq) >= 2),
{', '.join(ctes for ctes, _ in _FORECASTS)} {' UNION ALL '.join(select for _, select in _FORECASTS)}""")
def forecast(spark, sf):
    windows = cut_lineage(ft.prefix_windows(sequences(spark, sf), 8))
    fit, held_out = parted(windows, "user_id")
    scored = None
    for feature in range(len(windows.select("target").first()["target"])):
        weights = models.next_step_regression(fit, feature)
        rows = models.next_step_rows(held_out, feature)
        part = rows.select(F.lit(feature).alias("feature"), "step", "label", models.linear_score(weights, F.col("features")).alias("prediction"))
        scored = part if scored is None else scored.unionByName(part)
    return scored.groupBy("feature", "step").agg(F.round(F.sqrt(F.avg((F.col("label") - F.col("prediction")) ** 2)), 2).alias("rmse"), F.count(F.lit(1)).alias("rows"))
