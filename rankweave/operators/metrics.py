"""Evaluation of rankings, classifiers and losses."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave import skew
from rankweave.functions.scalar import log_sigmoid, smooth_l1
from rankweave.functions.vectors import cosine
from rankweave.operators.knn import PLACES, _matrix, pack_blocks

# Rankings are rows (query_id, item_id, rank); truths are rows (query_id, item_id, place), best first from 1.


def ndcg_at_k(ranked: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query_id, dcg, idcg, ndcg) with relevance len(truth) - place + 1."""
    sizes = truth.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    graded = skew.attach(truth, sizes, ["query_id"]).select("query_id", "item_id", "place", (F.col("n") - F.col("place") + 1).alias("rel"))
    ideal = graded.where(F.col("place") <= k).groupBy("query_id").agg(F.sum(F.col("rel") / F.log2(F.col("place") + 1.0)).alias("idcg"))
    gained = ranked.where(F.col("rank") <= k).join(graded, ["query_id", "item_id"]).groupBy("query_id").agg(F.sum(F.col("rel") / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    queries = ranked.select("query_id").union(truth.select("query_id")).distinct()
    out = queries.join(gained, "query_id", "left").join(ideal, "query_id", "left").fillna(0.0, ["dcg", "idcg"])
    return out.withColumn("ndcg", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(F.lit(0.0)))


def _hits(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    return ranked.join(truth.select("query_id", "item_id").distinct(), ["query_id", "item_id"], "left_semi")


def precision_recall_at_k(ranked: DataFrame, truth: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Per query: precision, recall and hit rate at each k; empty truth gives recall 0."""
    sizes = truth.select("query_id", "item_id").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("n_truth"))
    counts = _hits(ranked, truth).groupBy("query_id").agg(*[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks])
    queries = ranked.select("query_id").union(truth.select("query_id")).distinct()
    out = queries.join(counts, "query_id", "left").join(sizes, "query_id", "left").fillna(0)
    columns = []
    for k in ks:
        hit = F.col(f"h{k}")
        columns += [
            (hit / F.lit(float(k)) if k > 0 else F.lit(0.0)).alias(f"precision_{k}"),
            F.when(F.col("n_truth") > 0, hit / F.col("n_truth")).otherwise(F.lit(0.0)).alias(f"recall_{k}"),
            F.when(hit > 0, 1.0).otherwise(0.0).alias(f"hitrate_{k}"),
        ]
    return out.select("query_id", *columns)


def mean_at_k(per_query: DataFrame) -> DataFrame:
    return per_query.agg(*[F.avg(c).alias(c) for c in per_query.columns if c != "query_id"])


def average_precision(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, ap): sum of precision at each hit over the size of the truth.

    Hits are numbered in pieces of the rank, so one very long list is not sorted in one task.
    """
    sizes = truth.select("query_id", "item_id").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("n_truth"))
    numbered = skew.ordinal(_hits(ranked, truth), ["query_id"], [F.col("rank")], F.floor(F.col("rank") / 10_000), "nth")
    gained = numbered.groupBy("query_id").agg(F.sum(F.col("nth") / F.col("rank")).alias("s"))
    queries = ranked.select("query_id").union(truth.select("query_id")).distinct()
    out = queries.join(gained, "query_id", "left").join(sizes, "query_id", "left")
    return out.select("query_id", F.when(F.col("n_truth") > 0, F.coalesce("s", F.lit(0.0)) / F.col("n_truth")).otherwise(F.lit(0.0)).alias("ap"))


def mean_average_precision(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    return average_precision(ranked, truth).agg(F.avg("ap").alias("map"))


def rank_metrics(ranks: DataFrame, ks: Sequence[int] = (10, 50, 100)) -> DataFrame:
    """Recall at each k, MRR and NDCG@10 from the rank of a single relevant item; NaN without rows."""
    r = F.col("rank")
    nan = F.lit(float("nan"))
    return ranks.agg(
        *[F.coalesce(F.avg(F.when(r <= k, 1.0).otherwise(0.0)), nan).alias(f"recall_{k}") for k in ks],
        F.coalesce(F.avg(1.0 / r), nan).alias("mrr"),
        F.coalesce(F.avg(F.when(r <= 10, 1.0 / F.log2(r + 1.0)).otherwise(0.0)), nan).alias("ndcg_10"),
    )


def _batched(pairs: DataFrame, size: int, extra: Sequence[str] = ()) -> DataFrame:
    """Consecutive batches of ``size`` rows by the order column ``id``, packed to one row each."""
    numbered = skew.ordinal(pairs, [], [F.col("id")], skew.coarse_span(pairs, "id"), "n")
    rows = numbered.select(F.floor((F.col("n") - 1) / size).alias("batch"), F.col("n").alias("id"), F.col("anchor_vec").alias("vec"), "positive_vec", *extra)
    return pack_blocks(rows, ["batch"], "q", ["positive_vec", *extra])


def in_batch_ranks(pairs: DataFrame, size: int) -> DataFrame:
    """(batch, rank): rank of each anchor's own positive among the positives of its batch of ``size`` rows.

    ``pairs`` has an integer id that gives the order, anchor_vec and positive_vec. A batch is one
    bounded row and is compared as a matrix in its task.
    """
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                scores = np.round(_matrix(batch["q_vec"][i]) @ _matrix(batch["q_positive_vec"][i]).T, PLACES)
                rank = (scores > np.diag(scores)[:, None]).sum(axis=1).astype(np.int64) + 1
                yield pa.RecordBatch.from_arrays([pa.array([batch["batch"][i].as_py()] * len(rank), pa.int64()), pa.array(rank)], ["batch", "rank"])

    return _batched(pairs, size).select("batch", "q_vec", "q_positive_vec").mapInArrow(run, "batch bigint, rank bigint")


def in_batch_report(ranks: DataFrame, size: int, ks: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    return ranks.agg(*[F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"accuracy_{k}") for k in ks if k <= size], F.avg(1.0 / F.col("rank")).alias("mrr"))


def in_batch_softmax_loss(pairs: DataFrame, size: int, temperature: float = 0.05, negatives: str | None = None) -> DataFrame:
    """(batch, loss, n): cross-entropy of the own positive among all positives, and all ``negatives`` lists, of the batch."""
    extra = [negatives] if negatives else []

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                q = _matrix(batch["q_vec"][i])
                candidates = _matrix(batch["q_positive_vec"][i])
                if negatives:
                    flat = batch[f"q_{negatives}"][i].values.flatten()
                    if len(flat):
                        candidates = np.vstack([candidates, flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)])
                logits = q @ candidates.T / temperature
                top = logits.max(axis=1, keepdims=True)
                log_sum = top[:, 0] + np.log(np.exp(logits - top).sum(axis=1))
                loss = float((log_sum - np.diag(logits[:, : len(q)])).mean())
                yield pa.RecordBatch.from_arrays([pa.array([batch["batch"][i].as_py()], pa.int64()), pa.array([loss]), pa.array([len(q)], pa.int64())], ["batch", "loss", "n"])

    columns = ["batch", "q_vec", "q_positive_vec", *[f"q_{c}" for c in extra]]
    return _batched(pairs, size, extra).select(columns).mapInArrow(run, "batch bigint, loss double, n bigint")


def auc(scored: DataFrame, score: str = "score", label: str = "label", pieces: int = 512) -> DataFrame:
    """Rank-sum AUC with average ranks on ties; NaN for one class. Scores may have any size and sign.

    Rows are merged per distinct score first; the running count goes over pieces of the scores, ``pieces`` for each
    doubling of the size, so very small probabilities and logits are spread as well.
    """
    counts = scored.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) > 0.5).alias("p"))
    size = F.floor((F.log2(F.greatest(F.abs(F.col("s")), F.lit(1e-300))) + 1000) * pieces)
    running = skew.running_count(counts, [], [F.col("s")], F.when(F.col("s") < 0, -size).otherwise(size), F.col("n"), "upto")
    mean_rank = F.col("upto") - F.col("n") + (F.col("n") + 1) / 2
    sums = running.agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum(F.col("p") * mean_rank).alias("ranks"))
    neg = F.col("n") - F.col("p")
    value = (F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * neg)
    return sums.select(F.when((F.col("p") > 0) & (neg > 0), value).otherwise(F.lit(float("nan"))).alias("auc"))


def logloss(p: Column, y: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7))
    return F.avg(-(y * F.ln(q) + (1.0 - y) * F.ln(1.0 - q)))


def binary_accuracy(p: Column, y: Column) -> Column:
    return F.avg(F.when((p >= 0.5) == (y >= 0.5), 1.0).otherwise(0.0))


def class_accuracy(predicted: Column, truth: Column) -> Column:
    return F.avg(F.when(predicted == truth, 1.0).otherwise(0.0))


def ranker_report(scored: DataFrame) -> DataFrame:
    """AUC, log-loss and accuracy for clicks on all rows and for completion on clicked rows.

    Needs clicked, completed, p_click, p_completion.
    """
    def block(rows: DataFrame, task: str, p: str, y: str) -> DataFrame:
        values = rows.agg(F.count(F.lit(1)).alias("n"), logloss(F.col(p), F.col(y)).alias("logloss"), binary_accuracy(F.col(p), F.col(y)).alias("accuracy"))
        return values.select(F.lit(task).alias("task"), "n", auc(rows, p, y).scalar().alias("auc"), "logloss", "accuracy")

    return block(scored, "ctr", "p_click", "clicked").unionByName(block(scored.where(F.col("clicked") >= 0.5), "completion", "p_completion", "completed"))


def pair_accuracy(pairs: DataFrame, positive: str = "pos_score", negative: str = "neg_score") -> DataFrame:
    return pairs.agg(F.avg(F.when(F.col(positive) > F.col(negative), 1.0).otherwise(0.0)).alias("pair_accuracy"))


def triplet_accuracy(triplets: DataFrame) -> DataFrame:
    """Share of rows (anchor_vec, positive_vec, negative_vec) whose positive is nearer by cosine."""
    near = F.round(cosine(F.col("anchor_vec"), F.col("positive_vec")), PLACES) > F.round(cosine(F.col("anchor_vec"), F.col("negative_vec")), PLACES)
    return triplets.agg(F.avg(F.when(near, 1.0).otherwise(0.0)).alias("triplet_accuracy"))


def bpr_loss(pairs: DataFrame, positive: str = "pos_score", negative: str = "neg_score") -> DataFrame:
    return pairs.agg(F.avg(-log_sigmoid(F.col(positive) - F.col(negative))).alias("bpr_loss"))


def kl_divergence(rows: DataFrame, p: str = "p", q: str = "q") -> DataFrame:
    """Mean over rows of sum p * ln(p / q) for array columns."""
    each = F.aggregate(F.zip_with(p, q, lambda a, b: F.when(a > 0, a * F.ln(a / b)).otherwise(F.lit(0.0))), F.lit(0.0).cast("double"), lambda s, x: s + x)
    return rows.agg(F.avg(each).alias("kl"))


def smooth_l1_loss(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Mean over all elements of two array columns."""
    each = F.aggregate(F.zip_with(x, y, lambda a, b: smooth_l1(a.cast("double"), b.cast("double"))), F.lit(0.0).cast("double"), lambda s, v: s + v)
    return rows.agg((F.sum(each) / F.sum(F.size(x))).alias("smooth_l1"))
