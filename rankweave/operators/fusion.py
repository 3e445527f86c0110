"""Combining rankings and cutting them off. Rankings are rows (query_id, item_id, score, rank)."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave import skew
from rankweave.functions.hooks import map_batch
from rankweave.operators.lexical import top_k

RRF_K = 60  # fixed value of reciprocal rank fusion


def union_rankings(rankings: Mapping[str, DataFrame]) -> DataFrame:
    out = None
    for name, ranking in rankings.items():
        part = ranking.select("query_id", "item_id", "rank", F.lit(name).alias("source"))
        out = part if out is None else out.unionByName(part)
    return out


def rrf_scores(ranked: DataFrame, k: int = RRF_K, weights: Mapping[str, float] | None = None, flag: str | None = None) -> DataFrame:
    """Sum of weight / (k + rank) per (query, item); ``in_flag`` tells whether source ``flag`` found it."""
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    aggs = [F.sum(weight / (F.lit(float(k)) + F.col("rank"))).alias("score"), F.count(F.lit(1)).alias("n_sources")]
    if flag is not None:
        aggs.append(F.max((F.col("source") == flag).cast("int")).alias("in_flag"))
    return ranked.groupBy("query_id", "item_id").agg(*aggs)


def rrf_fuse(ranked: DataFrame, top: int, k: int = RRF_K, weights: Mapping[str, float] | None = None) -> DataFrame:
    return top_k(rrf_scores(ranked, k, weights), top, item="item_id")


def pooled_fuse(ranked: DataFrame, flag: str, top: int, k: int = RRF_K) -> DataFrame:
    """Items that source ``flag`` also found come first; each pool is ordered by its fused score."""
    return top_k(rrf_scores(ranked, k, flag=flag), top, item="item_id", first=[F.col("in_flag").desc()])


def final_merge(exact: DataFrame, reranked: DataFrame, fused: DataFrame, top: int) -> DataFrame:
    """Exact matches, then the re-ranked head, then the rest of the fused list, each item once."""
    stages = None
    for stage, part in enumerate((exact, reranked, fused)):
        rows = part.select("query_id", "item_id", F.struct(F.lit(stage).alias("stage"), F.col("rank").cast("long").alias("place")).alias("p"))
        stages = rows if stages is None else stages.unionByName(rows)
    best = stages.groupBy("query_id", "item_id").agg(F.min("p").alias("p"))
    order = Window.partitionBy("query_id").orderBy("p", "item_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "item_id", F.col("p.stage").alias("stage"), "rank")


def adaptive_k(ranked: DataFrame, min_k: int = 1, max_k: int | None = None, query: str = "query_id", queries: DataFrame | None = None) -> DataFrame:
    """Length at which to cut each score list: the largest gap to the next score, weighted by the score.

    ``queries`` names all queries: one without any result is cut at 0.
    The list is read by ``rank``; the next score comes from an equi-join on rank + 1, so a very
    long list is not sorted in one task.
    """
    if min_k < 1:
        raise ValueError("min_k must be at least 1")
    rows = ranked if max_k is None else ranked.where(F.col("rank") <= max_k)
    here = rows.select(query, "rank", "score")
    after = here.select(query, (F.col("rank") - 1).alias("rank"), F.col("score").alias("next"))
    gap = F.round((F.col("score") - F.col("next")) * F.col("score"), 12)
    joined = here.join(after, [query, "rank"], "left")
    usable = F.col("next").isNotNull() & (F.col("rank") >= min_k)
    cut = joined.groupBy(query).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(usable, F.struct((-gap).alias("g"), F.col("rank").alias("r"))))["r"].alias("elbow"),
    ).select(query, F.when(F.col("n") <= min_k, F.col("n")).otherwise(F.coalesce("elbow", F.lit(min_k))).cast("long").alias("k"))
    if queries is None:
        return cut
    return queries.select(query).distinct().join(cut, query, "left").select(query, F.coalesce("k", F.lit(0).cast("long")).alias("k"))


def cut_at_k(ranked: DataFrame, chosen: DataFrame, query: str = "query_id") -> DataFrame:
    return ranked.join(chosen, query).where(F.col("rank") <= F.col("k"))


def inverse_tag_index(item_tags: DataFrame, popularity: str, size: int = 1000) -> DataFrame:
    """(tag, part, items): the items of a tag by falling popularity, then id, in parts of at most ``size``.

    Places come from ranges over (tag, popularity, item), so neither a hot tag nor a popularity that very many
    items share is gathered in one task.
    """
    pairs = item_tags.groupBy("tag", "item_id").agg(F.max(popularity).alias("pop"))
    placed = skew.numbered(pairs, [F.col("pop").desc(), F.col("item_id")], "place", ["tag"])
    return skew.pack_numbered(placed, ["tag"], F.col("item_id"), F.col("place"), "items", size)


def rerank(ranked: DataFrame, k: int, texts: Callable[[DataFrame], DataFrame], ranker: Callable[[list], list] | Column) -> DataFrame:
    """Re-score the first ``k`` of each query; ``retrieval_score`` stays beside ``ranker_score``.

    ``texts`` adds query_text and item_text. ``ranker`` is a Column, or a batch function over
    (query_text, item_text) pairs; a pair it fails on keeps its retrieval score.
    """
    head = texts(ranked.where(F.col("rank") <= k).select("query_id", "item_id", F.col("score").alias("retrieval_score")))
    if isinstance(ranker, Column):
        scored = head.withColumn("ranker_score", ranker.cast("double"))
    else:
        scored = map_batch(head, ["query_text", "item_text"], ranker, "ranker_score", "double")
    filled = scored.withColumn("score", F.coalesce("ranker_score", "retrieval_score"))
    return top_k(filled, k, item="item_id").select("query_id", "item_id", "retrieval_score", "ranker_score", "rank")


