"""Retrieval jobs made of several operators: recommendation, tag expansion, cache, cascade, index build."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankweave.functions.text import tokenize_space
from rankweave.functions.vectors import add_scaled, dot, l2_normalize
from rankweave.operators import fusion, knn
from rankweave.operators import lexical as lx
from rankweave.session import cut_lineage


def recommend(requests: DataFrame, queries: DataFrame, items: DataFrame, profiles: DataFrame, model: Column, semantic_k: int = 10, top: int = 3) -> DataFrame:
    """Semantic top ``semantic_k`` once per distinct query, then the model score per request.

    ``requests`` has request_id, user_id, query_id. ``model`` reads ``semantic``, item and profile
    columns; a user without a profile keeps the semantic order.
    """
    asked = queries.join(requests.select(F.col("query_id").alias("id")).distinct(), "id", "left_semi")
    found = knn.exact_topk(asked, items, semantic_k).select("query_id", "item_id", F.col("score").alias("semantic"))
    described = found.join(items.drop("vec").withColumnRenamed("id", "item_id"), "item_id")
    joined = requests.join(described, "query_id").join(profiles.withColumn("__known", F.lit(True)), "user_id", "left")
    scored = joined.withColumn("score", F.coalesce(F.when(F.col("__known"), model), F.col("semantic")))
    return lx.top_k(scored, top, query="request_id", item="item_id").select("request_id", "user_id", "item_id", "semantic", "score", "rank")


def cross_score_rank(requests: DataFrame, users: DataFrame, queries: DataFrame, items: DataFrame, weight: float = 0.5) -> DataFrame:
    """Rank of each request's target item under the vector user + weight * query, among all unique items."""
    u = users.select(F.col("id").alias("user_id"), F.col("vec").alias("u"))
    q = queries.select(F.col("id").alias("query_id"), F.col("vec").alias("q"))
    t = items.select(F.col("id").alias("target_id"), F.col("vec").alias("t"))
    mixed = requests.join(u, "user_id").join(q, "query_id").join(t, "target_id").select(
        F.col("request_id").alias("id"), add_scaled(F.col("u"), F.col("q"), weight).alias("vec"), "t")
    return knn.target_rank(mixed.withColumn("target_score", dot(F.col("vec"), F.col("t"))).drop("t"), items).withColumnRenamed("query_id", "request_id")


def _held_by_pairs(combos: DataFrame, item_tags: DataFrame, k: int) -> DataFrame:
    """(combo, item_id, held, popularity): every item that has a tag of a combination, the ``k`` best of those that hold the same tags."""
    wanted = combos.select("combo", F.explode("combo").alias("tag"))
    held = item_tags.join(wanted, "tag").groupBy("combo", "item_id").agg(F.array_sort(F.collect_set("tag")).alias("held"), F.max("popularity").alias("popularity"))
    # items that hold the same tags of a combination differ only by popularity: its k best are enough
    best = Window.partitionBy("combo", "held").orderBy(F.col("popularity").desc(), "item_id")
    return held.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")


def _held_by_sets(combos: DataFrame, items: DataFrame, n_tags: int, k: int) -> DataFrame:
    """As ``_held_by_pairs``, without items that cannot be among a query's ``k`` best; no similarity may be negative.

    An item is listed once per set of its tags that lies in some combination, however many combinations share that set; an item
    beyond the k most popular ones of its set has k others before it, which hold the same tags and maybe more.
    """
    order = [F.col("popularity").desc(), F.col("item_id")]

    def head(df: DataFrame, key: str) -> DataFrame:
        return df.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("r") <= k).drop("r")

    def chosen(combo: str):
        masks = F.sequence(F.lit(1), (F.pow(F.lit(2), F.size(combo)) - 1).cast("int"))
        return F.transform(masks, lambda m: F.filter(combo, lambda t, i: F.getbit(m, i) == 1))

    parts = combos.select("combo", F.explode(chosen("combo")).alias("part"))
    wanted = cut_lineage(parts.select("part").distinct())
    # items of equal tag sets differ only by popularity; a set grows by a later tag as long as the result is in some combination
    rows = cut_lineage(head(items, "tags")).withColumn("part", F.array().cast(items.schema["tags"].dataType))
    listed = None
    for _ in range(n_tags):
        later = F.filter("tags", lambda t: F.coalesce(t > F.try_element_at("part", F.lit(-1)), F.lit(True)))
        grown = rows.withColumn("tag", F.explode(later)).withColumn("part", F.concat("part", F.array("tag"))).drop("tag")
        rows = grown.join(wanted, "part", "left_semi")
        best = head(rows, "part")
        listed = best if listed is None else listed.unionByName(best)
    found = parts.join(listed, "part").select("combo", "item_id", F.array_intersect("combo", "tags").alias("held"), "popularity")
    return found.dropDuplicates(["combo", "item_id"])


#: tags of a combination at most whose sets are all listed
SET_TAGS = 8


def tag_retrieve(queries: DataFrame, tags: DataFrame, item_tags: DataFrame, n_tags: int, k: int) -> DataFrame:
    """Query vector to its nearest tags to the items that carry them, best similarity sum first, then popularity.

    Exact without pairing every query with every item of a frequent tag. Items of several popularities, and combinations with a
    negative similarity, where more tags are no better, are looked up pair by pair.
    """
    near = cut_lineage(knn.exact_topk(queries, tags, n_tags).select("query_id", F.col("item_id").alias("tag"), F.round("score", 12).alias("similarity")))
    # queries with the same nearest tags share one look-up; at most n_tags values are collected per query
    combos = cut_lineage(near.groupBy("query_id").agg(F.array_sort(F.collect_list("tag")).alias("combo"), (F.min("similarity") >= 0).alias("more_is_better")))
    asked = combos.groupBy("combo").agg(F.min("more_is_better").alias("more_is_better"))
    asked = cut_lineage(asked.withColumn("more_is_better", F.col("more_is_better") & F.lit(n_tags <= SET_TAGS)))
    held = item_tags.select("item_id", "tag", "popularity").join(near.select("tag").distinct(), "tag", "left_semi")
    pops = [F.min("popularity").alias("least"), F.max("popularity").alias("popularity"), F.count("popularity").alias("known"), F.count(F.lit(1)).alias("n")]
    items = cut_lineage(held.groupBy("item_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"), *pops))
    even = ((F.col("least") == F.col("popularity")) & (F.col("known") == F.col("n"))) | (F.col("known") == 0)
    uneven = items.where(~F.coalesce(even, F.lit(False))).select(F.col("item_id").alias("i"))
    by_set = asked.where("more_is_better").select("combo")
    kept = _held_by_sets(by_set, items.where(even).select("item_id", "tags", "popularity"), n_tags, k)
    kept = kept.unionByName(_held_by_pairs(by_set, held.join(uneven, F.col("item_id").eqNullSafe(F.col("i")), "left_semi"), k))
    kept = kept.unionByName(_held_by_pairs(asked.where("not more_is_better").select("combo"), held, k))
    listed = near.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("tag", "similarity"))).alias("similar")).join(combos.drop("more_is_better"), "query_id")
    joined = listed.join(kept, "combo")
    score = F.aggregate("held", F.lit(0.0).cast("double"), lambda s, t: s + F.element_at(F.col("similar"), t))
    scored = joined.select("query_id", "item_id", score.alias("score"), "popularity")
    return lx.top_k(scored, k, item="item_id", first=[F.round("score", 9).desc(), F.col("popularity").desc()])


def cache_lookup(queries: DataFrame, cache: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Level 1 equal key, level 2 nearest cached vector above ``threshold``, level 3 no hit.

    Both sides have id, key, vec. Only queries that missed level 1 are searched by vector.
    """
    keyed = cache.groupBy("key").agg(F.min("id").alias("hit"))
    first = queries.join(keyed, "key", "left")
    missed = first.where(F.col("hit").isNull()).select("id", l2_normalize(F.col("vec")).alias("vec")).where(F.col("vec").isNotNull())
    unit = cache.select("id", l2_normalize(F.col("vec")).alias("vec")).where(F.col("vec").isNotNull())
    near = knn.exact_topk(missed, unit, 1).where(F.col("score") > threshold).select(F.col("query_id").alias("id"), F.col("item_id").alias("near"), "score")
    return first.drop("vec", "key").join(near, "id", "left").select(
        "id",
        F.when(F.col("hit").isNotNull(), 1).when(F.col("near").isNotNull(), 2).otherwise(3).alias("level"),
        F.coalesce("hit", "near").alias("cached_id"),
        F.when(F.col("hit").isNotNull(), F.lit(1.0)).otherwise(F.col("score")).alias("score"),
    )


def overlap_ranker(query_text: str = "query_text", item_text: str = "item_text") -> Column:
    """Default ranker: number of shared distinct words."""
    return F.size(F.array_intersect(tokenize_space(F.col(query_text)), tokenize_space(F.col(item_text)))).cast("double")


def run_cascade(config: Mapping, docs: DataFrame, queries: DataFrame, retrievers: Mapping[str, Callable[[DataFrame, DataFrame, int], DataFrame]]) -> DataFrame:
    """Compose the retrievers, fusion and ranker that a use-case config names.

    config: {"retrievers": {name: weight}, "candidates": n, "top_k": n, "flag": name or None,
    "ranker": None or {"k": n, "fn": Column or batch function}}
    """
    unknown = set(config["retrievers"]) - set(retrievers)
    if unknown:
        raise ValueError(f"unknown retrievers: {sorted(unknown)}")
    lists = {name: retrievers[name](docs, queries, config["candidates"]) for name in config["retrievers"]}
    pooled = fusion.union_rankings(lists)
    if config.get("flag"):
        fused = fusion.pooled_fuse(pooled, config["flag"], config["top_k"])
    else:
        fused = fusion.rrf_fuse(pooled, config["top_k"], weights=config["retrievers"])
    spec = config.get("ranker")
    if not spec:
        return fused.select("query_id", "item_id", "score", "rank")

    def texts(head: DataFrame) -> DataFrame:
        return head.join(docs.select(F.col("doc_id").alias("item_id"), F.col("text").alias("item_text")), "item_id").join(
            queries.select("query_id", F.col("text").alias("query_text")), "query_id")

    head = fusion.rerank(fused, spec["k"], texts, spec["fn"])
    none = head.limit(0)
    return fusion.final_merge(none, head, fused, config["top_k"])


#: files that a stored table is cut into by the hash of its key
BUCKETS = 64


def write_clustered(table: DataFrame, path: str, key: str, buckets: int = BUCKETS, name: str | None = None) -> str:
    """Write ``table`` clustered by a unique ``key``: one file a bucket, sorted inside. Returns the path.

    With a ``name`` the table is also known to the catalogue with its buckets, so joins of two such tables on their keys are
    planned without a shuffle.
    """
    placed = table.repartition(buckets, key).sortWithinPartitions(key)
    if name is None:
        placed.write.mode("overwrite").parquet(path)
    else:
        placed.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return path


def build_lexical_index(docs: DataFrame, path: str, prefix: str | None = None, buckets: int = BUCKETS) -> str:
    """Store a BM25 index: one row a document with its terms and counts, the terms, and the corpus statistics.

    A search reads the document rows where they lie (see ``postings``), so it shuffles no posting.
    """
    index = lx.bm25_index(docs, "text")
    named = lambda part: f"{prefix}_lexical_{part}" if prefix else None
    write_clustered(index.lists, f"{path}/lexical_documents", "doc_id", buckets, named("documents"))
    write_clustered(index.terms, f"{path}/lexical_terms", "term", buckets, named("terms"))
    stats = [(index.mean_length, index.k1, index.b)]
    docs.sparkSession.createDataFrame(stats, "mean_length double, k1 double, b double").write.mode("overwrite").parquet(f"{path}/lexical_stats")
    return path


def open_lexical_index(spark: SparkSession, path: str) -> lx.Bm25Index:
    stats = spark.read.parquet(f"{path}/lexical_stats").first()
    return lx.Bm25Index(spark.read.parquet(f"{path}/lexical_documents"), spark.read.parquet(f"{path}/lexical_terms"), stats["mean_length"], stats["k1"], stats["b"])


def build_indices(docs: DataFrame, item_tags: DataFrame, vectors: DataFrame, tag_vectors: DataFrame, cache: DataFrame, path: str,
                  prefix: str | None = None, buckets: int = BUCKETS) -> Mapping[str, str]:
    """Write the lexical, dense, inverse-tag, tag-vector and cache tables; returns their paths.

    Tables with a unique key are clustered by it, and with a ``prefix`` registered as bucketed tables ``{prefix}_{name}``. The
    inverse tag index is sorted by tag instead: a bucket would gather a hot tag.
    """
    build_lexical_index(docs, path, prefix, buckets)
    tables = {
        "dense": (vectors.select("id", l2_normalize(F.col("vec")).alias("vec")), "id"),
        "inverse_tag": (fusion.inverse_tag_index(item_tags, "popularity"), None),
        "tag_vector": (tag_vectors.select("id", l2_normalize(F.col("vec")).alias("vec")), "id"),
        "query_cache": (cache, "query_id"),
    }
    for name, (table, key) in tables.items():
        if key is None:
            table.sortWithinPartitions("tag", "part").write.mode("overwrite").parquet(f"{path}/{name}")
        else:
            write_clustered(table, f"{path}/{name}", key, buckets, f"{prefix}_{name}" if prefix else None)
    return {name: f"{path}/{name}" for name in ("lexical_documents", "lexical_terms", "lexical_stats", *tables)}


def dense_retriever(dims: int, names: Sequence[str] = ("doc_id", "text")) -> Callable[[DataFrame, DataFrame, int], DataFrame]:
    """Retriever over feature-hash embeddings of the whole texts."""
    from rankweave.functions.hooks import encode_texts

    def run(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        corpus = encode_texts(docs.select(F.col(names[0]).alias("id"), names[1]), names[1], None, dims=dims, tokenizer=lx.content_tokens)
        asked = encode_texts(queries.select(F.col("query_id").alias("id"), "text"), "text", None, dims=dims, tokenizer=lx.content_tokens)
        return knn.exact_topk(asked, corpus, k)

    return run


def lexical_retriever(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    found = lx.bm25_search_docs(docs, queries, "text", k)
    return found.withColumnRenamed("doc_id", "item_id")


def overlap_retriever(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    return lx.overlap_topk(queries, docs, "text", k).withColumnRenamed("doc_id", "item_id")
