"""Vector retrieval, fusion and cut-off queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankweave.catalog.base import q6, query, r6, sql_md5, table
from rankweave.catalog.text import SQL_BM25, SQL_SPACE, SQL_WORDS, benchmark, bm25_ranking, documents
from rankweave.functions.hooks import encode_texts
from rankweave.functions.vectors import cosine, l2_normalize
from rankweave.operators import fusion, knn
from rankweave.operators import lexical as lx
from rankweave.plans import retrieval as rt
from rankweave.session import cut_lineage, shared_folder


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


SQL_V = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, label, count(*) OVER () AS n FROM embeddings)"
SQL_ALL = f"{SQL_V}, sims AS (SELECT a.id AS query_id, b.id AS item_id, list_dot_product(a.vec, b.vec) AS score, b.label FROM v a, v b)"


@query("V1_l2_normalize", f"""WITH {SQL_V}, x AS (SELECT id, list_transform(vec, lambda x: x * (id + 1)) AS w FROM v)
SELECT id, CAST(unnest(range(len(w))) AS INTEGER) AS dim, {q6('unnest(list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))))')} AS value FROM x""")
def normalize(spark, sf):
    scaled = vectors(spark, sf).select("id", l2_normalize(F.transform("vec", lambda x: x.cast("double") * (F.col("id") + 1))).alias("u"))
    return scaled.select("id", F.posexplode("u").alias("dim", "x")).select("id", "dim", r6("x").alias("value"))


@query("V2_exact_topk", f"WITH {SQL_ALL} SELECT query_id, item_id, {q6('score')} AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM sims QUALIFY rank <= 20")
def exact_topk(spark, sf):
    v = vectors(spark, sf)
    return knn.exact_topk(v, v, 20).withColumn("score", r6("score"))


@query("V3_ann_topk", f"""WITH {SQL_V},
p AS (SELECT id, vec, row_number() OVER (ORDER BY id) - 1 AS cell FROM (SELECT id, vec FROM v ORDER BY {sql_md5(7, 'id')} LIMIT 32)),
near AS (SELECT v.id, cell, row_number() OVER (PARTITION BY v.id ORDER BY round(list_dot_product(v.vec, p.vec), 9) DESC, cell) AS r FROM v, p),
c AS (SELECT q.id AS query_id, m.id AS item_id FROM near q JOIN near m ON q.cell = m.cell AND q.r <= 8 AND m.r = 1)
SELECT query_id, item_id, {q6('list_dot_product(a.vec, b.vec)')} AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(a.vec, b.vec), 9) DESC, item_id) AS rank
FROM c JOIN v a ON a.id = query_id JOIN v b ON b.id = item_id QUALIFY rank <= 10""")
def ann(spark, sf):
    v = vectors(spark, sf)
    return knn.ann_topk(v, v, 10, pivots=32, probes=8).withColumn("score", r6("score"))


@query("V3_ann_recall", f"""WITH {SQL_V},
p AS (SELECT id, vec, row_number() OVER (ORDER BY id) - 1 AS cell FROM (SELECT id, vec FROM v ORDER BY {sql_md5(7, 'id')} LIMIT 32)),
near AS MATERIALIZED (SELECT v.id, cell, row_number() OVER (PARTITION BY v.id ORDER BY round(list_dot_product(v.vec, p.vec), 9) DESC, cell) AS r FROM v, p),
t AS (SELECT a.id AS q, b.id AS item, row_number() OVER (PARTITION BY a.id ORDER BY round(list_dot_product(a.vec, b.vec), 9) DESC, b.id) AS o FROM v a, v b WHERE a.id % 100 = 0 QUALIFY o <= 10),
w AS (SELECT o.r FROM t JOIN near h ON h.id = t.item AND h.r = 1 JOIN near o ON o.id = t.q AND o.cell = h.cell)
SELECT CAST(n AS INTEGER) AS probes, {q6('(SELECT count(*) FROM w WHERE r <= n) / (SELECT count(*) FROM w)')} AS recall FROM (SELECT unnest(range(1, (SELECT count(*) + 1 FROM p))) AS n)""")
def ann_recall(spark, sf):
    v = vectors(spark, sf)
    return knn.probe_recall(v.where(F.col("id") % 100 == 0), v, 10, pivots=32).withColumn("recall", r6("recall"))


@query("V4_pairwise_paired_cosine", f"WITH {SQL_V} SELECT a.id, {q6('list_cosine_similarity(a.vec, b.vec)')} AS score FROM v a JOIN v b ON b.id = (a.id + 1) % a.n")
def paired(spark, sf):
    v = vectors(spark, sf)
    n = v.agg(F.count(F.lit(1))).scalar()
    left = v.select("id", "vec").withColumn("other", (F.col("id") + 1) % n)
    right = v.select(F.col("id").alias("other"), F.col("vec").alias("b"))
    return left.join(right, "other").select("id", r6(cosine(F.col("vec"), F.col("b"))).alias("score"))


@query("V5_similarity_self_join", f"WITH {SQL_V}, s AS (SELECT a.id AS src, b.id AS dst, list_cosine_similarity(a.vec, b.vec) AS score FROM v a JOIN v b ON a.id < b.id) SELECT src, dst, {q6('round(score, 9)')} AS score FROM s WHERE round(score, 9) > 0.35")
def self_join(spark, sf):
    return knn.similar_pairs(vectors(spark, sf), 0.35, copies=True).withColumn("score", r6("score"))


@query("V6_filtered_topk", f"WITH {SQL_ALL} SELECT query_id, item_id, {q6('score')} AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM sims WHERE label = 3 QUALIFY rank <= 5")
def filtered(spark, sf):
    v = vectors(spark, sf)
    return knn.filtered_topk(v, v, 5, F.col("label") == 3).withColumn("score", r6("score"))


@query("V7_two_stage_rank", f"""WITH {SQL_ALL},
prof AS (SELECT o_custkey AS user_id, max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS urgent, avg(month(o_orderdate)) AS order_month FROM orders GROUP BY 1),
req AS (SELECT c_custkey AS request_id, c_custkey AS user_id, c_custkey % (SELECT count(*) FROM v) AS query_id FROM customer),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS r FROM sims QUALIFY r <= 10),
s AS (SELECT request_id, req.user_id, item_id, score AS semantic, CASE WHEN prof.user_id IS NULL THEN score ELSE score * (1 + urgent) - CAST(0.01 AS DOUBLE) * label * order_month END AS score
 FROM req JOIN top USING (query_id) LEFT JOIN prof ON prof.user_id = req.user_id)
SELECT request_id, user_id, item_id, {q6('semantic')} AS semantic, {q6('score')} AS score, row_number() OVER (PARTITION BY request_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM s QUALIFY rank <= 3""")
def two_stage(spark, sf):
    v = vectors(spark, sf)
    n = v.agg(F.count(F.lit(1))).scalar()
    requests = table(spark, sf, "customer").select(F.col("c_custkey").alias("request_id"), F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % n).alias("query_id"))
    profiles = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.max((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("urgent"), F.avg(F.month("o_orderdate")).alias("order_month"))
    model = F.col("semantic") * (1 + F.col("urgent")) - 0.01 * F.col("label") * F.col("order_month")
    out = rt.recommend(requests, v.select("id", "vec"), v, profiles, model)
    return out.withColumns({"semantic": r6("semantic"), "score": r6("score")})


def target_requests(v):
    n = v.agg(F.count(F.lit(1))).scalar()
    return v.select(F.col("id").alias("request_id"), F.col("id").alias("user_id"), ((F.col("id") + 1) % n).alias("query_id"), ((F.col("id") + 3) % n).alias("target_id"))


SQL_RANKS = f"""{SQL_V}, m AS (SELECT a.id AS request_id, list_transform(list_zip(a.vec, b.vec), lambda z: z[1] + CAST(0.5 AS DOUBLE) * z[2]) AS vec, (a.id + 3) % a.n AS target FROM v a JOIN v b ON b.id = (a.id + 1) % a.n),
g AS (SELECT m.*, round(list_dot_product(m.vec, t.vec), 9) AS goal FROM m JOIN v t ON t.id = target),
ranks AS (SELECT request_id, 1 + count(*) FILTER (round(list_dot_product(g.vec, v.vec), 9) > goal) AS rank FROM g, v GROUP BY 1)"""


@query("V8_cross_score_rank", f"WITH {SQL_RANKS} SELECT request_id, rank FROM ranks")
def cross_rank(spark, sf):
    v = vectors(spark, sf).select("id", "vec")
    return rt.cross_score_rank(target_requests(v), v, v, v)


SQL_LISTS = f"""{SQL_BM25},
ov AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, doc_id) AS rank
 FROM (SELECT DISTINCT item_id AS query_id, unnest({SQL_SPACE}) AS term FROM benchmark) q JOIN (SELECT DISTINCT doc_id, unnest({SQL_SPACE}) AS term FROM documents) d USING (term) GROUP BY 1, 2),
lists AS (SELECT query_id, doc_id AS item_id, rank, 'bm25' AS source FROM bm_ranked WHERE rank <= 30 UNION ALL SELECT query_id, doc_id, rank, 'overlap' FROM ov WHERE rank <= 30),
fused AS (SELECT query_id, item_id, sum(CAST(1 AS DOUBLE) / (60 + rank)) AS score, count(*) AS n_sources, max(CAST(source = 'overlap' AS INTEGER)) AS in_flag FROM lists GROUP BY 1, 2)"""


def rankings(spark, sf):
    docs, queries = documents(spark, sf), benchmark(spark, sf)
    return fusion.union_rankings({"bm25": rt.lexical_retriever(docs, queries, 30), "overlap": rt.overlap_retriever(docs, queries, 30)})


@query("V9_rrf_fuse", f"WITH {SQL_LISTS} SELECT query_id, item_id, {q6('score')} AS score, n_sources, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM fused QUALIFY rank <= 20")
def rrf(spark, sf):
    return fusion.rrf_fuse(rankings(spark, sf), 20).withColumn("score", r6("score"))


@query("V10_overlap_pools", f"WITH {SQL_LISTS} SELECT query_id, item_id, {q6('score')} AS score, n_sources, in_flag, row_number() OVER (PARTITION BY query_id ORDER BY in_flag DESC, round(score, 9) DESC, item_id) AS rank FROM fused QUALIFY rank <= 20")
def pools(spark, sf):
    return fusion.pooled_fuse(rankings(spark, sf), "overlap", 20).withColumn("score", r6("score"))


@query("V11_final_merge", f"""WITH {SQL_LISTS},
f AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM fused QUALIFY rank <= 20),
h AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY length(text) DESC, item_id) AS rank FROM f JOIN documents ON doc_id = item_id WHERE rank <= 5),
e AS (SELECT b.item_id AS query_id, doc_id AS item_id, row_number() OVER (PARTITION BY b.item_id ORDER BY doc_id) AS rank FROM benchmark b JOIN documents d ON d.text = b.text),
st AS (SELECT query_id, item_id, min((0, rank)) AS p FROM e GROUP BY 1, 2 UNION ALL SELECT query_id, item_id, min((1, rank)) FROM h GROUP BY 1, 2 UNION ALL SELECT query_id, item_id, min((2, rank)) FROM f GROUP BY 1, 2),
b AS (SELECT query_id, item_id, min(p) AS p FROM st GROUP BY 1, 2)
SELECT query_id, item_id, CAST(p[1] AS INTEGER) AS stage, row_number() OVER (PARTITION BY query_id ORDER BY p, item_id) AS rank FROM b QUALIFY rank <= 20""")
def merge(spark, sf):
    docs, queries = documents(spark, sf), benchmark(spark, sf)
    fused = fusion.rrf_fuse(rankings(spark, sf), 20)
    head = fused.where(F.col("rank") <= 5).join(docs.select(F.col("doc_id").alias("item_id"), F.length("text").alias("size")), "item_id")
    reranked = lx.top_k(head.select("query_id", "item_id", F.col("size").alias("score")), 5, item="item_id")
    equal = docs.join(queries, "text").select("query_id", F.col("doc_id").alias("item_id"), F.lit(1.0).alias("score"))
    return fusion.final_merge(lx.top_k(equal, 20, item="item_id"), reranked, fused, 20)


@query("V12_adaptive_k", f"""WITH {SQL_BM25}, s AS (SELECT query_id, rank, score, lead(score) OVER (PARTITION BY query_id ORDER BY rank) AS nxt, count(*) OVER (PARTITION BY query_id) AS n FROM bm_ranked WHERE rank <= 20),
g AS (SELECT query_id, n, rank, row_number() OVER (PARTITION BY query_id ORDER BY round((score - nxt) * score, 12) DESC NULLS LAST, rank) AS o FROM s WHERE rank >= 2),
k AS (SELECT query_id, max(n) AS n, max(CASE WHEN o = 1 THEN rank END) AS k FROM (SELECT query_id, n, NULL AS rank, NULL AS o FROM s UNION ALL SELECT * FROM g) GROUP BY 1)
SELECT item_id AS query_id, CASE WHEN n IS NULL THEN 0 WHEN n <= 2 THEN n ELSE k END AS k FROM (SELECT DISTINCT item_id FROM benchmark) b LEFT JOIN k ON k.query_id = b.item_id""")
def adaptive(spark, sf):
    return fusion.adaptive_k(bm25_ranking(spark, sf, 20), min_k=2, max_k=20, queries=benchmark(spark, sf))


def part_tags(spark, sf):
    p = table(spark, sf, "part")
    tags = F.array_distinct(F.concat(F.array("p_brand", "p_type"), F.split("p_name", " ")))
    return p.select(F.col("p_partkey").alias("item_id"), F.explode(tags).alias("tag"), F.col("p_retailprice").alias("popularity"))


SQL_TAGS = "it AS (SELECT DISTINCT p_partkey AS item_id, unnest(list_concat([p_brand, p_type], string_split(p_name, ' '))) AS tag, p_retailprice AS popularity FROM part)"


@query("V13_inverse_tag_index", f"""WITH {SQL_TAGS}, r AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY popularity DESC, item_id) AS o FROM it)
SELECT tag, CAST(floor((o - 1) / 1000) AS BIGINT) AS part, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY o) AS items FROM r GROUP BY 1, 2""")
def tag_index(spark, sf):
    out = fusion.inverse_tag_index(part_tags(spark, sf), "popularity")
    return out.withColumn("items", F.array_join(F.transform("items", lambda x: x.cast("string")), ","))


def sql_hash_vectors(name, source, id_col, tokens, dims):
    """Signed feature hashing of token lists, scaled to unit length."""
    return f"""{name}_t AS (SELECT {id_col} AS id, unnest({tokens}) AS tok FROM {source}),
{name}_d AS (SELECT id, CAST('0x' || substr(md5(tok), 1, 8) AS BIGINT) % {dims} AS dim, sum(CASE WHEN CAST('0x' || substr(md5(tok), 9, 1) AS BIGINT) < 8 THEN 1.0::DOUBLE ELSE -1 END) AS x FROM {name}_t GROUP BY 1, 2),
{name} AS (SELECT id, dim, coalesce(x / nullif(sqrt(sum(x * x) OVER (PARTITION BY id)), 0), 0) AS x FROM {name}_d)"""


def tag_vectors(spark, sf):
    tags = part_tags(spark, sf).select(F.col("tag").alias("id")).distinct().withColumn("text", F.col("id"))
    # stored first: the optimizer would otherwise encode every row and drop the copies afterwards
    return encode_texts(cut_lineage(tags), "text", None, dims=64).select("id", "vec")


def name_queries(spark, sf):
    names = table(spark, sf, "part").select(F.concat_ws(" ", "p_type", "p_name").alias("id")).distinct().withColumn("text", F.col("id"))
    return encode_texts(cut_lineage(names), "text", None, dims=64).select("id", "vec")


SQL_HASH_TOKENS = r"regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}_]{{2,}}')"


@query("V14_tag_expand_retrieve", f"""WITH {SQL_TAGS}, tg AS (SELECT DISTINCT tag FROM it), nq AS (SELECT DISTINCT p_type || ' ' || p_name AS q FROM part),
{sql_hash_vectors('tv', 'tg', 'tag', SQL_HASH_TOKENS.format(t='tag'), 64)}, {sql_hash_vectors('qv', 'nq', 'q', SQL_HASH_TOKENS.format(t='q'), 64)},
s AS (SELECT nq.q AS query_id, tg.tag, coalesce(d.s, 0) AS similarity FROM nq CROSS JOIN tg LEFT JOIN (SELECT qv.id AS q, tv.id AS tag, sum(qv.x * tv.x) AS s FROM qv JOIN tv USING (dim) GROUP BY 1, 2) d ON d.q = nq.q AND d.tag = tg.tag),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, tag) AS r FROM s QUALIFY r <= 3),
i AS (SELECT query_id, item_id, sum(similarity) AS score, max(popularity) AS popularity FROM it JOIN n USING (tag) GROUP BY 1, 2)
SELECT query_id, item_id, {q6('score')} AS score, popularity, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, popularity DESC, item_id) AS rank FROM i QUALIFY rank <= 5""")
def tag_expand(spark, sf):
    return rt.tag_retrieve(name_queries(spark, sf), tag_vectors(spark, sf), part_tags(spark, sf), 3, 5).withColumn("score", r6("score"))


@query("T15_exact_and_fuzzy_cache", f"""WITH {SQL_V},
q AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'v' ELSE 'x' END || id AS key, list_transform(vec, lambda x, i: CASE WHEN id % 3 = 1 AND i = 1 THEN x + 0.2::DOUBLE WHEN id % 3 = 2 AND i <= 32 THEN 0.0::DOUBLE ELSE x END) AS vec FROM v),
b AS (SELECT q.id, v.id AS near, list_cosine_similarity(q.vec, v.vec) AS score, row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(q.vec, v.vec), 9) DESC, v.id) AS r FROM q, v WHERE q.id % 3 <> 0 QUALIFY r = 1)
SELECT q.id, CASE WHEN q.id % 3 = 0 THEN 1 WHEN score > 0.95 THEN 2 ELSE 3 END AS level, CASE WHEN q.id % 3 = 0 THEN q.id WHEN score > 0.95 THEN near END AS cached_id,
 {q6('CASE WHEN q.id % 3 = 0 THEN 1 WHEN score > 0.95 THEN score END')} AS score FROM q LEFT JOIN b ON b.id = q.id""")
def cache(spark, sf):
    v = vectors(spark, sf)
    stored = v.select("id", F.concat(F.lit("v"), F.col("id").cast("string")).alias("key"), "vec")
    kind = F.col("id") % 3
    changed = F.transform("vec", lambda x, i: F.when((kind == 1) & (i == 0), x.cast("double") + 0.2).when((kind == 2) & (i < 32), 0.0).otherwise(x.cast("double")))
    asked = v.select("id", F.concat(F.when(kind == 0, "v").otherwise("x"), F.col("id").cast("string")).alias("key"), changed.alias("vec"))
    return rt.cache_lookup(asked, stored).withColumn("score", r6("score"))


RETRIEVERS = {"bm25": rt.lexical_retriever, "overlap": rt.overlap_retriever, "dense": rt.dense_retriever(64)}


@query("V15_config_cascade", f"""WITH {SQL_BM25},
{sql_hash_vectors('dv', 'documents', 'doc_id', SQL_WORDS.format(t='text'), 64)}, {sql_hash_vectors('bv', 'benchmark', 'item_id', SQL_WORDS.format(t='text'), 64)},
dn AS (SELECT bv.id AS query_id, dv.id AS doc_id, row_number() OVER (PARTITION BY bv.id ORDER BY round(sum(bv.x * dv.x), 9) DESC, dv.id) AS rank FROM bv JOIN dv USING (dim) GROUP BY 1, 2 QUALIFY rank <= 30),
lists AS (SELECT query_id, doc_id AS item_id, CAST(2 AS DOUBLE) / (60 + rank) AS s FROM bm_ranked WHERE rank <= 30 UNION ALL SELECT query_id, doc_id, CAST(0.5 AS DOUBLE) / (60 + rank) FROM dn),
fused AS (SELECT query_id, item_id, sum(s) AS score FROM lists GROUP BY 1, 2)
SELECT query_id, item_id, {q6('score')} AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM fused QUALIFY rank <= 20""")
def cascade(spark, sf):
    config = {"retrievers": {"bm25": 2.0, "dense": 0.5}, "candidates": 30, "top_k": 20, "ranker": None}
    return rt.run_cascade(config, documents(spark, sf), benchmark(spark, sf), RETRIEVERS).withColumn("score", r6("score"))


@query("V16_model_rerank", f"""WITH {SQL_LISTS},
f AS (SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM fused QUALIFY rank <= 5),
w AS (SELECT DISTINCT item_id AS query_id, unnest({SQL_SPACE}) AS term FROM benchmark), dw AS (SELECT DISTINCT doc_id AS item_id, unnest({SQL_SPACE}) AS term FROM documents WHERE doc_id IN (SELECT item_id FROM f)),
c AS (SELECT f.query_id, f.item_id, count(*) AS s FROM f JOIN w ON w.query_id = f.query_id JOIN dw ON dw.item_id = f.item_id AND dw.term = w.term GROUP BY 1, 2)
SELECT f.query_id, f.item_id, {q6('score')} AS retrieval_score, CAST(coalesce(s, 0) AS DOUBLE) AS ranker_score, row_number() OVER (PARTITION BY f.query_id ORDER BY coalesce(s, 0) DESC, f.item_id) AS rank FROM f LEFT JOIN c ON c.query_id = f.query_id AND c.item_id = f.item_id""")
def model_rerank(spark, sf):
    docs, queries = documents(spark, sf), benchmark(spark, sf)

    def texts(head):
        return head.join(docs.select(F.col("doc_id").alias("item_id"), F.col("text").alias("item_text")), "item_id").join(queries.select("query_id", F.col("text").alias("query_text")), "query_id")

    def shared_words(pairs):
        return [float(len(set(a.lower().split()) & set(b.lower().split()))) for a, b in pairs]

    return fusion.rerank(fusion.rrf_fuse(rankings(spark, sf), 20), 5, texts, shared_words).withColumn("retrieval_score", r6("retrieval_score"))


@query("V18_build_indices", f"""WITH {SQL_BM25}, {SQL_TAGS}, {SQL_V}
SELECT 'lexical_documents' AS index_name, (SELECT count(*) FROM documents) AS n_rows UNION ALL SELECT 'lexical_stats', 1 UNION ALL SELECT 'lexical_terms', (SELECT count(*) FROM idf) UNION ALL SELECT 'dense', (SELECT count(*) FROM v)
UNION ALL SELECT 'inverse_tag', (SELECT sum(ceil(c / 1000.0))::BIGINT FROM (SELECT count(*) AS c FROM it GROUP BY tag)) UNION ALL SELECT 'tag_vector', (SELECT count(DISTINCT tag) FROM it) UNION ALL SELECT 'query_cache', (SELECT count(*) FROM benchmark)""")
def indices(spark, sf):
    paths = rt.build_indices(documents(spark, sf), part_tags(spark, sf), vectors(spark, sf), tag_vectors(spark, sf), benchmark(spark, sf), shared_folder(spark, "indices"))
    out = None
    for name, path in paths.items():
        counted = spark.read.parquet(path).agg(F.lit(name).alias("index_name"), F.count(F.lit(1)).alias("n_rows"))
        out = counted if out is None else out.unionByName(counted)
    return out


@query("V18_search_stored_index", f"WITH {SQL_BM25} SELECT query_id, doc_id, {q6('score')} AS score, rank FROM bm_ranked WHERE rank <= 10")
def stored_search(spark, sf):
    path = rt.build_lexical_index(documents(spark, sf), shared_folder(spark, "lexical"))
    return lx.bm25_search(rt.open_lexical_index(spark, path), benchmark(spark, sf), "text", 10).select("query_id", "doc_id", r6("score").alias("score"), "rank")
