"""Searches inside the documents' tasks: same rows as a plain ranking, whatever the blocks, groups and tasks."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rankweave.operators import lexical as lx
from rankweave.operators import postings as ps
from rankweave.plans import retrieval as rt


def plain_topk(terms, postings, k):
    weight = defaultdict(dict)
    for d, t, w in postings:
        weight[t][d] = w
    scores = defaultdict(float)
    for q, t, w in terms:
        for d, x in weight[t].items():
            scores[q, d] += w * x
    out = {}
    for q in {q for q, _ in scores}:
        ranked = sorted(((-round(s, 9), d) for (p, d), s in scores.items() if p == q))[:k]
        out[q] = [(d, -s) for s, d in ranked]
    return out


def rows_of(found):
    out = defaultdict(list)
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        out[r["query_id"]].append((r["doc_id"], round(r["score"], 9)))
    return dict(out)


def random_case(seed, ids=int, negative=False):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    weight = lambda: rng.choice([1.0, 0.5, 2.0, -1.0 if negative else 0.25])
    postings = [(ids(d), w, weight()) for d in range(300) for w in rng.sample(words, rng.randint(0, 12))]
    terms = [(q, w, weight()) for q in range(25) for w in rng.sample([*words, "unknown"], rng.randint(1, 6))]
    return terms, postings


@pytest.mark.parametrize("ids,kind", [(int, "long"), (lambda d: f"doc {d:03}", "string")])
@pytest.mark.parametrize("negative", [False, True])
def test_sparse_search_matches_a_plain_ranking(spark, monkeypatch, ids, kind, negative):
    terms, postings = random_case(5, ids, negative)
    t = spark.createDataFrame(terms, "query_id long, term string, q_weight double")
    p = spark.createDataFrame(postings, f"doc_id {kind}, term string, d_weight double").repartition(5)
    for k in (1, 7, 1000):
        want = plain_topk(terms, postings, k)
        for rows, cells, limit in ((ps.BLOCK_ROWS, ps.CELLS, ps.QUERY_BYTES), (7, 50, 600)):
            monkeypatch.setattr(ps, "BLOCK_ROWS", rows)
            monkeypatch.setattr(ps, "CELLS", cells)
            monkeypatch.setattr(ps, "QUERY_BYTES", limit)
            assert rows_of(lx.sparse_topk(t, p, k)) == want


def test_no_pair_is_shuffled(spark):
    docs = spark.createDataFrame([(i, f"some words of text {i % 17} and {i % 5}") for i in range(200)], "doc_id long, text string")
    queries = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "query_id long, text string")
    found = lx.bm25_search_docs(docs, queries, "text", 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert exchanges and not any("doc_id" in line for line in exchanges)
    assert found.groupBy("query_id").count().where("count > 3").count() == 0


def test_searches_without_queries_terms_or_documents(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "the of"), (4, "red fox")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "fox"), (2, None), (3, ""), (4, "the"), (5, "nothing")], "query_id long, text string")
    assert [(r["query_id"], r["doc_id"]) for r in lx.bm25_search_docs(docs, queries, "text", 5).collect()] == [(1, 4)]
    assert lx.bm25_search_docs(docs, queries.limit(0), "text", 5).count() == 0
    assert lx.bm25_search_docs(docs.limit(0), queries, "text", 5).count() == 0
    assert sorted((r["query_id"], r["doc_id"], r["score"]) for r in lx.overlap_topk(queries, docs, "text", 5).collect()) == [(1, 4, 1), (4, 3, 1)]
    index = lx.bm25_index(docs, "text")
    assert sorted((r["doc_id"], r["term"]) for r in index.postings.collect()) == [(4, "fox"), (4, "red")]


def test_exact_names_surface_whatever_they_score(spark):
    docs = spark.createDataFrame([(1, " The "), (2, "the best of tea"), (3, "tea"), (4, "TEA"), (5, None), (6, "tea tea tea house")], "doc_id long, name string")
    queries = spark.createDataFrame([(1, "tea"), (2, "the"), (3, "house of tea"), (4, None)], "query_id long, text string")
    found = lx.fielded_bm25(docs, {"name": 2.0}, queries, "text", "name", 2).collect()
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["doc_id"], r["is_exact"]))
    assert got[1] == [(3, 1), (4, 1)] and got[2] == [(1, 1)] and got[3][0] == (6, 0) and 4 not in got


def test_stored_index_is_searched_where_it_lies(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i % 7} word{i % 11} tail{i}") for i in range(300)], "doc_id long, text string")
    queries = spark.createDataFrame([(i, f"word{i} tail{i}") for i in range(9)], "query_id long, text string")
    index = rt.open_lexical_index(spark, rt.build_lexical_index(docs, str(tmp_path / "index"), buckets=4))
    found = ps.best_documents(index.lists, lx.query_terms(queries, "text").join(index.terms, "term").select("query_id", "term", F.col("idf").alias("q_weight")), 5, index.weigh)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    stored, direct = lx.bm25_search(index, queries, "text", 5), lx.bm25_search_docs(docs, queries, "text", 5)
    assert rows_of(stored) == rows_of(direct)


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    v = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(200)], "id long, vec array<double>")
    tags = spark.createDataFrame([(i, f"t{i % 5}", 1.0) for i in range(50)], "item_id long, tag string, popularity double")
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    cache = spark.createDataFrame([(i, "q") for i in range(20)], "query_id long, text string")
    paths = rt.build_indices(docs, tags, v, v.limit(5), cache, str(tmp_path / "all"), prefix="bucket_test", buckets=4)
    try:
        assert {name: spark.read.parquet(p).count() for name, p in paths.items()}["lexical_documents"] == 200
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        joined = spark.table("bucket_test_dense").join(spark.table("bucket_test_lexical_documents").withColumnRenamed("doc_id", "id"), "id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 200
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("dense", "tag_vector", "query_cache", "lexical_documents", "lexical_terms"):
            spark.sql(f"DROP TABLE IF EXISTS bucket_test_{name}")


def test_texts_are_counted_and_scanned_in_small_parts(spark, monkeypatch):
    from rankweave.operators import entities as en
    from rankweave.session import configure

    configure(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "16777216b"
    docs = spark.createDataFrame([(i, f"a{i % 7} b a{i % 7} c{i}" if i % 11 else None) for i in range(600)], "doc_id long, text string").coalesce(1)
    words = spark.createDataFrame([("a3 b", "L"), ("c77", "M")], "value string, label string")

    def found():
        lists = ps.term_lists(docs, {"": F.split("text", " ")}, ["b"]).collect()
        hits = en.tag_with_dictionary(docs.select(F.col("doc_id").alias("id"), "text"), words).collect()
        return sorted(map(str, lists)), sorted(map(str, hits))

    whole = found()
    assert len(whole[0]) == 600 and len(whole[1]) > 50
    for module in (ps, en):
        monkeypatch.setattr(module, "TEXT_ROWS", 7)
    assert found() == whole
