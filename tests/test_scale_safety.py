"""Properties that must hold whatever the key distribution, and edge cases of sources and hooks."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rankweave import skew
from rankweave.functions.hooks import map_batch
from rankweave.operators import clicklog as cl
from rankweave.operators import features as ft
from rankweave.operators import fusion, graph, knn
from rankweave.operators import lexical as lx
from rankweave.operators import metrics as mt
from rankweave.operators import tags as tg
from rankweave.operators import trainset as ts
from rankweave.plans import retrieval as rt
from rankweave.session import shared_folder
from rankweave.sources import readers, writers


def hot(spark, n=3000):
    """A third of the rows belong to key 0."""
    return spark.range(n).withColumn("k", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97))


def test_ordinal_is_row_number(spark):
    df = hot(spark)
    plain = F.row_number().over(Window.partitionBy("k").orderBy("id"))
    got = skew.ordinal(df.withColumn("want", plain), ["k"], [F.col("id")], F.floor(F.col("id") / 50), "o")
    assert got.count() == 3000 and got.where("o <> want").count() == 0


def test_pack_splits_large_groups_and_loses_nothing(spark):
    out = skew.pack(hot(spark), ["k"], F.col("id"), [F.col("id")], F.floor(F.col("id") / 50), "ids", 100)
    assert out.agg(F.max(F.size("ids"))).first()[0] == 100
    assert out.select(F.explode("ids").alias("i")).distinct().count() == 3000
    first = out.where("k = 0 and part = 1").first()["ids"]
    assert first == sorted(first) and len(first) == 100


def test_snips_sums_to_group_size(spark):
    rows = hot(spark).select(F.col("k").alias("session_id"), (F.rand(3) + 0.1).alias("ips_weight"))
    sums = cl.snips(rows).groupBy("session_id").agg(F.sum("snips_weight").alias("s"), F.count(F.lit(1)).alias("n"), F.sum("weight_share").alias("one"))
    assert sums.where((F.abs(F.col("s") - F.col("n")) > 1e-6) | (F.abs(F.col("one") - 1) > 1e-9)).count() == 0


def unit(n, dims=8, seed=1):
    v = np.random.default_rng(seed).normal(size=(n, dims))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def frame(spark, v, start=0):
    return spark.createDataFrame([(start + i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, vec array<double>")


@pytest.mark.parametrize("limit", [0, 1 << 20])
@pytest.mark.parametrize("sizes", [(40, 130), (130, 40)])
def test_topk_over_many_blocks(spark, sizes, limit):
    q, c = unit(sizes[0], seed=2), unit(sizes[1], seed=3)
    c[7] = c[3]  # equal scores keep the lower id
    got = knn.exact_topk(frame(spark, q), frame(spark, c), 5, block=4, broadcast_bytes=limit).collect()
    scores = np.round(q @ c.T, 9)
    want = {(i, int(j), r + 1) for i in range(len(q)) for r, j in enumerate(np.lexsort((np.arange(len(c)), -scores[i]))[:5])}
    assert {(r["query_id"], r["item_id"], r["rank"]) for r in got} == want


def test_ann_with_all_probes_is_exact(spark):
    v = frame(spark, unit(90))
    exact = knn.exact_topk(v, v, 4).select("query_id", "item_id", "rank")
    ann = knn.ann_topk(v, v, 4, pivots=10, probes=10, block=8).select("query_id", "item_id", "rank")
    assert exact.exceptAll(ann).count() == 0 and ann.exceptAll(exact).count() == 0


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_target_rank_counts_better_items(spark, limit):
    q, c = unit(30, seed=4), unit(70, seed=5)
    goal = (q * c[:30]).sum(axis=1)
    asked = frame(spark, q).join(spark.createDataFrame([(i, float(g)) for i, g in enumerate(goal)], "id long, target_score double"), "id")
    got = {r["query_id"]: r["rank"] for r in knn.target_rank(asked, frame(spark, c), block=4, broadcast_bytes=limit).collect()}
    assert got == {i: int((np.round(q[i] @ c.T, 9) > np.round(goal[i], 9)).sum()) + 1 for i in range(30)}


def test_copies_cost_linear_edges(spark):
    v = unit(60, seed=6)
    v[20:50] = v[10]  # half of the rows are copies
    edges = knn.similar_pairs(frame(spark, v), 0.9, block=16)
    assert edges.where("score >= 0.999999").count() <= 30
    parts = graph.connected_components(frame(spark, v), edges).groupBy("component").count().agg(F.max("count")).first()[0]
    assert parts >= 31
    labels = {r["id"]: r["label"] for r in tg.density_cluster(frame(spark, v), 0.999, 5).collect()}
    assert {labels[i] for i in range(20, 50)} == {10} and labels[0] == -1


def test_components_match_union_find(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(500 + i, 501 + i) for i in range(60)] + [(600, 601 + i) for i in range(80)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    nodes = spark.range(700)
    got = graph.connected_components(nodes, spark.createDataFrame(edges, "src long, dst long"))
    assert {r["id"]: r["component"] for r in got.collect()} == {i: find(i) for i in range(700)}


def test_batches_have_no_repeats(spark):
    df = hot(spark, 600).select("id", F.col("k").cast("string").alias("anchor"), (F.col("id") % 40).cast("string").alias("positive"))
    out = ts.batch_no_duplicates(df, 8, "id")
    per = out.groupBy("round", "batch").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("anchor").alias("a"), F.countDistinct("positive").alias("p"))
    assert out.count() == 600 and per.where("n > 8 or n <> a or n <> p").count() == 0


def test_copies_of_a_query_are_searched_once_and_all_answered(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["red fox", "blue fox fox", "green frog", "red frog"])], "doc_id long, text string")
    queries = spark.createDataFrame([(i, "red fox" if i % 3 else "frog") for i in range(30)], "query_id long, text string")
    for found in (lx.bm25_search_docs(docs, queries, "text", 2), lx.overlap_topk(queries, docs, "text", 2)):
        per = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))).alias("l"))
        assert per.count() == 30
        assert per.select(F.col("l").cast("string")).distinct().count() == 2


def test_tag_index_with_shared_and_distinct_popularity(spark):
    rows = spark.range(400).select(F.lit("hot").alias("tag"), F.col("id").alias("item_id"), F.when(F.col("id") < 250, 5.0).otherwise(F.col("id") / 7.0).alias("pop"))
    out = fusion.inverse_tag_index(rows, "pop", 100).orderBy("part").collect()
    got = [i for r in out for i in r["items"]]
    want = [r["item_id"] for r in rows.orderBy(F.col("pop").desc(), "item_id").collect()]
    assert got == want and [len(r["items"]) for r in out] == [100] * 4


def test_tag_retrieve_matches_full_join(spark):
    rnd = random.Random(3)
    tags, asked = frame(spark, unit(6, seed=8)), frame(spark, unit(25, seed=9))
    held = [(i, t, float(rnd.randrange(4))) for i in range(120) for t in {0, rnd.randrange(6)}]
    pops = {}
    held = [(i, t, pops.setdefault(i, p)) for i, t, p in held]
    item_tags = spark.createDataFrame(held, "item_id long, tag long, popularity double")
    got = rt.tag_retrieve(asked, tags, item_tags, 3, 7).select("query_id", "item_id", "rank").collect()
    near = knn.exact_topk(asked, tags, 3).select("query_id", F.col("item_id").alias("tag"), "score").collect()
    want = set()
    for q in range(25):
        sim = {r["tag"]: r["score"] for r in near if r["query_id"] == q}
        score = {}
        for i, t, _ in held:
            if t in sim:
                score[i] = score.get(i, 0.0) + sim[t]
        order = sorted(score, key=lambda i: (-round(score[i], 9), -pops[i], i))[:7]
        want |= {(q, i, n + 1) for n, i in enumerate(order)}
    assert {tuple(r) for r in got} == want


def test_auc_with_ties_and_one_class(spark):
    rows = spark.createDataFrame([(0.1, 0), (0.4, 1), (0.4, 0), (0.8, 1)], "score double, label int")
    assert mt.auc(rows).first()["auc"] == pytest.approx((1 + 0.5 + 2) / 4)
    assert np.isnan(mt.auc(rows.where("label = 1")).first()["auc"])


def test_hook_falls_back_per_row(spark):
    def fn(rows):
        return [1 // x for (x,) in rows]

    out = map_batch(spark.createDataFrame([(1,), (0,), (-1,)], "x int"), ["x"], fn, "y", "int", fallback=-9)
    assert {r["x"]: r["y"] for r in out.collect()} == {1: 1, 0: -9, -1: -1}


def test_sources_and_sinks(spark):
    path = shared_folder(spark, "test-csv")
    spark.createDataFrame([("user_id,month,f1",), ("u1,2024-01,2.5",), ("u2, ,1",), ("u3,2024-02,abc",)], "value string").coalesce(1).write.text(path)
    assert [tuple(r) for r in readers.read_wide_csv(spark, path, ["user_id", "month"]).orderBy("user_id").collect()] == [("u1", "2024-01", 2.5), ("u3", "2024-02", 0.0)]
    with pytest.raises(ValueError):
        readers.read_wide_csv(spark, path, ["user_id", "month", "f1"])
    with pytest.raises(ValueError):
        readers.require_columns(spark.range(1), ["id", "missing"])
    with pytest.raises(Exception):
        readers.read_parquet_glob(spark, path + "/none-*.parquet").count()
    done = shared_folder(spark, "test-resume")
    seen = []

    def work(tasks):
        seen.append(tasks.count())
        return tasks

    writers.append_resume(spark.range(5), done, ["id"], work)
    writers.append_resume(spark.range(8), done, ["id"], work)
    assert seen == [5, 3] and spark.read.parquet(done).count() == 8


def test_history_and_encoder(spark):
    rows = spark.createDataFrame([("u", "2024-%02d" % m, float(m)) for m in range(1, 12)] + [("x", "2024-01", 1.0)], "user_id string, month string, f double")
    users = spark.createDataFrame([("u",), ("v",)], "user_id string")
    out = {r["user_id"]: r for r in ft.monthly_history(rows, users, ["f"]).collect()}
    assert [x[0] for x in out["u"]["history"]] == [float(m) for m in range(3, 12)] and out["u"]["length"] == 9
    assert out["v"]["length"] == 0 and out["v"]["history"] == [[0.0]] * 9
    with pytest.raises(RuntimeError):
        ft.UserEncoder([], [], [], []).transform(spark.range(1))


@pytest.mark.parametrize("n_tags,k", [(3, 4), (9, 4)])
def test_tag_retrieve_of_uneven_items(spark, n_tags, k):
    """Popularities that differ by row or are null, repeated rows, similarities below zero."""
    rnd = random.Random(4)
    tags, asked = frame(spark, unit(10, dims=4, seed=8)), frame(spark, unit(30, dims=4, seed=9))
    held = [(i, t, float(rnd.randrange(3)) if i % 5 == 0 else None if i % 7 == 0 else float(i % 4)) for i in range(150) for t in rnd.sample(range(10), 1 + i % 4)] * 2
    got = rt.tag_retrieve(asked, tags, spark.createDataFrame(held, "item_id long, tag long, popularity double"), n_tags, k).select("query_id", "item_id", "rank").collect()
    near = knn.exact_topk(asked, tags, n_tags).select("query_id", F.col("item_id").alias("tag"), "score").collect()
    want = set()
    for q in range(30):
        sim, score, pops = {r["tag"]: round(r["score"], 12) for r in near if r["query_id"] == q}, {}, {}
        for i, t, p in set(held):
            if t in sim:
                score.setdefault(i, set()).add(t)
                pops[i] = max(pops.get(i, -1.0), -1.0 if p is None else p)
        order = sorted(score, key=lambda i: (-round(sum(sim[t] for t in sorted(score[i])), 9), -pops[i], i))[:k]
        want |= {(q, i, n + 1) for n, i in enumerate(order)}
    assert {tuple(r) for r in got} == want


def test_an_item_is_not_paired_with_every_combination(spark):
    """20,000 items of one frequent tag, 60 combinations: only the best of each set of tags meet them."""
    items = spark.range(20_000).select(F.col("id").alias("item_id"), F.explode(F.array(F.lit("all"), F.concat(F.lit("t"), F.col("id") % 60))).alias("tag"), (F.col("id") % 11).alias("popularity"))
    even = items.groupBy("item_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"), F.max("popularity").alias("popularity"))
    combos = spark.range(60).select(F.array(F.lit("all"), F.concat(F.lit("t"), F.col("id"))).alias("combo"))
    found = rt._held_by_sets(combos, even, 2, 5)
    assert found.count() <= 60 * 3 * 5 and found.where("size(held) = 2").count() >= 300


def test_only_distinct_names_and_tags_are_encoded(spark, tmp_path):
    from rankweave.catalog import retrieval as rc

    rows = [(i, f"n{i % 3}", "B", "T", 1, 1.0) for i in range(50)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    for vectors, n in ((rc.name_queries, 3), (rc.tag_vectors, 5)):
        df = vectors(spark, str(tmp_path))
        assert "Aggregate" not in df._jdf.queryExecution().optimizedPlan().toString() and df.count() == n
