"""Pivot cells, ranges of keys, drawn sets, automaton tagging, sparse categories, seeded centres."""

import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankweave import skew
from rankweave.catalog import ORACLE, QUERIES
from rankweave.operators import clicklog as cl
from rankweave.operators import entities as en
from rankweave.operators import features as ft
from rankweave.operators import fusion, knn, tags
from rankweave.operators import text as tx
from rankweave.operators import trainset as ts


# ---- pivot join ----

def clustered(n, spread, seed=1, dims=16, centres=40):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dims))
    c /= np.linalg.norm(c, axis=1)[:, None]
    x = c[rng.integers(0, centres, n)] + rng.normal(scale=spread, size=(n, dims))
    return x / np.linalg.norm(x, axis=1)[:, None]


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(4)


@pytest.mark.parametrize("spread,threshold,block", [(0.05, 0.9, 64), (5.0, 0.3, 50), (0.05, 0.99, 8)])
def test_pivot_join_finds_all_pairs(spark, spread, threshold, block):
    x = clustered(600, spread)
    s = np.round(x @ x.T, 9)
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(s > threshold, 1)))}
    got = [(r["src"], r["dst"]) for r in knn.similar_pairs(frame(spark, x), threshold, block=block).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def comparisons(spark, x, threshold, block):
    work = knn.pivot_blocks(frame(spark, x), threshold, block)
    size = F.aggregate("packs", F.lit(0), lambda a, p: a + F.size(p["ids"]))
    return work.agg(F.sum(F.size("q_ids") * size)).first()[0]


def test_comparisons_grow_with_the_rows_not_their_square(spark):
    small, large = (comparisons(spark, clustered(n, 0.02, centres=n // 25), 0.95, 100) for n in (1000, 10_000))
    assert large < 25 * small and large < 0.1 * 10_000**2


def test_no_vector_lies_in_all_blocks(spark):
    x = clustered(3000, 0.02)
    blocks = knn.pivot_blocks(frame(spark, x), 0.95, 100).where("not same").select(F.explode("q_ids").alias("id")).groupBy("id").count().agg(F.max("count")).first()[0]
    assert blocks is None or blocks < 30


def test_pairs_of_empty_and_single_tables(spark):
    empty = spark.createDataFrame([], "id long, vec array<double>")
    assert knn.similar_pairs(empty, 0.5).count() == 0
    assert knn.similar_pairs(spark.createDataFrame([(1, [1.0, 0.0])], "id long, vec array<double>"), 0.5).count() == 0


# ---- approximate search ----

@pytest.mark.parametrize("block", [knn.BLOCK, 20])
def test_probes_reach_their_recall(spark, block):
    x = clustered(1500, 0.2, centres=10)
    corpus = frame(spark, x)
    asked = corpus.where("id % 10 = 0")
    probes = knn.probes_for_recall(asked, corpus, 5, 0.9, pivots=24)
    exact = np.argsort(-np.round(x[::10] @ x.T, 9), axis=1, kind="stable")[:, :5]
    found = defaultdict(set)
    for r in knn.ann_topk(asked, corpus, 5, pivots=24, probes=probes, block=block).collect():
        found[r["query_id"]].add(r["item_id"])
    recall = np.mean([len(found[10 * i] & set(row.tolist())) / 5 for i, row in enumerate(exact)])
    assert 1 <= probes < 24 and recall >= 0.9
    measured = {r["probes"]: r["recall"] for r in knn.probe_recall(asked, corpus, 5, pivots=24).collect()}
    assert measured[probes] == pytest.approx(recall) and measured[24] == 1.0 and len(measured) == 24


def test_cells_of_many_pivots_in_groups(spark):
    x = clustered(400, 0.5)
    corpus = frame(spark, x)
    pivots = knn.choose_pivots(corpus, 60)
    whole, parted = (sorted((r["id"], r["place"], r["cell"]) for r in knn.assign_cells(corpus, pivots, 3, group=g).collect()) for g in (4096, 7))
    assert whole == parted and len(whole) == 1200


# ---- numbering by ranges ----

def test_ids_with_one_prefix_are_cut_into_even_ranges(spark):
    ids = spark.range(1_000_000).select(F.format_string("user_with_a_long_common_prefix_%09d", "id").alias("name"), "id")
    pieces = skew.range_pieces(ids, [F.col("name")], rows=50_000)
    sizes = [r["count"] for r in pieces.groupBy("__piece").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 2 * sum(sizes) / len(sizes)
    assert skew.numbered(ids, [F.col("name")], "n", rows=50_000).where(F.col("n") != F.col("id") + 1).count() == 0


def test_numbers_within_hot_keys(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"), F.col("id").alias("v"))
    out = skew.numbered(rows, [F.col("v").desc()], "n", ["k"], rows=1000)
    groups = defaultdict(list)
    for r in out.collect():
        groups[r["k"]].append((r["n"], r["v"]))
    assert sum(map(len, groups.values())) == 30_000
    for g in groups.values():
        g.sort()
        assert [n for n, _ in g] == list(range(1, len(g) + 1)) and [v for _, v in g] == sorted((v for _, v in g), reverse=True)
    assert skew.numbered(rows.limit(0), [F.col("v")], "n").count() == 0


def test_tag_index_of_ratios(spark):
    rows = spark.range(5000).select(F.lit("hot").alias("tag"), F.col("id").alias("item_id"), (F.col("id") % 97 / 97.0).alias("pop"))
    got = [i for r in fusion.inverse_tag_index(rows, "pop", 700).orderBy("part").collect() for i in r["items"]]
    assert got == [r["item_id"] for r in rows.orderBy(F.col("pop").desc(), "item_id").collect()]


# ---- drawn sets ----

def test_overlap_draws_qualify_and_are_even(spark):
    rng = random.Random(2)
    items = [(i, rng.sample("abcdefgh", 4)) for i in range(400)] + [(1000 + i, list("abcd")) for i in range(200)] + [(5000, ["alone"]), (5001, []), (5002, None)]
    sets = {i: set(t or ()) for i, t in items}
    out = ts.overlap_triplets(spark.createDataFrame(items, "item_id long, tags array<string>")).collect()
    anchors = {r["anchor"] for r in out}
    assert len(anchors) == len(out) and 5000 not in anchors
    for r in out:
        a, p, n = (sets[r[c]] for c in ("anchor", "positive", "negative"))
        assert len({r["anchor"], r["positive"], r["negative"]}) == 3 and 2 * len(a & p) > len(a) and 2 * len(p & n) >= len(p)
    assert anchors == {i for i, t in sets.items() if t and sum(2 * len(t & u) > len(t) for j, u in sets.items() if j != i)}
    # a set is drawn in proportion to the items it offers
    own = [(i, list(t)) for i, t in enumerate(["abcd", "abce", "abcf", "abcg", "abcd", "abcd"])]
    frame_of = spark.createDataFrame([(i, t) for i, t in own], "item_id long, tags array<string>")
    keys = [f"{i}" for i in range(600)]
    clocks = spark.createDataFrame([(x, y, w, g) for x in keys for y, w in (("a", 1), ("b", 3)) for g in (0, 3)], "x string, y string, w long, g long")
    least = clocks.withColumn("c", ts.draw_clock("s", F.col("w"), F.col("g"), "x", "y")).groupBy("x", "g").agg(F.min(F.struct("c", "y"))["y"].alias("y"))
    share = {(r["g"], r["y"]): r["n"] / 600 for r in least.groupBy("g", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(abs(share[g, "b"] - 0.75) < 0.06 for g in (0, 3))  # three items are three times as likely as one
    drawn = {r["anchor"]: r["positive"] for r in ts.overlap_triplets(frame_of).collect()}
    assert set(drawn) <= {0, 1, 2, 3, 4, 5} and all(a != p for a, p in drawn.items())


def test_every_row_is_an_anchor(spark):
    rows = [(i, f"t{i % 7}", "x" if i % 7 < 4 else "y") for i in range(40)] + [(40, "t0", "y")]
    out = ts.class_triplets(spark.createDataFrame(rows, "id long, text string, label string"), "text", "label", 3, 4, key="id").collect()
    texts = defaultdict(set)
    for _, t, label in rows:
        texts[label].add(t)
    per = Counter((r["id"], r["kind"]) for r in out)
    assert all(per[i, "positive"] == 3 and per[i, "negative"] == 4 for i, _, _ in rows)
    assert all((r["text"] in texts[r["class"]]) == (r["kind"] == "positive") for r in out)


def test_hard_negative_rows_have_texts(spark):
    rows = [(i, i % 2, [1.0, 0.01 * i], [1.0, 0.02 * i], f"ask {i}", f"answer {i}") for i in range(30)]
    faq = spark.createDataFrame(rows, "id long, article_id long, anchor_vec array<double>, positive_vec array<double>, anchor string, positive string")
    ids = {r["id"]: r["negatives"] for r in ts.mine_hard_negatives(faq, 8, 3).collect()}
    out = {r["id"]: r for r in ts.hard_negative_rows(faq, 8, 3).collect()}
    assert {i: [f"answer {n}" for n in own] for i, own in ids.items()} == {i: r["negatives"] for i, r in out.items()}
    assert all(out[i]["anchor"] == f"ask {i}" and out[i]["positive"] == f"answer {i}" for i in ids) and any(ids.values())


# ---- tagging ----

def plain_tags(texts, words):
    import re

    cut = lambda s: [w for w in re.split(r"[^\w#&'-]+|_", (s or "").lower()) if w]
    out = set()
    for i, text in texts:
        w = cut(text)
        for value, label in words:
            v = cut(value)
            at = [p for p in range(len(w) - len(v) + 1) if w[p:p + len(v)] == v] if v else []
            if at:
                out.add((i, label, value, at[0]))
    return out


@pytest.mark.parametrize("key_bytes", [en.KEY_BYTES, 40])
def test_tagging_matches_a_plain_scan(spark, key_bytes):
    rng = random.Random(3)
    vocab = ["new", "york", "city", "café", "日本", "o'neil", "a", "b", "\U0001F600x", "tea-house"]
    words = list({(" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 4))), rng.choice(["L", "M"])) for _ in range(60)})
    words += [("New, York!", "L"), ("...", "L"), (" ".join(["a"] * 499 + ["b"]), "LONG")]
    texts = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 30)))) for i in range(80)]
    texts += [(900, None), (901, ""), (902, " ".join(["a"] * 3000)), (903, " ".join(["a"] * 700 + ["b", "a"])), (904, "NEW york; City")]
    found = en.tag_with_dictionary(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(words, "value string, label string"), key_bytes=key_bytes)
    got = [(r["id"], r["label"], r["value"], r["pos"]) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == plain_tags(texts, words) and any(x[1] == "LONG" for x in got)


def test_items_match_every_label_that_is_named(spark):
    rng = random.Random(4)
    values = [(i, lab, f"{lab}{rng.randint(0, 4)}") for i in range(60) for lab in "XYZ" if rng.random() < 0.8] + [(99, "X", None)]
    named = [(q, lab, f"{lab}{v}") for q in range(40) for lab in "XYZ" for v in rng.sample(range(6), rng.choice([0, 0, 1, 2]))]
    sets = en.entity_sets(spark.createDataFrame(named, "query_id long, label string, value string"))
    out = {(frozenset((e["label"], e["value"]) for e in r["entities"]), r["item_id"]) for r in en.matching_items(sets, spark.createDataFrame(values, "item_id long, label string, value string")).collect()}
    held, want = {(i, lab, v) for i, lab, v in values}, set()
    for q in range(40):
        own = frozenset((lab, v) for p, lab, v in named if p == q)
        if own:
            want |= {(own, i) for i in range(60) if all(any((i, lab, v) in held for la, v in own if la == lab) for lab in {x for x, _ in own})}
    assert out == want and want


def test_long_texts_of_tokens_get_their_tags(spark):
    words = [f"w{i}" for i in range(20_000)]
    text = " ".join(words)
    at = text.index("w10000 ")
    spans = [(at, at + len("w10000 w10001"), "M"), (0, 2, "L"), (1, 2, "L"), (at, at + len("w10000"), "Z")]
    df = spark.createDataFrame([(1, text, spans), (2, "", []), (3, "a b", None)], "id long, text string, entities array<struct<start:int,end:int,label:string>>")
    got = {r["id"]: r["ner_tags"] for r in en.spans_to_bio(df).collect()}
    assert got[1][0] == "B-L" and got[1][10_000:10_002] == ["B-Z", "I-M"] and got[1].count("O") == 20_000 - 3
    assert got[2] == [] and got[3] == ["O", "O"]


@pytest.mark.parametrize("tags_of,want", [
    ("B-A I-A O B-B", [(0, 2, "A"), (3, 4, "B")]), ("I-A I-A I-B B-B", [(0, 2, "A"), (2, 3, "B"), (3, 4, "B")]), ("O O", []), ("", []), ("B-A B-A I-B O I-B I-B", [(0, 1, "A"), (1, 2, "A"), (2, 3, "B"), (4, 6, "B")])])
def test_spans_of_tags(spark, tags_of, want):
    df = spark.createDataFrame([(tags_of.split(),)], "t array<string>")
    assert [tuple(s) for s in df.select(en.bio_spans(F.col("t")).alias("s")).first()["s"]] == want


# ---- categories, pooling, draws ----

def test_a_hundred_thousand_categories(spark):
    rows = spark.range(100_000).select("id", F.format_string("cat_%06d", F.col("id")).alias("c"))
    index = ft.category_index(rows, "c")
    asked = rows.where("id % 9999 = 0").unionByName(spark.createDataFrame([(-1, "none"), (-2, None)], "id long, c string"))
    got = {r["id"]: r["v"] for r in ft.one_hot(asked, "c", index, "v").collect()}
    assert all(v["size"] == 100_000 and (v["indices"], v["values"]) == (([i], [1.0]) if i >= 0 else ([], [])) for i, v in got.items()) and len(got) == 13


def test_sparse_and_dense_user_vectors_agree(spark):
    users = spark.createDataFrame([(1, 2.0, 5.0), (2, 4.0, 7.0)], "u long, a double, b double")
    ctx = spark.createDataFrame([(1, "x", "p", 3, 2), (2, "y", None, 0, 0), (2, "new", "q", 23, 6)], "u long, c string, d string, current_hour int, current_day_of_week int")
    encoder = ft.UserEncoder(["a"], ["b"], ["c", "d"], ["u"]).fit(users, ctx.where("c != 'new'"))
    rows = ctx.join(users, "u")
    dense = encoder.transform(rows).select("c", "vector").collect()
    sparse = {r["c"]: r["vector"] for r in encoder.transform(rows, as_sparse=True).collect()}
    for r in dense:
        s = sparse[r["c"]]
        full = [0.0] * s["size"]
        for i, v in zip(s["indices"], s["values"]):
            full[i] = v
        assert full == r["vector"] and len(full) == 2 + 2 + 1 + 1 + 4 and s["indices"] == sorted(s["indices"])
    assert next(r["vector"] for r in dense if r["c"] == "new")[2:5] == [0.0, 0.0, 0.0]


def test_pooling_without_known_words(spark):
    encoded = spark.createDataFrame([(1, [2, 3, 0]), (2, [0, 0, 0]), (3, [9, 9, 9]), (4, [])], "doc_id long, ids array<int>")
    table = spark.createDataFrame([(2, [1.0, 3.0]), (3, [3.0, 5.0])], "id int, vector array<double>")
    got = {r["doc_id"]: r["vector"] for r in tx.mean_pool(encoded, "doc_id", table, 2).collect()}
    assert got == {1: [2.0, 4.0], 2: [0.0, 0.0], 3: [0.0, 0.0], 4: [0.0, 0.0]}


def test_draws_by_window_and_in_pieces_agree(spark):
    rows = [(f"s{i % 3}" if i % 5 else None, "u", "q", "t", f"r{i % 2}", "candidate" if i % 11 else "clicked", f"/{i // 3}", 90 + i % 40) for i in range(900)]
    items = spark.createDataFrame(rows, "session_id string, user_id string, query string, session_time string, record string, role string, link string, position int")
    by_window, in_pieces, mixed = (sorted(map(str, cl.sample_negatives(items, window_rows=n).collect())) for n in (10_000, 0, 170))
    assert by_window == in_pieces == mixed and len(by_window) > 20


def test_a_query_without_results_is_cut_at_zero(spark):
    ranked = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (1, 3, 0.1), (2, 1, 0.5)], "query_id long, rank int, score double")
    asked = spark.createDataFrame([(1,), (2,), (3,), (3,)], "query_id long")
    assert {r["query_id"]: r["k"] for r in fusion.adaptive_k(ranked, 1, queries=asked).collect()} == {1: 2, 2: 1, 3: 0}


# ---- centres ----

def test_soft_assignment_in_groups(spark):
    rng = np.random.default_rng(1)
    x, c = rng.normal(size=(40, 3)), rng.normal(size=(1500, 3))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    centres = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "cluster long, vec array<double>")
    w = 1 / (1 + ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2))
    want = w / w.sum(axis=1)[:, None]
    for limit in (tags.CENTROID_BYTES, 24 * 400):
        got = {r["id"]: r for r in tags.soft_assign(points, centres, limit=limit).collect()}
        assert all(np.allclose(got[i]["q"], want[i]) and got[i]["label"] == want[i].argmax() for i in range(40))
    sharp = {r["id"]: r["p"] for r in tags.target_distribution(tags.soft_assign(points, centres)).collect()}
    p = want**2 / want.sum(axis=0)
    assert all(np.allclose(sharp[i], p[i] / p[i].sum()) for i in range(40))


def test_seeded_centres(spark):
    x = clustered(800, 0.02, centres=6, dims=4, seed=9)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    rows = tags.kmeans_centroids(points, 6, per_turn=2).orderBy("cluster").collect()
    again = tags.kmeans_centroids(points.repartition(7), 6, per_turn=2).orderBy("cluster").collect()
    c = np.array([r["vec"] for r in rows])
    assert len(rows) == 6 and np.allclose(c, [r["vec"] for r in again])
    assert ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2).min(axis=1).mean() < 0.2
    few = spark.createDataFrame([(i, [float(i % 3)]) for i in range(30)], "id long, vec array<double>")
    assert sorted(r["vec"][0] for r in tags.kmeans_centroids(few, 14).collect()) == [0.0, 1.0, 2.0]
    assert tags.kmeans_centroids(few.limit(0), 3).count() == 0


# ---- pairs that are compared and not stored ----

def components_of(n, edges):
    root = list(range(n))
    for a, z in edges:
        a, z = sorted((root[a], root[z]))
        root = [a if r == z else r for r in root]
    return root


@pytest.mark.parametrize("copies", [0, 1e9])
def test_blocks_by_hash_and_by_guests_agree(spark, copies, monkeypatch):
    x = clustered(400, 0.3)
    whole = knn.pivot_blocks
    monkeypatch.setattr(knn, "pivot_blocks", lambda reps, threshold, block, pivots: whole(reps, threshold, block, pivots, copies))
    s = np.round(x @ x.T, 9)
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(s > 0.7, 1)))}
    got = [(r["src"], r["dst"]) for r in knn.similar_pairs(frame(spark, x), 0.7, block=32).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


@pytest.mark.parametrize("copies,as_text", [(0, False), (1e9, False), (1e9, True)])
def test_copies_pair_with_each_other_and_with_all_their_vector_is_like(spark, copies, as_text, monkeypatch):
    x = clustered(300, 0.4)
    x[100:200] = x[3]  # more than one list
    x[210:213] = x[205]
    whole = knn.pivot_blocks
    monkeypatch.setattr(knn, "pivot_blocks", lambda reps, threshold, block, pivots: whole(reps, threshold, block, pivots, copies))
    name = (lambda i: f"{i:04d}") if as_text else int
    points = spark.createDataFrame([(name(i), v.tolist()) for i, v in enumerate(x)], f"id {'string' if as_text else 'long'}, vec array<double>").repartition(4)
    s = np.round(x @ x.T, 9)
    want = {(name(i), name(j)): s[i, j] for i, j in zip(*np.nonzero(np.triu(s > 0.6, 1)))}
    got = [tuple(r) for r in knn.similar_pairs(points, 0.6, block=64, copies=True).collect()]
    assert len(got) == len(want) > 5000 and {(a, z): pytest.approx(score, abs=1e-8) for a, z, score in got} == want
    assert knn.similar_pairs(points, 1.0, block=64, copies=True).count() == 0 == knn.similar_pairs(points.limit(0), 0.6, copies=True).count()


def test_self_join_returns_what_its_sql_does_on_copies_and_repeated_ids(spark, tmp_path):
    x = clustered(60, 0.4, dims=8, centres=6).astype(np.float32)
    x[20:40] = x[3]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += rows[3:6] + [(5, x[50].tolist(), 0), (None, x[3].tolist(), 0), (70, None, 0), (None, None, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(ORACLE["V5_similarity_self_join"]).fetchall()
    got = QUERIES["V5_similarity_self_join"](spark, str(tmp_path)).select("src", "dst", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > len({r[:2] for r in want}) > 500


@pytest.mark.parametrize("copies", [False, True])
def test_vectors_with_nan_keep_no_pair_of_others_away(spark, copies):
    x = clustered(600, 0.05)
    s = np.round(x @ x.T, 9)
    odd = list(range(5, 25))
    s[odd] = s[:, odd] = -1
    x[odd[:10], 3], x[odd[10:], 3] = np.nan, np.inf
    x[odd, 0] = odd
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(s > 0.9, 1)))}
    got = [(r["src"], r["dst"]) for r in knn.similar_pairs(frame(spark, x), 0.9, block=4, copies=copies).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_rows_that_may_meet_all_others_are_not_copied(spark):
    x = clustered(600, 5.0)
    plan = knn.pivot_blocks(frame(spark, x), 0.3, 25)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "MapInArrow" not in plan


def test_spanning_edges_connect_what_all_pairs_connect(spark):
    x = clustered(500, 0.6)
    s = np.round(x @ x.T, 9)
    pairs = list(zip(*np.nonzero(np.triu(s > 0.5, 1))))
    edges = [(r["src"], r["dst"]) for r in knn.similar_pairs(frame(spark, x), 0.5, block=60, spanning=True).coalesce(1).collect()]
    assert components_of(500, edges) == components_of(500, pairs) and all(a < z for a, z in edges) and len(edges) < len(pairs) / 3
    a, z = [i for i in range(40)] * 3, [i + 1 for i in range(40)] * 3
    forest = knn.Forest(limit=5)
    for i, j in zip(a, z):
        forest.add(pa.array([i, j]), np.array([0, 0]))
    assert sum(len(p) for p, _ in forest.edges()) == 40


@pytest.mark.parametrize("as_text", [False, True])
def test_density_settings_share_their_passes(spark, as_text):
    x = np.vstack([clustered(300, 0.5), np.zeros((2, 16))])
    x[40:50] = x[3]
    s = np.round(x @ x.T, 9)
    name = (lambda i: f"{i:04d}") if as_text else (lambda i: i)
    points = spark.createDataFrame([(name(i), v.tolist()) for i, v in enumerate(x)], f"id {'string' if as_text else 'long'}, vec array<double>")
    settings = [(0.6, 2), (0.75, 4), (0.75, 2), (0.9, 3)]
    for (reach, least), found in zip(settings, tags.density_labels(tags.neighbours(points, 0.6), settings), strict=True):
        near = (s >= reach) & ~np.eye(len(x), dtype=bool)
        core = near.sum(axis=1) + 1 >= least
        root = components_of(len(x), [(i, j) for i, j in zip(*np.nonzero(np.triu(near))) if core[i] and core[j]])
        want = {}
        for i in range(len(x)):
            other = np.flatnonzero(near[i] & core)
            want[name(i)] = name(root[i]) if core[i] else name(root[other[0]]) if len(other) else name(-1) if not as_text else "-1"
        assert {r["id"]: r["label"] for r in found.collect()} == want


# ---- search by tiles ----

@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_search_over_many_tiles(spark, limit, monkeypatch):
    x = np.round(clustered(700, 0.5), 1)  # many equal scores
    want = np.argsort(-np.round(x[:90] @ x.T, 9), axis=1, kind="stable")[:, :7]
    monkeypatch.setattr(knn, "TILE_ROWS", 16)
    monkeypatch.setattr(knn, "TILE", 16 * 50)
    tile = max(r.stop - r.start for r, _ in knn._tiles(90, 700)) * max(c.stop - c.start for _, c in knn._tiles(90, 700))
    got = knn.exact_topk(frame(spark, x[:90]), frame(spark, x), 7, block=64, broadcast_bytes=limit).collect()
    assert tile <= 800 and {(r["query_id"], r["rank"]): r["item_id"] for r in got} == {(i, p + 1): int(j) for i, row in enumerate(want) for p, j in enumerate(row)}
    best = list(knn._block_best(x[:90], x, 7))
    assert len(best) == 6 and all(len(r) == 7 * len(set(r.tolist())) for r, _, _ in best)
