"""Inputs that are legal and were once lost, merged or fatal: null sessions, zero vectors, string ids, odd ranks, long values."""

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from rankweave.functions import scalar as sc
from rankweave.operators import clicklog as cl
from rankweave.operators import entities as en
from rankweave.operators import fusion, knn, metrics, tags
from rankweave.operators import trainset as ts

LISTS = "clicks array<map<string,string>>, impressions array<map<string,string>>"


def test_null_sessions_keep_their_rows(spark):
    rows = [(None, "u1", "q", [{"link": "/a", "rank": "1"}], [{"link": "/b", "rank": "2"}, {"link": "/a", "rank": "3"}]),
            (None, "u2", "q", [{"link": "/b", "rank": "1"}], [{"link": "/a", "rank": "4"}]),
            ("s", "u3", "q", [{"link": "/a", "rank": "1"}], [{"link": "/c", "rank": "2"}])]
    items = cl.unnest_sessions(spark.createDataFrame(rows, f"session_id string, user_id string, query string, {LISTS}").withColumn("timestamp", F.lit("0")))
    out = cl.build_dataset(items, cl.LabelConfig(sample_negatives=False)).collect()
    assert sorted((r["user_id"], r["type"], r["nav_link"]) for r in out) == [
        ("u1", "negative", "/b"), ("u1", "positive", "/a"), ("u2", "negative", "/a"), ("u2", "positive", "/b"), ("u3", "negative", "/c"), ("u3", "positive", "/a")]
    for user in ("u1", "u2", "u3"):  # weights are normalized inside a record: two rows, sum two
        assert sum(r["snips_weight"] for r in out if r["user_id"] == user) == pytest.approx(2.0)
    assert sorted((r["user_id"], r["nav_link"]) for r in cl.label_negatives(items).collect()) == [("u1", "/b"), ("u2", "/a"), ("u3", "/c")]
    assert cl.snips(cl.with_weights(cl.label_positives(items.drop("record", "place")))).count() == 3  # items without the new columns


def test_session_aliases_and_list_order(spark):
    rows = [("s1", "1700000000", [{"link": "/z", "rank": "9"}, {"link": "/a", "rank": "1"}], [{"link": "/y", "rank": "8"}, {"link": "/b", "rank": "2"}])]
    items = cl.unnest_sessions(spark.createDataFrame(rows, f"id string, start_time string, {LISTS}"))
    assert {(r["session_id"], r["session_time"]) for r in items.collect()} == {("s1", "2023-11-14T22:13:20+00:00")}
    pair = cl.bpr_pairs(items).first()
    assert (pair["pos_link"], pair["neg_link"]) == ("/z", "/y")  # first of the list, not the best rank


def test_odd_ranks_and_times(spark):
    ranks = ["99999999999", "Infinity", "NaN", "abc", "3", None]
    rows = [("s", [{"link": f"/{i}", "rank": r} for i, r in enumerate(ranks)], [])]
    items = cl.unnest_sessions(spark.createDataFrame(rows, f"session_id string, {LISTS}"))
    got = {r["link"]: r["position"] for r in items.collect()}
    assert got == {"/0": 2147483647, "/1": 1, "/2": 1, "/3": 1, "/4": 3, "/5": None}
    times = ["Infinity", "NaN", "1e300", "-1e300", "0", "yesterday"]
    out = spark.createDataFrame([(t,) for t in times], "t string").select("t", sc.to_iso(F.col("t")).alias("x")).collect()
    assert {r["t"]: r["x"] for r in out} == {t: t for t in times} | {"0": "1970-01-01T00:00:00+00:00"}


VECTORS = [("a", [1.0, 0.0]), ("b", [1.0, 0.01]), ("c", [0.0, 1.0]), ("z1", [0.0, 0.0]), ("z2", [0.0, 0.0]), ("n", None)]


def test_zero_and_null_vectors(spark):
    points = spark.createDataFrame(VECTORS, "id string, vec array<double>")
    assert [(r["src"], r["dst"]) for r in knn.similar_pairs(points, 0.9).collect()] == [("a", "b")]
    labels = tags.density_cluster(points.where("vec is not null"), 0.9, 2)
    got = {r["id"]: r["label"] for r in labels.collect()}
    assert got == {"a": "a", "b": "a", "c": "-1", "z1": "-1", "z2": "-1"}
    assert tuple(tags.cluster_report(labels).first()) == (1, 3, 5)
    assert tags.cosine_silhouette(points, labels).first()["clusters"] == 1
    found = knn.exact_topk(points, points, 2)
    assert {r["query_id"] for r in found.collect()} == {"a", "b", "c", "z1", "z2"} and found.where("item_id = 'n'").count() == 0
    ints = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "id int, vec array<double>")
    for limit in (knn.BROADCAST_BYTES, 0):
        assert knn.exact_topk(ints, ints, 1, broadcast_bytes=limit).where("item_id = 3").count() >= 3


def test_short_tags_are_not_merged_and_a_failing_encoder_fails(spark):
    names = spark.createDataFrame([("C",), ("R",), ("5",)], "tag string")
    zero = names.select("tag", F.array(F.lit(0.0), F.lit(0.0)).alias("vec"))
    assert tags.canonicalize(names, vectors=zero).stats.first()["output_unique"] == 3

    def broken(texts):
        raise ValueError("no model")

    with pytest.raises(PythonException):
        tags.canonicalize(names, encoder=broken).mapping.collect()


def test_string_ids(spark):
    item_tags = spark.createDataFrame([("x-1", "t", 0.9), ("x-2", "t", 0.5), ("y-1", "t", 0.5)], "item_id string, tag string, pop double")
    assert fusion.inverse_tag_index(item_tags, "pop").first()["items"] == ["x-1", "x-2", "y-1"]
    judged = spark.createDataFrame([("q", "art-2", True), ("q", "art-1", True), ("r", "art-3", False)], "question string, article_id string, is_relevant boolean")
    out = ts.consolidate_relevance(judged.select("question"), judged)
    assert {r["question"]: r["gt_docs"] for r in out.collect()} == {"q": ["art-1", "art-2"], "r": []}


def test_long_and_punctuated_dictionary_values(spark):
    words = [("the great big red barn on a very high hill", "P"), ("amazon.com", "M"), ("foo_bar", "M")]
    texts = [(1, "See The Great Big Red Barn on a very high hill!"), (2, "bought at amazon.com, not foo_bar"), (3, "amazon and com are apart")]
    found = en.tag_with_dictionary(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(words, "value string, label string"))
    assert sorted((r["id"], r["value"]) for r in found.collect() if r["id"] < 3) == [(1, words[0][0]), (2, "amazon.com"), (2, "foo_bar")]
    none = spark.createDataFrame([], "value string, label string")
    assert en.tag_with_dictionary(spark.createDataFrame(texts, "id int, text string"), none).count() == 0


def test_no_caps(spark):
    spans = "array<struct<start:int,end:int,label:string>>"
    truth = spark.createDataFrame([(i, "text", [(0, 4, "A")]) for i in range(11)], f"id int, text string, entities {spans}")
    predicted = spark.createDataFrame([(i, []) for i in range(11)], f"id int, entities {spans}")
    assert en.entity_errors(predicted, truth).count() == 11
    many = spark.range(100_001).select(F.concat(F.lit("label "), F.col("id").cast("string")).alias("l"))
    coded = ts.encode_labels(many, "l").agg(F.count("*"), F.min("id"), F.max("id"), F.count_distinct("id")).first()
    assert tuple(coded) == (100_001, 0, 100_000, 100_001)


def test_auc_of_tiny_scores_and_logits(spark):
    import random

    r = random.Random(1)
    for scale, shift in ((1e-6, 0.0), (40.0, -20.0)):
        rows = [(r.random() * scale + shift, r.random() < 0.4) for _ in range(400)]
        pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
        want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
        got = metrics.auc(spark.createDataFrame([(s, float(y)) for s, y in rows], "score double, label double")).first()["auc"]
        assert got == pytest.approx(want)


def test_batches_of_sparse_ids(spark):
    pairs = spark.createDataFrame([(i * 10**15, [float(i), 1.0], [float(i), 1.0]) for i in range(20)], "id long, anchor_vec array<double>, positive_vec array<double>")
    assert metrics.in_batch_ranks(pairs, 8).groupBy("batch").count().count() == 3


def test_stages_of_a_job_are_removed(spark, tmp_path):
    import os

    from rankweave.session import cut_lineage, ensure_checkpoint_dir, job_stages

    ensure_checkpoint_dir(spark)
    with job_stages(spark):
        stage = cut_lineage(spark.range(5))
        folder = stage.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
        stage.write.parquet(str(tmp_path / "out"))
        assert os.path.isdir(folder)
    assert not os.path.exists(folder) and spark.read.parquet(str(tmp_path / "out")).count() == 5
