"""Small inputs with results worked out by hand."""

import datetime as dt

import pytest
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from rankweave.functions import scalar as sc
from rankweave.operators import clicklog as cl
from rankweave.operators import features as ft
from rankweave.operators import fusion
from rankweave.operators import lexical as lx
from rankweave.operators import metrics as mt
from rankweave.operators import text as tx
from rankweave.operators import trainset as ts


def ranking(spark):
    ranked = spark.createDataFrame([("q", x, i + 1) for i, x in enumerate(["m4", "m1", "m9", "m2", "m7", "m3"])], "query_id string, item_id string, rank int")
    truth = spark.createDataFrame([("q", x, i + 1) for i, x in enumerate(["m1", "m2", "m3"])], "query_id string, item_id string, place int")
    return ranked, truth


def test_ranking_metrics(spark):
    ranked, truth = ranking(spark)
    row = mt.ndcg_at_k(ranked, truth, 5).first()
    # worth 3, 2, 1 at places 2, 4, 6; the last is beyond the cut: 3/log2(3) + 2/log2(5) against 3 + 2/log2(3) + 1/2
    assert (row["dcg"], row["idcg"], row["ndcg"]) == pytest.approx((2.754142, 4.761860, 0.578375), abs=1e-6)
    at = mt.precision_recall_at_k(ranked, truth, [5]).first()
    assert (at["precision_5"], at["recall_5"], at["hitrate_5"]) == pytest.approx((2 / 5, 2 / 3, 1.0))
    assert mt.average_precision(ranked, truth).first()["ap"] == pytest.approx((1 / 2 + 2 / 4 + 3 / 6) / 3)


def test_adaptive_k(spark):
    scores = [8.0, 7.5, 7.0, 3.0, 2.5, 1.0]  # gap times score: 4, 3.75, 28, 1.5, 3.75
    ranked = spark.createDataFrame([("q", i + 1, s) for i, s in enumerate(scores)], "query_id string, rank int, score double")
    chosen = fusion.adaptive_k(ranked)
    assert chosen.first()["k"] == 3
    assert fusion.cut_at_k(ranked, chosen).count() == 3
    short = ranked.where("rank <= 2")
    assert fusion.adaptive_k(short, min_k=3).first()["k"] == 2
    with pytest.raises(ValueError):
        fusion.adaptive_k(ranked, min_k=0)


def session(spark):
    schema = "session_id string, user_id string, query string, timestamp string, clicks array<map<string,string>>, impressions array<map<string,string>>, candidates array<map<string,string>>"
    clicks = [{"url": "/a", "rank": "1", "dwell": "75", "timestamp": "1700000000"}, {"link": "/b", "position": "2"}]
    shown = [{"nav_link": "/c", "position": "3", "skip_type": "scrolled"}, {"nav_link": "/d", "position": "4"}]
    pool = [{"url": f"/h{i}", "rank": str(100 + i)} for i in range(1, 20)] + [{"url": f"/r{i}", "rank": str(5 + i)} for i in range(10)] + [{"url": "/a", "rank": "150"}, {"url": None, "link": "/x"}]
    return spark.createDataFrame([("s", "u", "q", "1700000000000", clicks, shown, pool)], schema)


def test_session_weights(spark):
    items = cl.unnest_sessions(session(spark))
    rows = cl.build_dataset(items, cl.LabelConfig(sample_negatives=False)).orderBy("position").collect()
    assert [r["propensity"] for r in rows] == pytest.approx([0.707107, 0.577350, 0.5, 0.447214], abs=1e-6)
    assert [r["snips_weight"] for r in rows] == pytest.approx([0.766269, 0.938484, 1.083668, 1.211578], abs=1e-6)
    assert [r["type"] for r in rows] == ["positive", "positive", "negative", "negative"]
    assert rows[0]["click_time"] == "2023-11-14T22:13:20+00:00" and rows[0]["session_time"] == "2023-11-14T22:13:20+00:00"
    assert [r["skip_type"] for r in rows] == [None, None, "scrolled", "impression"]


def test_sampled_negatives(spark):
    items = cl.unnest_sessions(session(spark))
    rows = cl.sample_negatives(items).collect()
    links = [r["nav_link"] for r in rows]
    assert len(links) == len(set(links)) == 6  # 3 for each of 2 clicked links
    assert not {"/a", "/b", "/c", "/d", "/x"} & set(links)  # a null url is present, so /x is not read
    assert sum(r["skip_type"] == "sampled_hard" for r in rows) == 4  # round(0.7 * 6)
    unknown = cl.propensity(F.lit(None).cast("int"))
    assert spark.range(1).select(unknown.alias("p")).first()["p"] == 0.2


def test_window_features(spark):
    at = lambda day, hour: dt.datetime(2025, 10, day, hour)
    users = spark.createDataFrame([(101,), (102,)], "user_id int")
    tx_rows = [(at(11, 19), 101, 10.0, "a"), (at(1, 19), 101, 30.0, "b"), (at(13, 19), 101, 99.0, "a")]
    events = [(at(12, 20), 101, "nav_click", "x"), (at(12, 21), 101, "nav_click", "x"), (at(9, 19), 101, "nav_click", "y"), (at(13, 8), 101, "search", "x")]
    tx_df = spark.createDataFrame(tx_rows, "ts timestamp, user_id int, amount double, category string")
    ev = spark.createDataFrame(events, "ts timestamp, user_id int, event_type string, detail string")
    now = "2025-10-13 19:00:00"
    out = {r["user_id"]: r for r in ft.trend_ratio(ft.window_features(users, tx_df, ev, now)).collect()}
    r = out[101]
    assert [r[f"transaction_count_{w}d"] for w in (1, 7, 30, 90)] == [0, 1, 2, 2]
    assert [r[f"avg_transaction_amount_{w}d"] for w in (1, 7, 30)] == [0.0, 10.0, 20.0]
    assert (r["nav_clicks_1d"], r["search_queries_1d"], r["unique_nav_links_7d"]) == (2, 1, 2)
    assert r["transaction_trend_7d_vs_30d"] == 0.5
    assert out[102]["transaction_count_90d"] == 0
    spent = ft.decayed_spend(tx_df, now, (7,)).where("category = 'a'").first()
    assert spent["spending_decay_7d"] == pytest.approx(10.0 * 0.5 ** (2 / 3.5))
    assert [x["days_since_last_y"] for x in ft.recency(users, ev, ["y"], now).orderBy("user_id").collect()] == [4, -1]


DOCS = [
    "The quick brown fox jumps over the lazy dog", "A fast brown dog leaps over a lazy fox", "Information retrieval finds the documents a user wants",
    "Retrieval of a dog picture",
]


def test_bm25_against_formula(spark):
    import math

    stop = StopWordsRemover.loadDefaultStopWords("english")
    docs = spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string")
    queries = spark.createDataFrame([(0, "quick dog retrieval dog")], "query_id long, text string")
    tokens = [[w for w in d.lower().split() if len(w) > 1 and w not in stop] for d in DOCS]
    mean = sum(map(len, tokens)) / len(tokens)

    def weight(term, i):
        df = sum(term in t for t in tokens)
        tf = tokens[i].count(term)
        return math.log(1 + (len(tokens) - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * len(tokens[i]) / mean))

    want = {i: sum(weight(t, i) for t in ("quick", "dog", "retrieval")) for i in range(4)}
    stored = lx.bm25_search(lx.bm25_index(docs, "text", stop_words=stop), queries, "text", 10, stop).collect()
    direct = lx.bm25_search_docs(docs, queries, "text", 10, stop_words=stop).collect()
    for rows in (stored, direct):
        assert {r["doc_id"]: r["score"] for r in rows} == pytest.approx(want)
        assert [r["rank"] for r in sorted(rows, key=lambda r: -r["score"])] == [1, 2, 3, 4]


SHELVES = {
    "oak": ["wood", "tall", "open", "brown"], "pine": ["wood", "tall", "open", "white"], "ash": ["wood", "tall", "open", "white"],
    "rack": ["steel", "low", "wheels", "grey"], "cube": ["wood", "low", "doors", "black"], "loft": ["glass", "tall", "doors", "clear"],
}


def test_overlap_triplets(spark):
    items = spark.createDataFrame(list(SHELVES.items()), "item_id string, tags array<string>")
    rows = {r["anchor"]: r for r in ts.overlap_triplets(items).collect()}
    assert set(rows) == {"oak", "pine", "ash"}  # only these share more than half of their tags with another
    sets = {k: set(v) for k, v in SHELVES.items()}
    for anchor, r in rows.items():
        assert len({anchor, r["positive"], r["negative"]}) == 3
        assert len(sets[anchor] & sets[r["positive"]]) > len(sets[anchor]) / 2
        assert len(sets[r["positive"]] & sets[r["negative"]]) >= len(sets[r["positive"]]) / 2


def test_zip_pad_and_passages(spark):
    df = spark.createDataFrame([(1, ["p0", "p1", "p2"], ["n0", "n1"]), (2, ["p"], []), (3, [], ["n"])], "id int, pos array<string>, neg array<string>")
    assert [(r["i"], r["positive"], r["negative"]) for r in ts.zip_cycle(df, "pos", "neg").orderBy("i").collect()] == [(0, "p0", "n0"), (1, "p1", "n1"), (2, "p2", "n0")]
    few = spark.createDataFrame([("a", ["x", "y"]), ("b", [])], "positive string, negatives array<string>")
    assert [r["negatives"] for r in ts.pad_negatives(few, 3).orderBy("positive").collect()] == [["x", "y", "x"], ["b", "b", "b"]]
    nested = spark.createDataFrame(
        [("q", ([0, 1, 0, 0, 0, 0, 1], list("abcdefg"))), ("r", ([1, 0], ["a", "b"]))], "query string, passages struct<is_selected:array<int>,passage_text:array<string>>")
    rows = ts.passage_triplets(ts.explode_passages(nested)).collect()
    assert [tuple(r) for r in rows] == [("q", "b", "a", "c", "d", "e", "f")]


def test_class_triplets_edges(spark):
    df = spark.createDataFrame([("one", "a")] + [(f"t{i}", "b") for i in range(3)] + [("both", "a2"), ("both", "b")], "text string, label string")
    rows = ts.class_triplets(df, "text", "label", 2, 3).collect()
    of = lambda c, a, k: sorted(r["text"] for r in rows if (r["class"], r["anchor"], r["kind"]) == (c, a, k))
    assert of("a", "one", "positive") == ["one", "one"]  # a class of one text uses itself
    assert len(of("a", "one", "negative")) == 3 and "one" not in of("a", "one", "negative")
    assert set(of("b", "t0", "negative")) == {"one"}  # "both" is used by class b, so only one text is left
    assert "t0" not in of("b", "t0", "positive")
    with pytest.raises(ValueError):
        ts.class_triplets(df.where("label = 'a'"), "text", "label")


def test_text_helpers(spark):
    df = spark.createDataFrame([("I love this great GREAT thing",), ("bad",), ("so so",)], "text string")
    got = {r["text"]: (r["sentiment"], r["confidence"]) for r in tx.sentiment(df, "text").collect()}
    assert got == {"I love this great GREAT thing": ("positive", 1.0), "bad": ("negative", 1.0), "so so": ("neutral", 0.5)}
    assert tx.substring_search(df, "", ["text"]).count() == 3
    assert tx.substring_search(df, "LOVE", ["text"]).count() == 1
    titles = ["Hello World", "hello", "Hello world", "HELLO", "It'S", "A1B2", "123"]
    rows = spark.createDataFrame([(t,) for t in titles], "t string").select("t", sc.is_title_case(F.col("t")).alias("x")).collect()
    assert {r["t"]: r["x"] for r in rows} == {t: t.istitle() for t in titles}
    listed = spark.createDataFrame([("1. one\n12. two\n\n7\nplain",)], "t string").select(ts.parse_numbered_list(F.col("t")).alias("l")).first()["l"]
    assert listed == ["one", "two", "7", "plain"]
