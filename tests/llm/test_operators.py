"""Every operator against its plain version: the small driver tables and the odd rows, empty tables, order of the rows."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankweave.llm import decontaminate, license_scan, line_dedup, lm_score, mixing, near_dedup, quality_classifier, quality_rules, sharding, token_counts
from rankweave.llm.wordscan import STEP, WordScanner
from tests.llm import plain


def documents(spark, base):
    df = spark.read.parquet(f"{base}/documents.parquet")
    return df, [(r["doc_id"], r["text"]) for r in df.collect()]


def crc_is(rest):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == rest


# ---- words ----

@pytest.mark.parametrize("letters", [False, True])
def test_words_have_equal_hashes_everywhere(letters):
    pattern = plain.LETTER_WORD if letters else plain.SPACE_WORD
    texts = [None, "", "  a b  a", "É\x0bA\x00z é", "x" * 3 * STEP, "tail", "a" * (STEP - 1) + " " + "a", "B b\nB"]
    scanner = WordScanner(letters)
    hashes, bounds = scanner.scan(pa.array(texts))
    seen = {}
    for i, text in enumerate(texts):
        own = plain.words(text, pattern)
        assert len(own) == bounds[i + 1] - bounds[i]
        for word, h in zip(own, hashes[bounds[i]:bounds[i + 1]].tolist()):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
    sliced, cut = scanner.scan(pa.array(texts).slice(2, 2))
    assert sliced.tolist() == hashes[bounds[2]:bounds[4]].tolist() and len(cut) == 3


# ---- 1 ----

def contaminated(docs, items):
    found = decontaminate.find_contamination(docs, items)
    return sorted(((r["id"], r["n_words"], r["n_hit"], r["items"]) for r in found.collect() for _ in range(r["copies"])), key=str)


def test_decontamination_matches_windows(spark, base):
    docs, rows = documents(spark, base)
    items = spark.read.parquet(f"{base}/benchmark.parquet")
    want = plain.contamination(rows, [(r["item_id"], r["text"]) for r in items.collect()])
    got = contaminated(docs, items)
    assert got == sorted(want, key=str) and any(w[2] for w in want)


def test_decontamination_of_odd_rows(spark, odd, odd_rows, empty):
    items = [(1, "One"), (2, None), (3, ""), (4, "again and AGAIN"), (5, odd_rows[5][1]), (6, "日本語"), (7, " ".join(odd_rows[4][1].split()[100:110])), (7, "One"), (None, "nobody knows whose text")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [r[:2] for r in odd_rows]
    assert any(r[2] == 0 and r[1] > 3 for r in contaminated(odd, bench.where("item_id is null")))  # a null item is found but has no name
    named = bench.where("item_id is not null")
    assert contaminated(odd, named) == sorted(plain.contamination(docs, [x for x in items if x[0] is not None]), key=str)
    assert all(r[2] == 0 for r in contaminated(odd, named.limit(0)))
    assert contaminated(empty, named) == []
    clean = decontaminate.clean(odd, decontaminate.find_contamination(odd, named))
    assert clean.columns == odd.columns
    assert Counter(r["text"] for r in clean.collect()) == Counter(t for (_, t), w in zip(docs, plain.contamination(docs, [x for x in items if x[0] is not None])) if not w[2])


# ---- 2 ----

def test_line_dedup_of_odd_rows(odd, odd_rows, empty):
    got = line_dedup.dedup_lines(odd, batches=3)
    rows = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got.collect()), key=str)
    want = plain.kept_lines([r[:2] for r in odd_rows])
    assert rows == sorted(want, key=str) and any(w[2] for w in want)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_of_string_ids(spark, base):
    docs, rows = documents(spark, base)
    named = docs.select(F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("doc_id"), "text")
    rank = [(f"doc {i}", t) for i, t in rows]
    got = line_dedup.dedup_lines(named, batches=3)
    assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got.collect()) == sorted(plain.kept_lines(rank))


@pytest.mark.parametrize("batches,fanout", [(1, 2), (5, 2), (7, 3)])
def test_runs_do_not_change_the_result(spark, base, batches, fanout):
    docs, rows = documents(spark, base)
    got = line_dedup.dedup_lines(docs, batches=batches, fanout=fanout)
    assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got.collect()) == sorted(plain.kept_lines(rows))


# ---- 3 ----

def check_shards(rows, shards, slack):
    load, slots = Counter(), defaultdict(list)
    for r in rows:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r["size"] for r in rows)
    share = sum(load.values()) / shards
    assert max(load.values()) <= share * (1 + slack) + largest
    return load


def test_shards_are_near_equal(spark, base):
    docs, rows = documents(spark, base)
    out = sharding.shard_by_size(docs, "text", "doc_id").collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, _ in rows)
    assert all(r["size"] == len((r["text"] or "").encode()) + 1 for r in out)
    check_shards(out, 16, 0.05)
    again = sharding.shard_by_size(docs.repartition(5), "text", "doc_id").collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in out} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}


def test_hot_texts_are_subdivided_and_small_groups_stay_together(spark):
    rows = [(i, "the same text " * 3) for i in range(2000)] + [(10_000 + i, f"text {i % 1500} of a pair") for i in range(3000)]
    out = sharding.shard_by_size(spark.createDataFrame(rows, "doc_id long, text string"), "text", "doc_id", shards=8).collect()
    load = check_shards(out, 8, 0.03)
    assert max(load.values()) - min(load.values()) < 0.05 * sum(load.values()) / 8
    homes = defaultdict(set)
    for r in out:
        homes[r["text"]].add(r["shard"])
    assert sum(len(h) > 1 for h in homes.values()) == 1


def test_shards_of_odd_rows(odd, empty):
    out = sharding.shard_by_size(odd, "text", "doc_id").collect()
    assert len(out) == odd.count()
    check_shards(out, 16, 0.05)
    assert sharding.shard_by_size(empty, "text", "doc_id").count() == 0


# ---- 4 ----

def test_language_model(spark, base):
    docs, rows = documents(spark, base)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    want, n = plain.base_scores(rows, held)
    got = {r["id"]: r for r in lm_score.score_texts(docs, crc_is(1)).collect()}
    for (ident, _), (tokens, known, score) in zip(rows, want):
        r = got[ident]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (tokens, known, n, held(ident))
        assert r["base_score"] == pytest.approx(score, rel=1e-9)
    for side in (True, False):
        own = [r for r in got.values() if r["held_out"] is side]
        assert sum(r["score"] for r in own) > sum(r["base_score"] for r in own)  # pairs help, also on held-out texts
    other = {r["id"]: r for r in lm_score.score_texts(docs, crc_is(1), filter_bytes=20_000, frequent_words=100).collect()}
    for ident, r in got.items():  # several broadcasts and joined rare words: the same numbers
        assert other[ident]["score"] == pytest.approx(r["score"]) and other[ident]["base_score"] == pytest.approx(r["base_score"]) and other[ident]["n_known"] == r["n_known"]


def test_language_model_of_odd_rows(odd, odd_rows, empty):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    want, n = plain.base_scores([r[:2] for r in odd_rows], held)
    got = lm_score.score_texts(odd, crc_is(1)).collect()
    assert sorted((r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == sorted((a, b, round(c, 6)) for a, b, c in want)
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)
    assert lm_score.score_texts(empty, crc_is(1)).count() == 0
    assert all(r["n_known"] == 0 for r in lm_score.score_texts(odd, F.lit(True)).collect())  # nothing to learn from


def test_filter_never_misses_a_count():
    key = lm_score.mix(np.arange(1, 5001, dtype=np.uint64))
    count = np.arange(5000) % 700 + 1
    key, order = np.sort(key), np.argsort(key)
    count = count[order]
    parts = {}
    for b in range(1 << lm_score.BUCKET_BITS):
        own = key >> np.uint64(64 - lm_score.BUCKET_BITS) == b
        if own.any():
            parts[b] = lm_score.build_segment(key[own], count[own]).tobytes()
    found = lm_score.LogFrequencyFilter(parts)
    level = np.searchsorted(lm_score.LEVELS, count, "right")
    assert (found.levels(key) >= level).all() and (found.levels(key) == level).mean() > 0.9
    assert (found.levels(lm_score.mix(np.arange(10_000, 20_000, dtype=np.uint64))) > 0).mean() < 0.1


# ---- 5 ----

def test_token_counts(spark, base, odd, odd_rows, empty):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    docs, rows = documents(spark, base)
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(docs.select("doc_id", "text"), path).collect()}
    assert got == {i: (len(t.encode()), len(model.encode(t)), len(model.encode(t)) > 4096) for i, t in rows}
    special = [" ", "  ", "a ", " a", "a  b", "▁", "a▁b ▁ c", "<s> </s><unk>", "\n\n", "\x00 \x00", "x" * 200, "é 日本 \U0001F600", "a b", "tab\t tab"]
    both = spark.createDataFrame(list(enumerate(special)), "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    for batch_bytes in (token_counts.BATCH_BYTES, 64):  # 64: every longer text is split
        out = token_counts.count_tokens(both, path, batch_bytes=batch_bytes).collect()
        assert sorted((r["n_bytes"], r["n_tokens"]) for r in out) == sorted((len((t or "").encode()), len(model.encode(t or ""))) for t in [*special, *[r[1] for r in odd_rows]])
    assert token_counts.count_tokens(empty, path).count() == 0


# ---- 6 ----

def test_near_duplicates(spark, base):
    docs, rows = documents(spark, base)
    want = plain.components(rows)
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, size=2).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(want)


def test_near_duplicate_chains_and_hot_groups(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[2 * i:2 * i + 60])) for i in range(40)]  # each like its neighbours, ends unlike
    rows += [(100 + i, " ".join([*words[200:300], f"x{i}"])) for i in range(300)]  # a group of near copies
    rows += [(500 + i, " ".join([*words[300:330], *[f"y{i}_{j}" for j in range(25)]])) for i in range(120)]  # half in common, never linked
    rows += [(700 + i, "the very same words in every one of these") for i in range(200)]
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()}
    assert got == plain.components(rows)


def test_crowded_buckets_in_parts(spark, monkeypatch):
    r = random.Random(3)
    core = [f"c{i}" for i in range(120)]
    vary = lambda i, n: " ".join([f"v{i}_{j}" if j in picked else w for picked in [set(r.sample(range(120), n))] for j, w in enumerate(core)])
    rows = [(i, vary(i, r.choice([1, 3, 5, 7, 9]))) for i in range(150)]  # around the limit of similarity, in every bucket
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain.components(rows)
    assert 1 < len({c for _, c in want.values()}) < 150
    for part_rows, cells in ((near_dedup.PART_ROWS, near_dedup.MATRIX_CELLS), (20, 500)):
        monkeypatch.setattr(near_dedup, "PART_ROWS", part_rows)
        monkeypatch.setattr(near_dedup, "MATRIX_CELLS", cells)
        assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, size=2).collect()} == want


def test_intersections_of_a_block():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (0, 1, 30, 50, 70)]
    flat, cut = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
    both = near_dedup._intersections(flat, cut)
    assert all(both[i, j] == len(set(a.tolist()) & set(b.tolist())) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)


def test_near_duplicates_of_odd_rows(odd, odd_rows, empty):
    got = near_dedup.near_duplicates(odd, size=2).collect()
    want = plain.components({r[0]: r[1] for r in odd_rows if r[0] is not None}.items())
    assert len(got) == len(odd_rows)
    for r in got:
        if r["id"] is None:
            assert r["kept"] and r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["id"]] and r["kept"] == (r["id"] == want[r["id"]][1])
    assert near_dedup.near_duplicates(empty).count() == 0
    kept = near_dedup.clean(odd, near_dedup.near_duplicates(odd, size=2))
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r[0] for r in odd_rows if r[0] is None or want[r[0]][1] == r[0])


def test_circulant_signatures_estimate_jaccard():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64) * np.uint64(2)
    b = np.concatenate([a[:300], rng.integers(0, 2**63, 100, dtype=np.uint64)])
    hasher = near_dedup.CirculantMinHash(255)
    assert abs((hasher.signature(a) == hasher.signature(b)).mean() - 0.6) < 0.1


# ---- 7 ----

def test_counts_of_quality_rules(odd, odd_rows):
    got = quality_rules.quality_rules(odd, keep=["doc_id", "text"]).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        n = plain.text_counts(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert r["base_failed"] == (n[0] < 50 or 2 * n[4] > n[0])
        assert r["kept"] == (not r["base_failed"])  # too few for an estimate


def test_outliers_go_and_clean_documents_stay(spark, base, empty):
    docs = spark.read.parquet(base.replace("0.001", "0.01") + "/documents.parquet")
    labels = spark.read.parquet(base.replace("0.001", "0.01") + "/labels.parquet")
    out = quality_rules.quality_rules(docs).cache()
    assert set(docs.columns) <= set(out.columns)
    judged = out.join(labels, "doc_id").where(~F.col("base_failed")).groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    rate = {r["quality"]: r["kept"] for r in judged}
    assert rate[1] > 0.99 and rate[0] < 0.1
    again = quality_rules.quality_rules(docs.repartition(7)).select("doc_id", "kept", "distance")
    assert sorted(again.collect()) == sorted(out.select("doc_id", "kept", "distance").collect())
    assert quality_rules.quality_rules(empty).count() == 0


def test_estimate_ignores_a_third_of_outliers(spark):
    rng = np.random.default_rng(5)
    names = [f"v_{k}" for k in ("word_length", "symbols", "same_lines", "repeats", "capitals")]
    good = rng.multivariate_normal([1, 1, 1, 1, 1], np.diag([.5, .4, .6, .5, .3]) + 0.1, 1400)
    bad = rng.normal(9, 0.2, (500, 5))
    rows = [(1, *map(int, np.round(r * quality_rules.UNIT))) for r in np.vstack([good, bad])]
    est = quality_rules.robust_estimates(spark.createDataFrame(rows, ["__g", *names]), names).first()
    assert all(abs(est[f"m_{i}"] - 1) < 0.15 for i in range(5))


def test_groups_that_do_not_settle_keep_their_least_determinant(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "MOST_STEPS", 1)
    rng = np.random.default_rng(6)
    names = [f"v_{k}" for k in ("word_length", "symbols", "same_lines", "repeats", "capitals")]
    rows = [(1, *map(int, np.round(r * quality_rules.UNIT))) for r in np.vstack([rng.normal(1, 0.5, (300, 5)), rng.normal(4, 0.1, (100, 5))])]
    est = quality_rules.robust_estimates(spark.createDataFrame(rows, ["__g", *names]), names).collect()
    assert len(est) == 1 and est[0]["settled"] is False and est[0]["limit"] > 0


# ---- 8 ----

def test_license_scan(spark, odd, empty):
    known = license_scan.known_digests(spark)
    mit = license_scan.KNOWN[0][2]
    rows = [(1, "Copyright (c) 2019 Somebody\nAll rights reserved.\n\n" + mit.upper().replace(" ", "  \n")), (2, mit + " and more"), (3, "x\n  released under the MIT LICENCE\nLicensed under CC BY-NC 4.0\nreleased under the mit license!"), (4, None), (5, "")]
    got = {r["id"]: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()}
    assert got[1]["license"] == "MIT" and got[2]["license"] is None
    assert (got[3]["license"], got[3]["n_license_lines"], got[3]["line_licenses"]) == (None, 3, "CC-BY-NC-4.0,MIT")
    assert got[4]["digest"] == got[5]["digest"] and got[4]["n_license_lines"] == 0
    assert license_scan.scan_licenses(odd, known).count() == odd.count() and license_scan.scan_licenses(empty, known).count() == 0


# ---- 9 ----

def test_classifier_on_held_out_rows(spark, base):
    at = base.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    out = quality_classifier.classify(docs, labels, crc_is(0)).withColumnRenamed("id", "doc_id").join(labels, "doc_id").toPandas()
    assert out["score"].between(0, 1).all()
    held = out[out["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.93
    # labels of held-out rows change nothing
    other = quality_classifier.classify(docs, labels.withColumn("quality", F.when(crc_is(0), 1 - F.col("quality")).otherwise(F.col("quality"))), crc_is(0))
    assert sorted(other.select("id", "score").collect()) == sorted(map(tuple, out_of(docs, labels)))


def out_of(docs, labels):
    return quality_classifier.classify(docs, labels, crc_is(0)).select("id", "score").collect()


def test_draw_of_labelled_rows_is_bounded(spark):
    rows = spark.range(20_000).select("id", F.lit(False).alias("held_out"), F.array(*[F.col("id").cast("double")] * len(quality_classifier.FEATURES)).alias("x"))
    labels = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    whole, _ = quality_classifier.training_sample(rows, labels, "doc_id", "quality", 20_000)
    x, y = quality_classifier.training_sample(rows, labels, "doc_id", "quality", 500)
    assert len(whole) == 20_000 and len(x) == len(y) == 500
    assert x[:, 0].tolist() == whole[:500, 0].tolist()


def test_classifier_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(5, 1), (13, 0), (6, 1), (6, None), (99, 0), (None, 1), (8, 7)], "doc_id long, quality int")
    out = quality_classifier.classify(odd, labels, crc_is(0)).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["score"] == 0.5 for r in quality_classifier.classify(odd, labels.limit(0), crc_is(0)).collect())
    assert quality_classifier.classify(empty, labels, crc_is(0)).count() == 0


# ---- 10 ----

def mixed(docs):
    return mixing.mix_sources(docs, F.col("source"), mixing.word_size(F.col("text")), [F.col("doc_id"), F.xxhash64("text")])


def test_mix_meets_its_targets(spark, base):
    docs, rows = documents(spark, base)
    out = mixed(docs).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    text = dict(rows)
    for r in out:
        assert r["size"] == len(plain.words(text[r["doc_id"]])) and 0 <= r["copies"] <= 2
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
    want = plain.targets(sizes)
    largest = max(r["size"] for r in out)
    for r in out:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    assert all(abs(taken[s] - want[s]) <= largest for s in want)
    assert {(r["doc_id"], r["copies"]) for r in mixed(docs.repartition(5)).collect()} == {(r["doc_id"], r["copies"]) for r in out}
    assert mixing.repeated(mixed(docs), docs.columns).count() == sum(r["copies"] for r in out)


def test_larger_budgets_contain_smaller_ones(spark, base):
    docs, _ = documents(spark, base)
    take = lambda share: {r["doc_id"]: r["copies"] for r in mixing.mix_sources(docs, F.col("source"), mixing.word_size(F.col("text")), [F.col("doc_id")], share=share).collect()}
    small, large = take(0.3), take(0.6)
    assert all(small[i] <= large[i] for i in small)


def test_mix_of_odd_rows(odd, odd_rows, empty):
    out = mixed(odd).collect()
    assert len(out) == len(odd_rows) and odd.columns[:4] == ["doc_id", "text", "lang", "source"]
    sizes = defaultdict(int)
    for _, text, _, source in odd_rows:
        sizes[source] += len(plain.words(text))
    want = plain.targets(sizes)
    assert all(r["target"] == pytest.approx(want[r["source"]]) and r["copies"] <= 2 for r in out)
    assert mixed(empty).count() == 0
