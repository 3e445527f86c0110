"""Packing: every token once, full windows, and neighbours as a plain BM25 ranks them."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
import tokenizers
from pyspark.sql import functions as F

from rankweave.llm import queries_packing
from rankweave.llm import retrieval_packing as rp

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return tokenizers.Tokenizer.from_file(FILE)


def check_pieces(pieces, rows, tokenizer, window):
    """All ids of all documents once, sequences gapless, full or a power of two."""
    want = Counter((i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])) for i, t in rows)
    found = defaultdict(list)
    for p in pieces:
        assert p["length"] * 4 == len(p["ids"])
        found[p["id"]].append((p["start"], np.frombuffer(p["ids"], "<u4").tolist(), p["doc_tokens"]))
    if max(Counter(i for i, _ in rows).values(), default=0) == 1:
        for (ident, ids), _ in want.items():
            own = sorted(found[ident])
            assert sum((x for _, x, _ in own), []) == list(ids)
            assert [s for s, _, _ in own] == np.cumsum([0, *[len(x) for _, x, _ in own[:-1]]]).tolist() and {n for *_, n in own} == {len(ids)}
    else:
        assert Counter(x for own in found.values() for _, ids, _ in own for x in ids) == Counter(x for (_, ids), n in want.items() for x in ids for _ in range(n))
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for s in sequences.values():
        s.sort()
        total = sum(n for _, n in s)
        assert [o for o, _ in s] == np.cumsum([0, *[n for _, n in s[:-1]]]).tolist()
        assert total <= window and total.bit_count() == 1
    return sequences


def test_encoder_gives_the_ids_of_the_library(tokenizer, monkeypatch):
    texts = ["", " ", "a", "  two  spaces ", "it's we'll", "<|endoftext|>", "x<|endoftext|> y <|endoftext", "é 日本 \U0001F600", "\t\n \x0b\x85 z", "a　 b", "word " * 50]
    encoder = rp.Encoder(FILE)
    assert encoder.fast is not None
    slow = rp.Encoder(FILE)
    slow.fast = None
    for part in (rp.PART, 3):
        monkeypatch.setattr(rp, "PART", part)
        for t in texts:
            assert encoder.ids(t).tolist() == slow.ids(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    assert rp.Encoder(public_tokenizers.path("word_bpe_49k.json")).fast is None  # another kind of file


def test_blanks_beyond_the_pattern_engine(tokenizer):
    text = " " * 1_500_000 + "x"
    assert rp.Encoder(FILE).ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("window,shard_tokens", [(1024, 1 << 19), (64, 3000)])
def test_every_token_once(spark, base, tokenizer, window, shard_tokens):
    docs = spark.read.parquet(f"{base}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    pieces = rp.pack_documents(docs, FILE, window=window, shard_tokens=shard_tokens).collect()
    sequences = check_pieces(pieces, rows, tokenizer, window)
    full = sum(sum(n for _, n in s) == window for s in sequences.values())
    assert full >= len(sequences) - 10 * len({i >> 32 for i in sequences})
    again = rp.pack_documents(docs.repartition(5), FILE, window=window, shard_tokens=shard_tokens).collect()
    assert sorted(map(tuple, pieces)) == sorted(map(tuple, again))


def test_query_columns(spark, base):
    out = queries_packing.op12(spark, base)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert dict(out.dtypes) == {c: "bigint" for c in out.columns}


def test_packing_of_odd_rows(spark, odd, odd_rows, empty, tokenizer):
    rows = [r[:2] for r in odd_rows]
    for window in (1024, 16):
        check_pieces(rp.pack_documents(odd, FILE, window=window).collect(), rows, tokenizer, window)
    assert rp.pack_documents(empty, FILE).count() == 0


def test_hot_topics_and_tiny_documents_are_split(spark):
    rows = [(i, "the same copied passage of text " * 4) for i in range(3000)] + [(9000 + i, None) for i in range(3000)] + [(20_000 + i, f"other words {i}") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stored = rp.cut_lineage(rp.tokenised(docs, FILE, "doc_id", "text", 1024, 0))
    sizes = [r["s"] for r in rp.sharded(stored, 10_000).groupBy("shard").agg(F.sum(F.col("length") + rp.ROW_COST).alias("s")).collect()]
    assert len(sizes) > 20 and max(sizes) < 15_000


def test_neighbours_match_plain_bm25(spark, base, tokenizer):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{base}/documents.parquet").collect()]
    stored = rp.cut_lineage(rp.tokenised(spark.createDataFrame(rows, "doc_id long, text string"), FILE, "doc_id", "text", 1024, 0))
    stats = rp.statistics(stored)
    counts = {i: Counter(tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in rows}
    df = Counter(x for c in counts.values() for x in c)
    mean = sum(sum(c.values()) for c in counts.values()) / len(rows)
    assert stats.mean_length == pytest.approx(mean) and {i: n for i, n in enumerate(stats.df.tolist()) if n} == df

    def weight(ident, term):
        tf, n = counts[ident][term], sum(counts[ident].values())
        return math.log1p((len(rows) - df[term] + 0.5) / (df[term] + 0.5)) * tf * (rp.K1 + 1) / (tf + rp.K1 * (1 - rp.B + rp.B * n / mean)) if tf else 0

    last = stored.where("start + length = doc_tokens and length < 1024").toArrow().combine_chunks()
    ids = last.column("id").to_pylist()
    index = rp.ShardIndex(last, stats, asked=10_000)
    assert any(n > 1024 for n in last.column("doc_tokens").to_pylist())
    for seed in range(0, len(ids), 23):
        unused = np.arange(len(ids)) % 2 == 1
        score = {j: sum(weight(x, t) for t in counts[ids[seed]]) for j, x in enumerate(ids) if unused[j]}
        got = index.neighbours(seed, unused).tolist()
        assert set(got) == {j for j, s in score.items() if s > 0}
        assert [round(score[j], 6) for j in got] == sorted((round(score[j], 6) for j in got), reverse=True)


def test_windows_hold_neighbours_first():
    class Fixed:
        def neighbours(self, seed, unused):
            return np.array([x for x in {0: [3, 1], 1: [4]}.get(seed, []) if unused[x]], np.int64)

    got = rp.fill_windows(np.array([4, 5, 3, 4, 6]), Fixed(), 10)
    # 3 goes whole, 1 is cut and seeds the next window, which takes 4; then the next unused
    assert got == [[(0, 0, 4), (3, 0, 4), (1, 0, 2)], [(1, 2, 3), (4, 0, 6), (2, 0, 1)], [(2, 1, 2)]]
    assert rp.powers([(0, 0, 5), (1, 2, 6)]) == [[(0, 0, 5), (1, 2, 3)], [(1, 5, 2)], [(1, 7, 1)]]
