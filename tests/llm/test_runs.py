"""Run detection against a plain scan of all periods."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from rankweave.llm import queries_runs, run_detection
from tests.llm import plain


def plain_runs(words, least=12):
    """Every stretch of equal words at every distance, of equal stretches the least distance."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        at = 0
        while at < n - q:
            start = at
            while at < n - q and words[at] == words[at + q]:
                at += 1
            length = at - start + q
            if at > start and length >= max(least, 2 * q):
                found.setdefault((start, length), q)
            at += at == start or at < n - q
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def rewritten(doc_id, words):
    """The words of a document as the query's contract changes them."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def repeating(rng):
    n, letters = rng.randint(0, 120), rng.choice([1, 2, 3, 5, 50])
    words = [rng.randint(0, letters) for _ in range(n)]
    if n > 3 and rng.random() < 0.6:
        p, s = rng.randint(1, n // 2 + 1), rng.randint(0, n - 1)
        for i in range(s, n):
            words[i] = words[s + (i - s) % p]
    return words


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("long_line", [run_detection.LONG_LINE, 10])
@pytest.mark.parametrize("least", [2, 12])
def test_runs_match_all_periods(monkeypatch, long_line, least):
    monkeypatch.setattr(run_detection, "LONG_LINE", long_line)
    rng = random.Random(4)
    texts = [repeating(rng) for _ in range(600)]
    texts += [fibonacci(400), [i.bit_count() & 1 for i in range(600)], [0] * 300, [0, 1] * 150 + [2] + [0, 1] * 99, fibonacci(150) * 3, []]
    value = run_detection.mix(np.arange(1, 60, dtype=np.uint64))
    words = np.concatenate([value[np.array(t, np.int64)] for t in texts])
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = {}
    for text, *run in zip(*(x.tolist() for x in run_detection.runs_of_texts(words, bounds, least)), strict=True):
        got.setdefault(text, []).append(tuple(run))
    assert all(got.get(i, []) == plain_runs(t, least) for i, t in enumerate(texts)) and sum(map(len, got.values())) > 500


def test_words_differ_by_case():
    hashes, bounds = run_detection.CaseScanner().scan(pa.array(["A a b", "a"]))
    assert len(set(hashes.tolist())) == 3 and hashes[1] == hashes[3] and bounds.tolist() == [0, 3, 4]


def test_long_texts_are_split_in_parts(monkeypatch):
    monkeypatch.setattr(run_detection, "PART", 7)
    text = " a  bb\n\nccc dddddddddddddd\te " * 5
    words = text.split()
    keep = np.arange(len(words)) % 3 > 0
    assert run_detection.kept_words(text.encode(), None).decode() == " ".join(words)
    assert run_detection.kept_words(text.encode(), keep).decode() == " ".join(w for w, k in zip(words, keep) if k)


def test_query_matches_its_contract(spark, base):
    docs = spark.read.parquet(f"{base}/documents.parquet")
    got = {r["doc_id"]: r for r in queries_runs.op11(spark, base).collect()}
    seen = 0
    for r in docs.collect():
        words = rewritten(r["doc_id"], plain.words(r["text"], lower=False))
        runs, own = plain_runs(words), got.pop(r["doc_id"])
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert own["n_runs"] == len(runs)
        assert (own["start"], own["length"], own["period"]) == (best or (None,) * 3)
        assert own["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert own["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert own["collapsed_sha256"] == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
        seen += bool(runs)
    assert not got and seen > 5


def test_runs_of_odd_rows(odd, odd_rows, empty):
    out = run_detection.detect_runs(odd.withColumnRenamed("key", "runs").withColumnRenamed("word", "collapsed"))
    assert out.columns == [c for c in odd.columns if c not in ("text", "key", "word")] + ["runs", "collapsed"]
    got = sorted((str(r["doc_id"]), [tuple(x) for x in r["runs"]], r["collapsed"]) for r in out.collect())
    want = []
    for ident, text, *_ in odd_rows:
        words = plain.words(text, lower=False)
        runs = plain_runs(words) if len(words) < 2000 else []
        want.append((str(ident), runs, collapsed(words, runs)))
    assert got == sorted(want) and any(r for _, r, _ in want)
    assert run_detection.detect_runs(empty).count() == 0


def test_planted_rewriting(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 90))) for i in range(400)] + [(None, "a b"), (17, None), (31, " \n")]
    got = queries_runs.planted(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(i, t if i is None or t is None or not t.split() else " ".join(rewritten(i, t.split()))) for i, t in rows]
    assert sorted(((r["doc_id"], (r["text"] or "").split()) for r in got), key=str) == sorted(((i, (t or "").split()) for i, t in want), key=str)
