"""Benchmark decontamination by winnowing.

Texts are words; every run of ``gram`` words has a hash, and of each ``window`` neighbouring hashes the least is kept as a
fingerprint. Any span of gram + window - 1 words that two texts share has at least one fingerprint in common, so the join
of training and test fingerprints misses no benchmark window. Hits are then extended: the windows around a hit are hashed
whole and joined with the benchmark's windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.llm.base import row_key, small_batches, small_side
from rankweave.llm.wordscan import ODD, WordScanner, mix
from rankweave.session import cut_lineage

GRAM = 5
LONGS = T.ArrayType(T.LongType())
INTS = T.ArrayType(T.IntegerType())


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words; a run's hash also tells its length."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = np.full(m, n, np.uint64)
    for i in range(n):
        h = h * np.uint64(ODD) + words[i:i + m]
    return mix(h)


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """For every run of ``window`` neighbouring hashes, the position of the least one."""
    spans = max(0, len(hashes) - window + 1)
    least, at = hashes[:spans].copy(), np.arange(spans)
    for i in range(1, window):
        other = hashes[i:i + spans]
        lower = other <= least
        least[lower] = other[lower]
        at[lower] = np.flatnonzero(lower) + i
    return at


def marks(words: np.ndarray, bounds: np.ndarray, length: int, short: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions in ``words``): fingerprints of all texts in the flat array, and every run of each shorter length.

    A text of fewer than ``length`` words cannot hold a whole window, so it has no fingerprints of that length.
    """
    end = np.repeat(bounds[1:], np.diff(bounds)) - bounds[0]
    start = np.arange(len(words))
    gram = min(GRAM, length)
    grams = gram_hashes(words, gram)
    at = winnow(grams, length - gram + 1)
    at = np.unique(at[start[:len(at)] + length <= end[:len(at)]])  # only windows that stay inside one text
    found = [(grams[at], at)]
    for n in short:
        runs = gram_hashes(words, n) ^ np.uint64(n)
        inside = np.flatnonzero(start[:len(runs)] + n <= end[:len(runs)])
        found.append((runs[inside], inside))
    if len(found) == 1:
        return found[0]
    hashes, places = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    order = np.argsort(places, kind="stable")
    return hashes[order], places[order]


def pieces(bounds: np.ndarray, most: int = 1 << 18):
    """Consecutive texts (first, after last) of about ``most`` words together."""
    first = 0
    while first < len(bounds) - 1:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + most, "right")) - 1)
        yield first, last
        first = last


def ragged(values: list[np.ndarray], kind) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind)))


def _passing(batch: pa.RecordBatch, names: list[str]) -> list[pa.Array]:
    return [batch.column(batch.schema.names.index(n)) for n in names]


def benchmark_windows(items: DataFrame, ident: str, text: str, length: int) -> DataFrame:
    """(item, n, window, mark list): every window of every item; an item of fewer words is one window."""
    schema = T.StructType([T.StructField("item", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("window", T.LongType()), T.StructField("marks", LONGS)])

    def cut(batches):
        scanner = WordScanner(letters=True)
        for batch in batches:
            words, bounds = scanner.scan(batch.column(1))
            item, size, window, mark = [], [], [], []
            names = batch.column(0).to_pylist()
            for i, name in enumerate(names):
                own = words[bounds[i]:bounds[i + 1]]
                n = min(length, len(own))
                if not n:
                    continue
                hashes = gram_hashes(own, n).view(np.int64)
                found = marks(own, np.array([0, len(own)]), length, [])[0] if n == length else gram_hashes(own, n) ^ np.uint64(n)
                item += [name] * len(hashes)
                size += [n] * len(hashes)
                window += hashes.tolist()
                mark += [found.view(np.int64)] + [np.empty(0, np.int64)] * (len(hashes) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(size, pa.int32()), pa.array(window, pa.int64()), ragged(mark, np.int64)], names=["item", "n", "window", "marks"])

    return items.select(F.col(ident).cast("string").alias("item"), F.col(text).alias("text")).mapInArrow(cut, schema)


def document_marks(docs: DataFrame, text: str, length: int, short: list[int], keep: list[str]) -> DataFrame:
    """``keep`` with n_words and lists of marks and places; the first place of every list is -1 and stands for the row."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("n_words", T.LongType()), T.StructField("marks", LONGS), T.StructField("places", INTS)])

    def fingerprint(batches):
        scanner = WordScanner(letters=True)
        for batch in batches:
            words, bounds = scanner.scan(batch.column(batch.schema.names.index("__text")))
            for first, last in pieces(bounds):
                own = bounds[first:last + 1]
                hashes, at = marks(words[own[0]:own[-1]], own, length, short)
                cut = np.searchsorted(at, own - own[0])
                place = at - np.repeat(own[:-1] - own[0], np.diff(cut))
                offsets = pa.array((cut + np.arange(len(cut))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.insert(flat, cut[:-1], -1).astype(kind))) for flat, kind in ((hashes.view(np.int64), np.int64), (place, np.int32))]
                yield pa.RecordBatch.from_arrays([*[c.slice(first, last - first) for c in _passing(batch, keep)], pa.array(np.diff(own)), *lists], names=[*keep, "n_words", "marks", "places"])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(fingerprint, schema)


def candidate_windows(hits: DataFrame, length: int, short: list[int]) -> DataFrame:
    """(__k, __t, n, start, window) for every window around the given places."""
    schema = T.StructType([T.StructField("__k", T.LongType()), T.StructField("__t", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("window", T.LongType())])

    def extend(batches):
        scanner = WordScanner(letters=True)
        for batch in batches:
            words, bounds = scanner.scan(batch.column(batch.schema.names.index("text")))
            places = batch.column(batch.schema.names.index("places"))
            rows, sizes, starts, windows = [], [], [], []
            for i in range(batch.num_rows):
                own = words[bounds[i]:bounds[i + 1]]
                at = np.asarray(places[i].values.to_numpy(zero_copy_only=False), np.int64)
                for n in [length, *short]:
                    # a window of n words around a place starts up to n - 1 words before it
                    first = np.unique((at[:, None] - np.arange(n)[None, :]).ravel()) if n == length else np.unique(at)
                    first = first[(first >= 0) & (first + n <= len(own))]
                    if len(first):
                        h = np.full(len(first), n, np.uint64)
                        for j in range(n):
                            h = h * np.uint64(ODD) + own[first + j]
                        rows.append(np.full(len(first), i))
                        sizes.append(np.full(len(first), n, np.int32))
                        starts.append(first.astype(np.int32))
                        windows.append(mix(h).view(np.int64))
            if rows:
                take = pa.array(np.concatenate(rows))
                keys = [c.take(take) for c in _passing(batch, ["__k", "__t"])]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(np.concatenate(sizes)), pa.array(np.concatenate(starts)), pa.array(np.concatenate(windows))], names=["__k", "__t", "n", "start", "window"])

    return hits.select("__k", "__t", "text", "places").mapInArrow(extend, schema)


def find_contamination(docs: DataFrame, items: DataFrame, ident: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", length: int = 10) -> DataFrame:
    """One row per distinct (id, text): id, copies (equal rows), n_words, n_hit, items (their ids, sorted as strings), and the
    row key __k, __t that ``clean`` uses.

    n_hit counts words inside occurrences of item windows. Null or empty texts have no words and no hits, items without
    words no windows. Equal rows are one row with copies, equal items are found alike. Either table may be empty. Other
    columns are not read, whatever their names.
    """
    windows = cut_lineage(benchmark_windows(items, item, item_text, length))
    short = sorted(r["n"] for r in windows.where(F.col("n") < length).select("n").distinct().collect())  # at most length - 1 numbers
    of_window = cut_lineage(windows.groupBy("n", "window").agg(F.collect_set("item").alias("items")))
    wanted = cut_lineage(windows.select(F.explode("marks").alias("mark")).distinct().withColumn("known", F.lit(True)))
    keyed = small_batches(docs).select(F.col(ident).alias("id"), F.col(text).alias("text"), *row_key(ident, text))
    key = ["__k", "__t"]
    marked = document_marks(keyed, "text", length, short, ["id", *key])
    one = marked.select("id", *key, "n_words", F.explode(F.arrays_zip("marks", "places")).alias("x"))
    # the join of fingerprints: of every document its row marker stays, and the places that the benchmark shares
    shared = (one.select("id", *key, "n_words", F.col("x.marks").alias("mark"), F.col("x.places").alias("place"))
              .join(wanted, "mark", "left").where(F.col("known") | (F.col("place") < 0)))
    rows = cut_lineage(shared.groupBy("id", *key).agg(
        F.max("n_words").alias("n_words"), F.count_if(F.col("place") < 0).alias("copies"),
        F.collect_set(F.when(F.col("place") >= 0, F.col("place"))).alias("places")))
    hits = rows.where(F.size("places") > 0).select(*key, "places")
    n_rows, n_places = hits.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("places")), F.lit(0))).first()
    around = keyed.select(*key, "text").join(small_side(hits, n_rows + n_places // 8), key)
    found = candidate_windows(around, length, short).join(of_window, ["n", "window"])
    spans = found.groupBy(*key).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("stop")))).alias("spans"))
    # spans by start: each adds the words beyond the furthest end so far
    covered = F.aggregate(
        F.col("spans"), F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum")),
        lambda a, s: F.struct(F.greatest(a["end"], s["stop"]).alias("end"), (a["sum"] + F.greatest(F.lit(0), s["stop"] - F.greatest(a["end"], s["start"]))).alias("sum")),
        lambda a: a["sum"])
    hit = cut_lineage(spans.select(*key, "items", covered.cast("long").alias("n_hit")))
    return rows.select("id", *key, "n_words", "copies").join(hit, key, "left").withColumns({
        "n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>"))})


def clean(docs: DataFrame, verdicts: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without any hit."""
    bad = cut_lineage(verdicts.where("n_hit > 0").select("__k", "__t"))
    columns = [docs[c] for c in docs.columns]
    return docs.select(*columns, *row_key(ident, text)).join(small_side(bad, bad.count()), ["__k", "__t"], "left_anti").drop("__k", "__t")
