"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs over all training texts are quantised to levels, and an n-gram of level j is stored as j
members (n-gram, 1) .. (n-gram, j). A count is read back by probing level after level until one is missing. The filter is
built in segments by hash range, one task each, and broadcast to the workers in groups of at most ``filter_bytes``; with
more than one group every group is a pass of its own and the levels they find are put together per text.

A text's probability interpolates pair and word estimates. The weight of the pairs is the share of training pairs that
occur again, so it follows the corpus.

Exact word counts, for the base score, are broadcast for the most frequent words only (a bounded number); the remaining
occurrences are rare words, which no text can make hot among the counts, and are joined.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.base import row_key, small_batches
from rankweave.llm.decontaminate import pieces
from rankweave.llm.wordscan import ODD, WordScanner, chain, mix
from rankweave.session import cut_lineage

#: the token after the last word; it also stands before the first
END = np.uint64(0x1F83D9ABFB41BD6B)
#: counts at which levels begin: about half a power of two apart
LEVELS = np.unique(np.ceil(2.0 ** (np.arange(0, 90) / 2)).astype(np.int64))
VALUES = np.append((LEVELS[:-1] + LEVELS[1:] - 1) / 2, LEVELS[-1])
BITS_PER_MEMBER, PROBES = 8, 4
BUCKET_BITS = 8
FLUSH = 1 << 21


def tokens_of(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of consecutive texts with an END after each; bounds include the ENDs."""
    cut = bounds - bounds[0]
    return np.insert(words, cut[1:], END), cut + np.arange(len(cut))


def pairs_of(tokens: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it; the first of a text follows an END."""
    return chain(np.concatenate([[END], tokens[:-1]]), tokens)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with summed counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    if not len(key):
        return key, count
    order = np.argsort(key)
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(count, first, dtype=count.dtype)


def probe(key: np.ndarray, level: int, words: np.ndarray, sizes: np.ndarray, starts: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the 64-bit word, mask of the bits) that hold member (key, level)."""
    h = mix(key + np.uint64(level * ODD % (1 << 64)))
    at = starts[buckets] + ((h >> np.uint64(32)) * sizes[buckets] >> np.uint64(32))
    mask = np.zeros(len(key), np.uint64)
    for i in range(PROBES):
        mask |= np.uint64(1) << (h >> np.uint64(6 * i) & np.uint64(63))
    return at, mask


def build_segment(key: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The filter words of one hash range."""
    top = np.searchsorted(LEVELS, count, "right")
    size = max(1, int(top.sum()) * BITS_PER_MEMBER // 64 + 1)
    out = np.zeros(size, np.uint64)
    one, zero = np.array([size], np.uint64), np.array([0], np.uint64)
    for level in range(1, int(top.max(initial=0)) + 1):
        own = key[top >= level]
        at, mask = probe(own, level, out, one, zero, np.zeros(len(own), np.int64))
        order = np.argsort(at)
        at, mask = at[order], mask[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        out[at[first]] |= np.bitwise_or.reduceat(mask, first)
    return out


class LogFrequencyFilter:
    """Some or all segments; n-grams of other segments have level 0."""

    def __init__(self, segments: dict[int, bytes]):
        self.sizes = np.zeros(1 << BUCKET_BITS, np.uint64)
        self.starts = np.zeros(1 << BUCKET_BITS, np.uint64)
        at = 0
        for b, data in sorted(segments.items()):
            self.sizes[b], self.starts[b] = len(data) // 8, at
            at += len(data) // 8
        self.words = np.frombuffer(b"".join(data for _, data in sorted(segments.items())), np.uint64)

    def levels(self, key: np.ndarray) -> np.ndarray:
        """Quantised count level of every key, 0 if unseen."""
        out = np.zeros(len(key), np.uint8)
        bucket = (key >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        left = np.flatnonzero(self.sizes[bucket] > 0)
        level = 1
        while len(left) and level <= len(LEVELS):
            at, mask = probe(key[left], level, self.words, self.sizes, self.starts, bucket[left])
            left = left[self.words[at] & mask == mask]
            out[left] = level
            level += 1
        return out


def gather_counts(training: DataFrame) -> DataFrame:
    """One row per hash range: exact word counts, the filter segment with its bytes, and totals.

    distinct and tokens count words, pairs and single word pairs and those seen once. A task sums its own texts first and
    sends one row per hash range.
    """
    blob = "bucket int, words binary, word_counts binary, pairs binary, pair_counts binary"

    def count(batches):
        scanner = WordScanner()
        held: list[list[np.ndarray]] = [[], [], [], []]

        def rows():
            word, n_word = merged(held[0], held[1])
            pair, n_pair = merged(held[2], held[3])
            edges = np.arange(1, 1 << BUCKET_BITS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)
            w = np.concatenate([[0], np.searchsorted(word, edges), [len(word)]])
            p = np.concatenate([[0], np.searchsorted(pair, edges), [len(pair)]])
            some = np.flatnonzero((np.diff(w) > 0) | (np.diff(p) > 0))
            cut = lambda a, at: pa.array([a[at[b]:at[b + 1]].tobytes() for b in some], pa.binary())
            for own in held:
                own.clear()
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), cut(word, w), cut(n_word, w), cut(pair, p), cut(n_pair, p)], names=["bucket", "words", "word_counts", "pairs", "pair_counts"])

        for batch in batches:
            words, bounds = scanner.scan(batch.column(0))
            for first, last in pieces(bounds):
                own = bounds[first:last + 1]
                tokens, _ = tokens_of(words[own[0]:own[-1]], own)
                for keys, at in ((tokens, 0), (pairs_of(tokens), 2)):
                    key, n = np.unique(keys, return_counts=True)
                    held[at].append(key)
                    held[at + 1].append(n.astype(np.uint32))
                if sum(map(len, held[2])) > FLUSH:
                    yield rows()
        if held[0]:
            yield rows()

    def build(table: pa.Table) -> pa.Table:
        def total(keys: str, counts: str):
            read = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in table[name]]
            return merged(read(keys, np.uint64), [c.astype(np.int64) for c in read(counts, np.uint32)])

        word, n_word = total("words", "word_counts")
        pair, n_pair = total("pairs", "pair_counts")
        segment = build_segment(np.concatenate([word, pair]), np.concatenate([n_word, n_pair]))
        numbers = [len(word), int(n_word.sum()), int(n_pair.sum()), int((n_pair == 1).sum())]
        return pa.table([table["bucket"].slice(0, 1), pa.array([word.tobytes()], pa.binary()), pa.array([n_word.tobytes()], pa.binary()), pa.array([segment.tobytes()], pa.binary()), pa.array([len(segment) * 8]), *[pa.array([x]) for x in numbers]],
                        names=["bucket", "words", "word_counts", "filter", "bytes", "distinct", "tokens", "pairs", "single"])

    return training.mapInArrow(count, blob).groupBy("bucket").applyInArrow(build, "bucket int, words binary, word_counts binary, filter binary, bytes long, distinct long, tokens long, pairs long, single long")


def word_rows(counts: DataFrame, low: int, high: int | None) -> DataFrame:
    """(word, c) with low <= c < high."""

    def unpack(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                word, c = np.frombuffer(batch.column(0)[i].as_buffer(), np.int64), np.frombuffer(batch.column(1)[i].as_buffer(), np.int64)
                own = (c >= low) & (c < high if high is not None else True)
                yield pa.RecordBatch.from_arrays([pa.array(word[own]), pa.array(c[own])], names=["word", "c"])

    return counts.select("words", "word_counts").mapInArrow(unpack, "word long, c long")


def frequent_from(counts: DataFrame, most: int) -> int:
    """The least count such that at most ``most`` words have it or more."""
    by_level = word_rows(counts, 1, None).groupBy(F.floor(F.log2("c") * 8).alias("l")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low")).collect()  # some hundred lines
    room, least = most, None
    for r in sorted(by_level, key=lambda r: -r["l"]):
        room -= r["n"]
        if room < 0:
            break
        least = r["low"]
    return least if least is not None else max((r["low"] for r in by_level), default=0) + 1


def text_scores(level_word: np.ndarray, level_pair: np.ndarray, bounds: np.ndarray, n: float, v: float, weight: float) -> np.ndarray:
    """log10 probability per text from the levels of its tokens and pairs."""
    value = np.append(0.0, VALUES)
    c = value[level_word]
    before = np.empty(len(c))
    before[1:] = c[:-1]
    ends = bounds[1:] - 1
    before[bounds[:-1]] = c[ends]  # an END stands before the first word
    single = (c + 0.5) / (n + 0.5 * (v + 1))
    both = np.minimum(value[level_pair], np.minimum(before, c))  # a pair is no more frequent than its words
    p = np.where(before > 0, weight * both / np.maximum(before, 1) + (1 - weight) * single, single)
    return np.add.reduceat(np.log10(p), bounds[:-1]) if len(bounds) > 1 else np.empty(0)


def score_texts(docs: DataFrame, held_out: Column, ident: str = "doc_id", text: str = "text", filter_bytes: int = 256 << 20, frequent_words: int = 1 << 20) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of ``docs``.

    Learns from the rows where ``held_out`` is false or null. Words are split at ASCII spaces, A-Z as a-z; every text, also
    a null or empty one, ends with one END token. base_score sums log10((c + 0.5) / (N + 0.5 (V + 1))) over exact counts.
    Without training rows N and V are 0. Repeated rows score alike and each counts in training. Other columns are not
    read, whatever their names.
    """
    spark = docs.sparkSession
    rows = small_batches(docs).select(F.col(ident).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    counts = cut_lineage(gather_counts(rows.where(~F.col("held_out")).select("text")))
    v, n, pairs, single = [x or 0 for x in counts.agg(F.sum("distinct"), F.sum("tokens"), F.sum("pairs"), F.sum("single")).first()]
    weight = min(0.95, max(0.05, (pairs - single) / pairs)) if pairs else 0.05
    floor = frequent_from(counts, frequent_words)
    frequent = word_rows(counts, floor, None).toArrow()
    order = np.argsort(frequent["word"].to_numpy().view(np.uint64))
    table = spark.sparkContext.broadcast((frequent["word"].to_numpy().view(np.uint64)[order], frequent["c"].to_numpy()[order]))
    groups = [[]]
    room = filter_bytes
    for r in counts.select("bucket", "bytes").orderBy("bucket").collect():  # 2 ** BUCKET_BITS lines
        if groups[-1] and r["bytes"] > room:
            groups.append([])
            room = filter_bytes
        groups[-1].append(r["bucket"])
        room -= r["bytes"]

    def load(buckets):
        found = counts.where(F.col("bucket").isin(buckets)).select("bucket", "filter").toArrow() if buckets else None
        return spark.sparkContext.broadcast(LogFrequencyFilter({b.as_py(): f.as_py() for b, f in zip(found["bucket"], found["filter"], strict=True)} if found else {}))

    base_schema = "id " + docs.schema[ident].dataType.simpleString() + ", held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<bigint>"
    denominator = n + 0.5 * (v + 1)
    whole = len(groups) == 1
    first_group = load(groups[0]) if whole else None

    def base(batches):
        scanner = WordScanner()
        known, c_known = table.value
        model = first_group.value if whole else None
        for batch in batches:
            words, bounds = scanner.scan(batch.column(2))
            for first, last in pieces(bounds):
                own = bounds[first:last + 1]
                tokens, cut = tokens_of(words[own[0]:own[-1]], own)
                unique, back = np.unique(tokens, return_inverse=True)
                at = np.minimum(np.searchsorted(known, unique), max(0, len(known) - 1))
                c = np.where(known[at] == unique, c_known[at], 0) if len(known) else np.zeros(len(unique), np.int64)
                logs = np.where(c > 0, np.log10((c + 0.5) / denominator), 0.0)[back]
                found = (c > 0)[back]
                rare = np.flatnonzero(~found)
                score = np.zeros(last - first)
                if whole:
                    score = text_scores(model.levels(unique)[back], model.levels(pairs_of(tokens)), cut, n, v, weight)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, cut).astype(np.int32)), pa.array(tokens[rare].view(np.int64)))
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(i).slice(first, last - first) for i in (0, 1)], pa.array(np.diff(cut)),
                    pa.array(np.add.reduceat(found.astype(np.int64), cut[:-1])), pa.array(np.add.reduceat(logs, cut[:-1])), pa.array(score), lists],
                    names=["id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"])

    scored = rows.mapInArrow(base, base_schema) if whole else _in_passes(rows, groups, load, base, base_schema, n, v, weight)
    scored = cut_lineage(scored.withColumn("__row", F.monotonically_increasing_id()))
    unseen = math.log10(0.5 / denominator)
    lists = scored.where(F.size("rare") > 0).select("__row", F.explode("rare").alias("word"))
    others = cut_lineage(word_rows(counts, 1, floor))
    rest = (lists.join(others, "word", "left")
            .select("__row", F.col("c").isNotNull().cast("long").alias("k"), F.coalesce(F.log10((F.col("c") + 0.5) / F.lit(denominator)), F.lit(unseen)).alias("s"))
            .groupBy("__row").agg(F.sum("k").alias("k"), F.sum("s").alias("s")))
    return scored.join(rest, "__row", "left").select(
        "id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("s", F.lit(0.0))).alias("base_score"), "score")


def _in_passes(rows: DataFrame, groups, load, base, base_schema: str, n: float, v: float, weight: float) -> DataFrame:
    """The same rows when the filter takes several broadcasts: one pass per group, levels added up per text."""
    key = row_key("id", "text")
    found = None
    for buckets in groups:
        part = load(buckets)

        def look(batches, part=part):
            scanner = WordScanner()
            for batch in batches:
                words, bounds = scanner.scan(batch.column(2))
                for first, last in pieces(bounds):
                    own = bounds[first:last + 1]
                    tokens, cut = tokens_of(words[own[0]:own[-1]], own)
                    level = np.stack([part.value.levels(tokens), part.value.levels(pairs_of(tokens))])
                    blobs = pa.array([level[:, a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(first, last - first) for i in (0, 1)], blobs], names=["__k", "__t", "levels"])

        own = rows.select(*key, "text").dropDuplicates(["__k", "__t"]).mapInArrow(look, "__k long, __t long, levels binary")
        found = own if found is None else found.unionByName(own)

    def add(table: pa.Table) -> pa.Table:
        level = sum(np.frombuffer(x.as_buffer(), np.uint8).reshape(2, -1) for x in table["levels"])
        score = text_scores(level[0], level[1], np.array([0, level.shape[1]]), n, v, weight)
        return pa.table([table["__k"].slice(0, 1), table["__t"].slice(0, 1), pa.array(score)], names=["__k", "__t", "s"])

    scores = found.groupBy("__k", "__t").applyInArrow(add, "__k long, __t long, s double")
    plain = rows.select("id", "held_out", "text", *key)
    fields = base_schema.split(", ", 1)[1]

    def with_key(batches):
        for batch in batches:
            at = 0
            for out in base(iter([batch.select([0, 1, 2])])):
                keys = [batch.column(i).slice(at, out.num_rows) for i in (3, 4)]
                at += out.num_rows
                yield pa.RecordBatch.from_arrays([*out.columns, *keys], names=[*out.schema.names, "__k", "__t"])

    names = [f.split(" ")[0] for f in base_schema.split(", ")]
    keyed = plain.mapInArrow(with_key, f"{base_schema.split(', ', 1)[0]}, {fields}, __k long, __t long")
    return keyed.join(scores, ["__k", "__t"]).withColumn("score", F.col("s")).select(*names)
