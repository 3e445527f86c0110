"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

One permutation (the mixed shingle hash) sends a shingle to a slot of a fixed ring; the second permutation is a table over
the ring, and signature coordinate k is the least table value over the slots shifted by k. All coordinates of a shingle
are therefore neighbours in one table, and a signature is a minimum over contiguous windows.

Equal sets are merged before any pair work. Documents that share a band are candidates; links are confirmed on the full
shingle sets. Members of a bucket are first compared with one leader only. Buckets that still hold several groups are compared
further: pairs in small ones, blocks of bounded size in crowded ones, so no bucket is ever expanded into its pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.llm.base import small_batches, small_side
from rankweave.llm.decontaminate import pieces
from rankweave.llm.wordscan import ODD, WordScanner, chain, mix
from rankweave.operators.graph import connected_components
from rankweave.session import cut_lineage

RING_BITS = 20
#: two texts at Jaccard 0.8 share one band of five rows with chance 0.33: with 51 bands they miss all but one of them with
#: chance 4e-8
BANDS, ROWS = 51, 5
COMPARE_BYTES = 8 << 20
#: buckets of more members are compared in blocks of at most so many bytes and rows
CROWD, PART_BYTES, PART_ROWS = 24, 8 << 20, 2048
MATRIX_CELLS = 8 << 20
SEED = 20240607


class CirculantMinHash:
    def __init__(self, coordinates: int):
        ring = np.random.default_rng(SEED).permutation(1 << RING_BITS).astype(np.uint32)
        self.windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([ring, ring[:coordinates - 1]]), coordinates)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """Least value per coordinate; ``shingles`` are mixed hashes, at least one."""
        slots = (shingles >> np.uint64(64 - RING_BITS)).astype(np.int64)
        out = self.windows[slots[:1024]].min(axis=0)
        for at in range(1024, len(slots), 1024):
            np.minimum(out, self.windows[slots[at:at + 1024]].min(axis=0), out=out)
        return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands) keys; equal keys mean the same band with the same values."""
    parts = signatures.reshape(len(signatures), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(signatures), bands)).copy()
    for j in range(rows):
        key = key * np.uint64(ODD) + parts[:, :, j]
    return mix(key)


def shingle_sets(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every text, flat with their bounds; a text of fewer words is one shingle, without words none.

    ``bounds`` are relative to ``words``.
    """
    lengths = np.diff(bounds)
    h = words
    for i in range(1, size):
        h = chain(h[:len(words) - i], words[i:])
    end = np.repeat(bounds[1:], lengths)
    at = np.flatnonzero(np.arange(len(h)) + size <= end[:len(h)]) if len(h) else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)[at]
    value = h[at]
    brief = np.flatnonzero((lengths > 0) & (lengths < size))
    if len(brief):
        whole = np.array([np.bitwise_xor.reduce(mix(words[bounds[i]:bounds[i + 1]] + np.arange(1, lengths[i] + 1, dtype=np.uint64))) for i in brief], np.uint64)
        row, value = np.concatenate([row, brief]), np.concatenate([value, mix(whole)])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return value[first], np.searchsorted(row[first], np.arange(len(lengths) + 1))


def sketch(docs: DataFrame, ident: str, text: str, size: int, bands: int, rows: int) -> DataFrame:
    """(id, n, d1, d2, bands): set size, a 128-bit digest of the set, and its band keys (none for an empty set)."""
    schema = T.StructType([T.StructField("id", docs.schema[ident].dataType), *[T.StructField(c, T.LongType()) for c in ("n", "d1", "d2")], T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches):
        scanner, hasher = WordScanner(), CirculantMinHash(bands * rows)
        for batch in batches:
            words, bounds = scanner.scan(batch.column(1))
            for first, last in pieces(bounds):
                own = bounds[first:last + 1]
                sets, cut = shingle_sets(words[own[0]:own[-1]], own - own[0], size)
                n = np.diff(cut)
                full = np.flatnonzero(n)
                signatures = np.empty((len(full), bands * rows), np.uint32)
                for j, i in enumerate(full):
                    signatures[j] = hasher.signature(sets[cut[i]:cut[i + 1]])
                digests = []
                for salt in (1, 2):
                    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(sets + np.uint64(salt)), dtype=np.uint64)])
                    digests.append(mix(total[cut[1:]] - total[cut[:-1]] + np.uint64(salt)).view(np.int64))
                offsets = np.concatenate([[0], np.cumsum((n > 0) * bands)]).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(band_keys(signatures, bands, rows).ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(n.astype(np.int64)), pa.array(digests[0]), pa.array(digests[1]), keys], names=schema.names)

    return docs.select(F.col(ident).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)


def confirm(pairs: DataFrame, texts: DataFrame, size: int, per_cent: int) -> DataFrame:
    """The (a, b) whose full sets have 100 * intersection >= per_cent * union."""
    kind = texts.schema["id"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])

    def run(batches):
        scanner = WordScanner()

        def sets(column):
            words, bounds = scanner.scan(column)
            value, cut = shingle_sets(words, bounds - bounds[0], size)
            row = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
            return mix(value + row.astype(np.uint64) * np.uint64(ODD)), row, np.diff(cut)

        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = batch.column(2), batch.column(3)
            weight = np.cumsum(pc.add(pc.binary_length(one), pc.binary_length(two)).to_numpy(zero_copy_only=False).astype(np.int64))
            part = weight // COMPARE_BYTES
            edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                left, row, n_left = sets(one.slice(low, high - low))
                right, _, n_right = sets(two.slice(low, high - low))
                _, at, _ = np.intersect1d(left, right, assume_unique=True, return_indices=True)
                both = np.bincount(row[at], minlength=high - low)
                linked = (both > 0) & (100 * both >= per_cent * (n_left + n_right - both))
                if linked.any():
                    yield batch.select([0, 1]).slice(low, high - low).filter(pa.array(linked))

    with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    with_both = with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    return cut_lineage(with_both.select("a", "b", "ta", "tb").mapInArrow(run, schema).distinct())


def _joined(components: DataFrame, found: DataFrame) -> DataFrame:
    """``components`` (id, component) with the components that the links (a, b) connect put together."""
    ends = [components.select(F.col("id").alias(x), F.col("component").alias(f"c{x}")) for x in "ab"]
    edges = found.join(ends[0], "a").join(ends[1], "b").where("ca != cb").select(F.col("ca").alias("src"), F.col("cb").alias("dst")).distinct()
    edges = cut_lineage(edges)
    touched = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    roots = connected_components(touched, edges).select(F.col("id").alias("component"), F.col("component").alias("root"))
    return cut_lineage(components.join(roots, "component", "left").select("id", F.coalesce("root", "component").alias("component")))


def _intersections(sets: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Sizes of all pairwise intersections, as products of 0/1 matrices over slices of the vocabulary."""
    n = len(cut) - 1
    row = np.repeat(np.arange(n), np.diff(cut))
    _, word, count = np.unique(sets, return_inverse=True, return_counts=True)
    shared = count[word] > 1
    place = np.cumsum(count > 1) - 1
    row, word = row[shared], place[word[shared]]
    order = np.argsort(word, kind="stable")
    row, word = row[order], word[order]
    both, width = np.zeros((n, n), np.float32), max(1, MATRIX_CELLS // max(1, n))
    for low in range(0, int(word[-1]) + 1 if len(word) else 0, width):
        at = slice(*np.searchsorted(word, [low, low + width]))
        m = np.zeros((n, min(width, int(word[-1]) + 1 - low)), np.float32)
        m[row[at], word[at] - low] = 1
        both += m @ m.T
    return both


def block_links(crowded: DataFrame, texts: DataFrame, size: int, per_cent: int) -> DataFrame:
    """Links between members of different components in crowded buckets; ``crowded`` has key, id, c.

    A bucket is cut into parts of bounded bytes and rows, and one row per pair of parts is compared in its task. Of the
    links that are found there only those leave the task that put two components together.
    """
    sizes = crowded.join(texts.select("id", F.octet_length("text").alias("b")), "id").groupBy("key").agg(
        F.greatest(F.ceil(F.sum("b") / PART_BYTES), F.ceil(F.count(F.lit(1)) / PART_ROWS), F.lit(1)).cast("long").alias("parts"))
    parted = crowded.join(cut_lineage(sizes), "key").join(texts, "id").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    packs = cut_lineage(parted.groupBy("key", "part").agg(F.collect_list(F.struct("id", "c", "text")).alias("rows")))
    kind = texts.schema["id"].dataType
    other = packs.select("key", F.col("part").alias("q"), F.col("rows").alias("more"))
    alone = packs.select("rows", F.slice("rows", 1, 0).alias("more"))
    work = alone.unionByName(packs.join(other, "key").where("part < q").select("rows", "more"))

    def run(batches):
        scanner = WordScanner()
        for batch in batches:
            for i in range(batch.num_rows):
                one, two = batch.column(0)[i].values, batch.column(1)[i].values
                rows = pa.concat_arrays([one, two])
                ids, c, text = (rows.field(k) for k in range(3))
                words, bounds = scanner.scan(text)
                sets, cut = shingle_sets(words, bounds - bounds[0], size)
                n = np.diff(cut)
                both = _intersections(sets, cut)
                label = pd.factorize(c.to_numpy(zero_copy_only=False))[0]
                hit = (both > 0) & (100 * both >= per_cent * (n[:, None] + n[None, :] - both)) & (label[:, None] != label[None, :])
                if len(two):  # pairs inside either part have a row of their own
                    hit[:len(one), :len(one)] = hit[len(one):, len(one):] = False
                root = np.arange(label.max(initial=-1) + 1)
                left, right = [], []
                for x, y in zip(*np.nonzero(np.triu(hit)), strict=True):
                    a, b = label[x], label[y]
                    while root[a] != a:
                        a = root[a]
                    while root[b] != b:
                        b = root[b]
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        root[label[x]] = root[label[y]] = min(a, b)
                        left.append(x)
                        right.append(y)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(left, pa.int64())), ids.take(pa.array(right, pa.int64()))], names=["a", "b"])

    return cut_lineage(work.mapInArrow(run, T.StructType([T.StructField("a", kind), T.StructField("b", kind)])).distinct())


def component_links(members: DataFrame, texts: DataFrame, size: int, per_cent: int) -> DataFrame:
    """(id, component) over the bucket members, such that every confirmed link between bucket mates is inside a component.

    ``members`` (key, id, low: the bucket's least id). First each member is compared with the least id of its buckets.
    Then only buckets that still hold several components matter: in small ones, pairs of different components are
    compared; crowded ones are compared in blocks.
    """
    pairs = cut_lineage(members.where("low < id").groupBy(F.col("id").alias("b")).agg(F.min("low").alias("a")))
    found = confirm(pairs, texts, size, per_cent)
    components = cut_lineage(connected_components(members.select("id"), found.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
    placed = members.select("key", "id").join(components.withColumnRenamed("component", "c"), "id")
    mixed = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("key", "n")
    placed = cut_lineage(placed.join(cut_lineage(mixed), "key"))
    small = placed.where(F.col("n") <= CROWD).select("key", "id", "c")
    other = small.select("key", F.col("id").alias("b"), F.col("c").alias("cb"))
    rest = small.join(other, "key").where("id < b and c != cb").select(F.col("id").alias("a"), "b").distinct().join(pairs, ["a", "b"], "left_anti")
    more = confirm(cut_lineage(rest), texts, size, per_cent).unionByName(block_links(placed.where(F.col("n") > CROWD).select("key", "id", "c"), texts, size, per_cent))
    return _joined(components, more)


def near_duplicates(docs: DataFrame, ident: str = "doc_id", text: str = "text", size: int = 5, per_cent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n_shingles, component_id, kept), one row per row of ``docs``.

    Words are split at ASCII spaces, A-Z as a-z; a text of fewer than ``size`` words is one shingle; null, empty and blank
    texts have no shingles and are linked with nothing. component_id is the least id reachable over links; only that row
    is kept. Rows that share an id are one document. A row with a null id belongs to no group and is kept. An empty table
    gives an empty table. Other columns are not read, whatever their names.
    """
    rows_of = cut_lineage(sketch(small_batches(docs), ident, text, size, bands, rows))
    same_set = ["n", "d1", "d2"]
    sets = cut_lineage(rows_of.where("n > 0").groupBy(*same_set).agg(F.min("id").alias("node")))
    lead = rows_of.where("n > 0").join(sets, [F.col("id") == F.col("node"), *[rows_of[c] == sets[c] for c in same_set]], "left_semi")
    keys = cut_lineage(lead.select("id", F.explode("bands").alias("key")))
    buckets = keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key", "low")
    members = cut_lineage(keys.join(buckets, "key").select("key", "id", "low"))
    candidates = members.select("id").distinct()
    n_candidates = candidates.count()
    wide = docs.select(F.col(ident).alias("id"), F.col(text).alias("text"))
    texts = cut_lineage(wide.join(small_side(candidates, n_candidates), "id", "left_semi"))
    components = component_links(members, texts, size, per_cent)
    placed = cut_lineage(sets.join(components.select(F.col("id").alias("node"), "component"), "node", "left").select(*same_set, F.coalesce("component", "node").alias("component")))
    out = rows_of.select("id", *same_set).join(placed, same_set, "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def clean(docs: DataFrame, verdicts: DataFrame, ident: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose document is the one that its group keeps."""
    gone = cut_lineage(verdicts.where(~F.col("kept")).select(F.col("id").alias("__gone")).distinct())
    return docs.join(small_side(gone, gone.count()), F.col(ident) == F.col("__gone"), "left_anti")
