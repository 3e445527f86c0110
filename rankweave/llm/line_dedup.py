"""Line dedup over levelled sorted runs of line hashes, in SQL expressions only.

Documents come in batches by falling id, so the first batch that holds a line also holds its keeper. A batch is reduced to
one row per line hash (how many documents, largest id), merge-anti-joined with the runs - a line that one run already
counts often enough is settled and adds nothing - and written as a run of its own, sorted by hash. When a level has
``fanout`` runs they are merged into one run of the next level. A run row is 32 bytes, whatever the line's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.base import ascii_lower, row_key, stripped
from rankweave.session import cut_lineage

HASH = ["__h1", "__h2"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, ident: str, text: str, min_chars: int) -> DataFrame:
    """One row per line that is long enough: row key, id, position from 0, 128-bit hash of its key."""
    lines = docs.select(F.col(ident).alias("__id"), *row_key(ident, text), F.posexplode(lines_of(F.col(text))).alias("__pos", "__line"))
    keyed = lines.select("__id", "__k", "__t", "__pos", ascii_lower(stripped(F.col("__line"))).alias("__key"))
    return keyed.where(F.char_length("__key") >= min_chars).select(
        "__id", "__k", "__t", "__pos", F.xxhash64(F.lit(1), "__key").alias("__h1"), F.xxhash64(F.lit(2), "__key").alias("__h2"))


class RunStore:
    """Sorted runs by level. Every run has one row per hash: n documents, last id."""

    def __init__(self, enough: int, fanout: int):
        self.enough, self.fanout = enough, fanout
        self.levels: list[list[DataFrame]] = []

    @staticmethod
    def _written(run: DataFrame) -> DataFrame:
        return cut_lineage(run.sortWithinPartitions(*HASH))

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        union = runs[0]
        for run in runs[1:]:
            union = union.unionByName(run)
        return union.groupBy(*HASH).agg(F.sum("n").alias("n"), F.max("last").alias("last"))

    def add(self, pairs: DataFrame) -> None:
        """``pairs``: distinct (id, hash) of one batch."""
        fresh = pairs.groupBy(*HASH).agg(F.count(F.lit(1)).alias("n"), F.max("__id").alias("last"))
        for run in [run for level in self.levels for run in level]:
            fresh = fresh.join(run.where(F.col("n") >= self.enough).select(*HASH), HASH, "left_anti")
        self._push(self._written(fresh), 0)

    def _push(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._push(self._written(self._merged(full)), level + 1)

    def repeated(self) -> DataFrame | None:
        """The last compaction: hashes found in enough documents, with the id that keeps the line."""
        runs = [run for level in self.levels for run in level]
        return self._merged(runs).where(F.col("n") >= self.enough).select(*HASH, "last") if runs else None


def id_bounds(ids: DataFrame, batches: int, sample: int = 1000) -> list:
    """At most ``batches - 1`` ids of any ordered type, falling, that cut them into about equal parts.

    They come from the ``sample`` ids with the least hashes. They only balance the batches: every result is the same.
    """
    drawn = ids.where(F.col("__id").isNotNull()).distinct().orderBy(F.xxhash64("__id"), "__id").limit(sample).orderBy("__id").collect()
    places = sorted({len(drawn) * i // batches for i in range(1, batches)}, reverse=True)
    return [drawn[at]["__id"] for at in places if at < len(drawn)]


def dedup_lines(docs: DataFrame, ident: str = "doc_id", text: str = "text", min_chars: int = 20, enough: int = 3, batches: int = 4, fanout: int = 2) -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept_text: repeated lines stay only in the largest id that holds them.

    A line's key is the line without ASCII spaces at its ends, A-Z as a-z; keys under ``min_chars`` code points always
    stay. Ids may be of any type that has an order. A null or empty text is one empty line. A null id is one document, smaller than any other. Rows with the same id
    count as one document and keep or drop alike. An empty table stays empty; clashing columns are replaced.
    """
    added = ["n_lines", "n_dropped", "kept_text"]
    kept = [c for c in docs.columns if c not in added]
    lines = cut_lineage(line_hashes(docs, ident, text, min_chars))
    pairs = cut_lineage(lines.select("__id", *HASH).distinct())
    bounds = id_bounds(docs.select(F.col(ident).alias("__id")), batches)
    store = RunStore(enough, fanout)
    for i in range(len(bounds) + 1):  # (bounds[0], ..], (bounds[1], bounds[0]], .., nulls with the last
        over = F.col("__id") > bounds[i] if i < len(bounds) else F.lit(True)
        upto = F.col("__id") <= bounds[i - 1] if i else F.lit(True)
        store.add(pairs.where(over & upto if i < len(bounds) else F.coalesce(upto, F.lit(True))))
    repeated = cut_lineage(store.repeated())
    drops = (lines.join(repeated, HASH).where(F.col("last").isNotNull() & ~F.col("__id").eqNullSafe(F.col("last")))
             .groupBy("__k", "__t").agg(F.array_sort(F.collect_set("__pos")).alias("__drop")))
    joined = docs.select(*kept, *row_key(ident, text)).join(cut_lineage(drops), ["__k", "__t"], "left")
    return _rebuilt(joined, kept, text)


def _rebuilt(joined: DataFrame, kept: list[str], text: str) -> DataFrame:
    """Lines between dropped positions, joined again; linear in the number of lines."""
    drop = F.coalesce(F.col("__drop"), F.array().cast("array<int>"))
    split = joined.withColumns({"__lines": lines_of(F.col(text)), "__drop": drop})
    n = F.size("__lines")
    edges = F.concat(F.array(F.lit(-1)), F.col("__drop"), F.array(n))
    spans = F.arrays_zip(F.slice(edges, 1, F.size("__drop") + 1).alias("a"), F.slice(edges, 2, F.size("__drop") + 1).alias("b"))
    rest = F.flatten(F.transform(spans, lambda s: F.slice(F.col("__lines"), s["a"] + 2, s["b"] - s["a"] - 1)))
    return split.select(*kept, n.cast("long").alias("n_lines"), F.size("__drop").cast("long").alias("n_dropped"),
                        F.when(F.size("__drop") == 0, F.coalesce(F.col(text), F.lit(""))).otherwise(F.concat_ws("\n", rest)).alias("kept_text"))
