"""Group-wise steps that stay safe when one key holds a large share of the rows.

A window over a key sorts the whole group in one task, and ``collect_list`` builds it in one
row. The helpers here do the same work with groups cut into pieces that are chosen from the
data itself, so results do not depend on how rows were spread over tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.session import cut_lineage


def range_pieces(df: DataFrame, order: Sequence[Column], rows: int = 100_000) -> DataFrame:
    """``df`` in stored, consecutive ranges of ``order``, with its range ``__piece`` and place ``__local`` (from 0) in it.

    The ranges are cut at splitters that Spark samples from the keys themselves, of whatever type, so they hold about ``rows``
    rows each however the keys are spread (long common prefixes, sparse numbers). Rows that are equal in all of ``order``
    stay together, so end it with what tells rows apart.
    """
    stored = cut_lineage(df)
    n = max(1, -(-stored.count() // rows))
    placed = stored.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    # the number is the partition in the high bits, the row in the low 33
    split = {"__piece": F.shiftright("__m", 33), "__local": F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))}
    return cut_lineage(placed.withColumns(split).drop("__m"))


def piece_offsets(pieces: DataFrame) -> DataFrame:
    """(__piece, __before): exact rows in the ranges before each one; one row a range."""
    before = Window.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = pieces.groupBy("__piece").agg(F.count(F.lit(1)).alias("__n"))
    return totals.select("__piece", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))


def numbered(df: DataFrame, order: Sequence[Column], name: str, keys: Sequence[str] = (), rows: int = 100_000) -> DataFrame:
    """1-based place of each row in ``order``, or in it within its key, from one range shuffle.

    Rows are placed in their range, ranges by their exact counts; a key starts at the least place of its rows, so a hot key
    is cut into ranges like the rest.
    """
    keys = list(keys)
    pieces = range_pieces(df, [*[F.col(k) for k in keys], *order], rows)
    out = pieces.join(F.broadcast(piece_offsets(pieces)), "__piece").withColumn(name, F.col("__before") + F.col("__local") + 1).drop("__piece", "__local", "__before")
    if not keys:
        return out
    firsts = out.groupBy(*keys).agg(F.min(name).alias("__first"))
    return attach(out, firsts, keys).withColumn(name, F.col(name) - F.col("__first") + 1).drop("__first")


def coarse_span(df: DataFrame, column: str, rows: int = 100_000) -> Column:
    """Consecutive pieces of a number column, as many as there are times ``rows`` rows, however sparse the numbers are."""
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    width = max(1, -(-(int(high) - int(low) + 1) // max(1, -(-n // rows)))) if n else 1
    return F.floor((F.col(column) - F.lit(int(low or 0))) / width)


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join per-key ``stats`` (one row per key) back onto ``df``; replaces a window over the key.

    The rows of one key never have to meet in one task: partial sums are merged before the
    shuffle, and the adaptive skew join splits the row side of a hot key while its single
    ``stats`` row is read by each split. A small ``stats`` is broadcast by its measured size.
    """
    return df.join(stats, list(keys), how)


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[Column], coarse: Column, sums: Mapping[str, Column]) -> DataFrame:
    """Running sums up to each row of its key, without sorting a whole key in one task.

    ``coarse`` cuts a key into consecutive pieces: it must not decrease along ``order``. Rows are
    summed inside a piece and shifted by the totals of the pieces before it. Keys must not be null.
    """
    keys = list(keys)
    staged = df.withColumns({"__piece": coarse, **{f"__in_{n}": c.cast("long") for n, c in sums.items()}})
    totals = staged.groupBy(*keys, "__piece").agg(*[F.sum(f"__in_{n}").alias(f"__t_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "__piece", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in sums])
    inside = Window.partitionBy(*keys, "__piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = staged.withColumns({f"__r_{n}": F.sum(f"__in_{n}").over(inside) for n in sums})
    joined = local.join(offsets, keys + ["__piece"]).withColumns({n: F.col(f"__r_{n}") + F.col(f"__b_{n}") for n in sums})
    return joined.drop("__piece", *[f"__{p}_{n}" for n in sums for p in ("in", "b", "r")])


def running_count(df: DataFrame, keys: Sequence[str], order: Sequence[Column], coarse: Column, flag: Column, name: str) -> DataFrame:
    """Running sum of one flag or count, see ``running_sums``."""
    return running_sums(df, keys, order, coarse, {name: flag})


def ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[Column], coarse: Column, name: str) -> DataFrame:
    """1-based position of each row within its key, see ``running_sums``."""
    return running_count(df, keys, order, coarse, F.lit(True), name)


def shuffled_ordinal(df: DataFrame, keys: Sequence[str], rank_key: Column, name: str) -> DataFrame:
    """``ordinal`` in the order of a 32-digit hex key; pieces are its first three digits."""
    staged = df.withColumn("__hex", rank_key)
    return ordinal(staged, keys, [F.col("__hex")], F.substring("__hex", 1, 3), name).drop("__hex")


def pack(df: DataFrame, keys: Sequence[str], value: Column, order: Sequence[Column], coarse: Column, out: str, size: int = 1000) -> DataFrame:
    """Ordered lists per key, cut into numbered parts of at most ``size`` values.

    Short groups give one row with ``part`` 0; a huge group gives many rows, never one huge row.
    """
    keys = list(keys)
    numbered = ordinal(df.select(*keys, value.alias("__v"), *[o.alias(f"__o{i}") for i, o in enumerate(order)], coarse.alias("__co")),
                       keys, [F.col(f"__o{i}") for i in range(len(order))], F.col("__co"), "__i")
    return pack_numbered(numbered, keys, F.col("__v"), F.col("__i"), out, size)


def pack_ranged(df: DataFrame, keys: Sequence[str], value: Column, order: Sequence[Column], out: str, size: int = 1000) -> DataFrame:
    """Ordered lists per key, as ``pack``, from places by ``numbered``: for an order without a natural piece.
    """
    keys = list(keys)
    rows = df.select(*keys, value.alias("__v"), *[o.alias(f"__o{i}") for i, o in enumerate(order)])
    return pack_numbered(numbered(rows, [F.col(f"__o{i}") for i in range(len(order))], "__i", keys), keys, F.col("__v"), F.col("__i"), out, size)


def pack_numbered(df: DataFrame, keys: Sequence[str], value: Column, place: Column, out: str, size: int = 1000) -> DataFrame:
    """``pack`` for rows that already carry their 1-based place within the key."""
    part = F.floor((place - 1) / size).cast("long").alias("part")
    rows = df.select(*keys, part, place.alias("__i"), value.alias("__v"))
    lists = rows.groupBy(*keys, "part").agg(F.sort_array(F.collect_list(F.struct("__i", "__v"))).alias("__l"))
    return lists.select(*keys, "part", F.transform("__l", lambda s: s["__v"]).alias(out))
