"""Sharding by sampled splitters.

Rows are ordered by (hash of the text, hash of the id), so equal texts are neighbours and no order of the input matters.
Size-weighted samples give quantile boundaries; every range is then weighed exactly over all rows, and ranges that came
out overfull are sampled again and subdivided. The ranges are dealt to the shards, largest first. Only the sample, the
boundaries and one line of totals per range ever reach the driver; their number is a parameter.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.session import cut_lineage

LEAST, MOST = -(1 << 63), (1 << 63) - 1
Cut = tuple[int, int]


def keys_of(text: str, ident: str) -> list[Column]:
    return [F.xxhash64(F.lit("text"), F.col(text)).alias("__h"), F.xxhash64(F.lit("id"), F.col(ident).cast("string")).alias("__d")]


def range_of(cuts: list[Cut]):
    """Column function: the number of the range a key (h, d) lies in; cut i is the least key of range i + 1."""
    first = np.array([c[0] for c in cuts], np.int64)
    second = np.array([c[1] for c in cuts], np.int64)

    @F.pandas_udf("int")
    def number(h: pd.Series, d: pd.Series) -> pd.Series:
        h, d = h.to_numpy(np.int64), d.to_numpy(np.int64)
        low, high = np.searchsorted(first, h, "left"), np.searchsorted(first, h, "right")
        out = low.astype(np.int32)
        tied = np.flatnonzero(high > low)  # cuts inside this very text
        if len(tied):
            _, start = np.unique(low[tied], return_index=True)
            for at in start:
                a, b = low[tied[at]], high[tied[at]]
                same = tied[low[tied] == a]
                out[same] = a + np.searchsorted(second[a:b], d[same], "right")
        return pd.Series(out)

    return number


def tidy(cuts: list[Cut], known: set[int]) -> list[Cut]:
    """A cut inside a text moves to its start, so equal texts stay together, unless several cuts fall into that one text.

    Such a text is set apart from its neighbours, and its cuts stay; ``known`` are texts set apart before.
    """
    heavy = known | {h for h, n in Counter(h for h, _ in set(cuts)).items() if n > 1}
    out = {c if c[0] in heavy else (c[0], LEAST) for c in cuts}
    for h in heavy:
        out |= {(h, LEAST)} | ({(h + 1, LEAST)} if h < MOST else set())
    return sorted(out)


def weighted_sample(rows: DataFrame, expected: int, total: int, count: int, salt: int) -> list:
    """About ``expected`` keys, each drawn with a chance in proportion to its size and its share of the rows."""
    chance = F.lit(float(expected)) * (F.col("__size") / F.lit(float(max(1, total))) + F.lit(1.0 / max(1, count))) / 2
    coin = F.shiftrightunsigned(F.xxhash64(F.lit(salt), "__h", "__d"), 11) / F.lit(float(1 << 53))
    return rows.where(coin < chance).select("__h", "__d", F.greatest(chance, F.lit(1.0)).alias("w")).collect()


def quantile_cuts(sample: list, parts: int) -> list[Cut]:
    """At most ``parts - 1`` keys that cut the sample into parts of equal weight."""
    ordered = sorted((r["__h"], r["__d"], r["w"]) for r in sample)
    if not ordered:
        return []
    weight = np.cumsum([w for _, _, w in ordered])
    at = np.searchsorted(weight, np.arange(1, parts) * weight[-1] / parts, "left")
    return sorted({ordered[i][:2] for i in at if 0 < i < len(ordered)})


def weigh(rows: DataFrame, cuts: list[Cut]) -> list:
    """Exact totals of every range that holds rows."""
    return sorted(rows.groupBy(range_of(cuts)("__h", "__d").alias("range")).agg(
        F.sum("__size").alias("size"), F.count(F.lit(1)).alias("n"),
        F.min(F.struct("__h", "__d")).alias("low"), F.max(F.struct("__h", "__d")).alias("high")).collect(), key=lambda r: r["range"])


def find_ranges(rows: DataFrame, n_ranges: int, oversample: int = 8) -> tuple[list[Cut], list]:
    """Cuts and exact range totals such that no range holds over twice its share of bytes or of rows, unless it is one key."""
    total, count = rows.agg(F.sum("__size"), F.count(F.lit(1))).first()
    if not count:
        return [], []
    cuts = tidy(quantile_cuts(weighted_sample(rows, oversample * n_ranges, total, count, 0), n_ranges), set())
    apart, salt = {h for h, n in Counter(h for h, _ in cuts).items() if n > 1}, 1
    while True:
        totals = weigh(rows, cuts)
        over = [r for r in totals if r["low"] != r["high"] and max(r["size"] / total, r["n"] / count) > 2 / n_ranges]
        if not over:
            return cuts, totals
        inside = range_of(cuts)("__h", "__d").isin([r["range"] for r in over])
        share = sum(max(r["size"] / total, r["n"] / count) for r in over)
        sample = weighted_sample(rows.where(inside), int(oversample * n_ranges * 2), total, count, salt) if share * n_ranges < 4 * n_ranges else []
        number = np.array([(r["__h"], r["__d"]) for r in sample] or np.empty((0, 2)), dtype=np.int64)
        new: set[Cut] = set()
        for r in over:
            low, high = tuple(r["low"]), tuple(r["high"])
            mine = [s for s in sample if low <= (s["__h"], s["__d"]) <= high] if len(number) else []
            parts = int(np.ceil(max(r["size"] / total, r["n"] / count) * n_ranges))
            got = [c for c in quantile_cuts(mine, parts) if low < c <= high]
            if low[0] == high[0]:  # copies of one text: parted by id
                apart.add(low[0])
                got = got or [(low[0], (low[1] + high[1]) // 2 + 1)]
            else:
                got = got or [((low[0] + high[0]) // 2 + 1, LEAST)]
            new |= set(got)
        apart |= {h for h, n in Counter(h for h, _ in new).items() if n > 1}
        better = tidy(cuts + sorted(new), apart)
        if better == cuts:  # the new cuts fell on starts that were there: part the texts themselves
            better = tidy(cuts + sorted(new), apart | {h for h, _ in new})
        cuts, salt = better, salt + 1


def deal(totals: list, shards: int) -> dict[int, int]:
    """Range -> shard, largest first to the emptiest shard. Ranges of one text go together up to a quarter of a shard."""
    share = sum(r["size"] for r in totals) / shards
    items: list[tuple[int, list[int]]] = []
    text = None
    for r in totals:
        alone = r["low"][0] if r["low"][0] == r["high"][0] else None
        if alone is not None and alone == text and items[-1][0] + r["size"] <= share / 4:
            items[-1] = (items[-1][0] + r["size"], [*items[-1][1], r["range"]])
        else:
            items.append((r["size"], [r["range"]]))
        text = alone
    load = [(0, s) for s in range(shards)]
    out = {}
    for size, ranges in sorted(items, key=lambda x: (-x[0], x[1])):
        used, s = heapq.heappop(load)
        out |= {r: s for r in ranges}
        heapq.heappush(load, (used + size, s))
    return out


def shard_by_size(docs: DataFrame, text: str, ident: str, shards: int = 16, range_bytes: int = 64 << 20, max_ranges: int = 1 << 16) -> DataFrame:
    """``docs`` with size (UTF-8 bytes of the text plus 1), shard and slot (its place in the shard, from 0 without gaps).

    Shards are near equal in bytes: the ranges dealt out hold at most two shares of 1/(64 * shards) each. Equal texts share
    a shard unless their copies weigh over a quarter of one. A null text has size 1 and counts as one text; a null id is an
    id; rows with equal id and text are interchangeable and stay in one range. An empty table stays empty. Columns of
    ``docs`` that clash with the new names are replaced.
    """
    added = ["size", "shard", "slot"]
    kept = [c for c in docs.columns if c not in added]
    size = (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long")
    keyed = docs.select(*kept, size.alias("size"), *keys_of(text, ident))
    rows = cut_lineage(keyed.select(F.col("size").alias("__size"), "__h", "__d"))
    total = rows.agg(F.sum("__size")).first()[0] or 0
    cuts, totals = find_ranges(rows, int(min(max_ranges, max(64 * shards, total // range_bytes))))
    shard_of = deal(totals, shards)
    filled = [0] * shards
    plan = []
    for r in totals:
        s = shard_of[r["range"]]
        plan.append((r["range"], s, filled[s]))
        filled[s] += r["n"]
    table = F.broadcast(docs.sparkSession.createDataFrame(plan, "__range int, shard int, __from long"))  # at most a few lines per allowed range
    place = Window.partitionBy("__range").orderBy("__h", "__d")
    return (keyed.withColumn("__range", range_of(cuts)("__h", "__d")).withColumn("__at", F.row_number().over(place))
            .join(table, "__range").select(*kept, "size", "shard", (F.col("__from") + F.col("__at") - 1).cast("long").alias("slot")))
