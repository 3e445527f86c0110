"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed pseudo-random place in [0, 2^63). A source's mix is "all documents, some whole number of
times, plus those below a threshold", so a larger budget always contains the smaller one. The threshold is found without
sorting: sizes are summed by (source, leading bits of the place), the running sum names the boundary bucket, and only the
documents in that bucket are summed again by the next bits. Each round moves at most 1024 sums per source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave import skew
from rankweave.llm.base import word_list
from rankweave.session import cut_lineage

BITS, LEVEL_BITS = 63, 10


def place_of(*identity: Column, seed: int = 0) -> Column:
    """A non-negative 63-bit hash of the identity; rows with equal identities are taken together."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *identity), 1)


def word_size(text: Column) -> Column:
    return F.size(word_list(text)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, max_repeat: float) -> DataFrame:
    """``sizes`` (source, source_size) with target: the budget by weight, no target above ``max_repeat`` sizes.

    Weights are dealt in turn to the sources in code-point order, null last. The level at which the capped targets use the
    whole budget is a fixed point: every step is one aggregate over the sources, and only ever caps more of them.
    """
    first = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.substring("source", 1, 6)))
    ranked = skew.ordinal(sizes, [], [F.col("source").isNull(), F.col("source")], first, "__rank")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = cut_lineage(ranked.withColumn("__w", F.get(cycle, ((F.col("__rank") - 1) % len(weights)).cast("int"))))
    cap = F.col("source_size") * float(max_repeat)
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    budget, level = float(share) * total, 0.0
    while True:
        full = cap <= F.col("__w") * level
        used, free = ranked.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("__w")))).first()
        if not free:
            break
        higher = (budget - (used or 0.0)) / free
        if higher <= level:
            break
        level = higher
    return ranked.withColumn("target", F.least(cap, F.col("__w") * level)).drop("__w", "__rank")


def thresholds(places: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, whole, below): take a document ``whole`` times, once more if its place is under ``below``.

    ``places`` has source, size, place.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    state = cut_lineage(targets.withColumn("whole", whole).select(
        "*", (F.col("target") - F.col("whole") * F.col("source_size")).alias("__left"),
        F.lit(0).cast("long").alias("__prefix"), (F.col("target") > F.col("whole") * F.col("source_size")).alias("__open"), F.lit(0).cast("long").alias("below")))
    inside, bits = places, 0
    while bits < BITS:
        step = min(LEVEL_BITS, BITS - bits)
        shift = BITS - bits - step
        boundary = state.where("__open").select("source", "__prefix")
        if bits:
            inside = inside.join(boundary.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")) & (F.shiftright("place", BITS - bits) == F.col("__prefix"))).drop("__s", "__prefix")
        sums = inside.groupBy("source", F.shiftright("place", shift).alias("__bucket")).agg(
            F.sum("size").alias("__sum"), F.min("place").alias("__lo"), F.max("place").alias("__hi"))
        upto = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)
        budgets = state.where("__open").select(F.col("source").alias("__s"), "__left")
        crossing = (sums.withColumn("__cum", F.sum("__sum").over(upto))
                    .join(budgets, F.col("source").eqNullSafe(F.col("__s")))
                    .where(F.col("__cum") > F.col("__left"))
                    .groupBy("source").agg(F.min(F.struct("__bucket", "__cum", "__sum", "__lo", "__hi")).alias("__x")))
        found = crossing.select(F.col("source").alias("__s"), "__x.*")
        before = F.col("__left") - (F.col("__cum") - F.col("__sum"))  # what the boundary bucket may still give
        last = (F.col("__lo") == F.col("__hi")) | F.lit(bits + step >= BITS)
        nearer = F.col("__sum") - before < before
        joined = state.join(found, F.col("source").eqNullSafe(F.col("__s")), "left")
        done = F.col("__open") & F.col("__bucket").isNotNull() & last
        go_on = F.col("__open") & F.col("__bucket").isNotNull() & ~last
        state = cut_lineage(joined.select(
            *[c for c in state.columns if not c.startswith("__") and c != "below"],
            F.when(go_on, before).otherwise(F.col("__left")).alias("__left"),
            F.when(go_on, F.col("__bucket")).otherwise(F.col("__prefix")).alias("__prefix"),
            go_on.alias("__open"),
            # a bucket with a single place is taken if that comes nearer to the target; without a crossing the whole range fits
            F.when(done, F.when(nearer, F.col("__hi") + 1).otherwise(F.col("__lo")))
            .when(F.col("__open") & F.col("__bucket").isNull(), F.coalesce(F.try_multiply(F.col("__prefix") + 1, F.lit(1 << min(BITS - bits, 62))), F.lit((1 << BITS) - 1)) if bits else F.lit((1 << BITS) - 1))
            .otherwise(F.col("below")).alias("below")))
        if state.where("__open").isEmpty():
            break
        bits += step
    return state.select("source", "source_size", "target", "whole", "below")


def mix_sources(docs: DataFrame, source: Column, size: Column, identity: Sequence[Column], weights: Sequence[float] = (5, 2, 1),
                share: float = 1.5, max_repeat: float = 2.0, seed: int = 0) -> DataFrame:
    """``docs`` with size, source_size, target and copies: how often the mix takes the document (0 or more).

    A null text or a size of 0 costs nothing and follows the same thresholds. Equal rows share one place and are taken
    alike. Null is a source of its own. An empty table gives an empty table. Reruns give the same rows. Columns of
    ``docs`` whose names clash with the new ones are replaced.
    """
    added = ["size", "source_size", "target", "copies"]
    payload = docs.select(*[c for c in docs.columns if c not in added])
    keyed = payload.select("*", source.alias("__source"), size.alias("size"), place_of(*identity, seed=seed).alias("__place"))
    places = cut_lineage(keyed.select(F.col("__source").alias("source"), "size", F.col("__place").alias("place")))
    sizes = places.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = thresholds(places, source_targets(sizes, weights, share, max_repeat)).withColumnRenamed("source", "__of")
    return (keyed.join(plan, F.col("__source").eqNullSafe(F.col("__of")))
            .withColumn("copies", F.col("whole") + (F.col("__place") < F.col("below")).cast("int"))
            .drop("__source", "__of", "__place", "whole", "below"))


def repeated(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The mixed table itself: each row as often as it is taken."""
    return mixed.where("copies > 0").select(*columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("__copy")).drop("__copy")
