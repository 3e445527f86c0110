"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.session import cut_lineage


def _toward_minimum(edges: DataFrame, larger_only: bool) -> DataFrame:
    """One star step: hang neighbours on the smallest node around each centre.

    ``larger_only`` moves the neighbours above the centre (large star); otherwise the centre and
    its smaller neighbours move (small star). The minimum is an aggregate joined back, so a hub
    is split by the skew join and never gathered.
    """
    if larger_only:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    lowest = around.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = around.join(lowest, "a")
    if larger_only:
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lowest.select("a", F.col("m").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): component is the smallest id of the component; isolated nodes keep their own.

    ``nodes`` has id, ``edges`` src and dst. Alternating star steps (Kiveris et al., 2014) need a number
    of rounds that grows with the logarithm of the graph; each round is checkpointed, and they end at the fixed point.
    """
    current = cut_lineage(edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).where(F.col("a") != F.col("b")).distinct())
    seen = None
    while True:
        current = cut_lineage(_toward_minimum(_toward_minimum(current, True), False))
        # the edge set is compared by its size and an order-free sum of hashes: two numbers
        print_of = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if print_of == seen:
            break
        seen = print_of
    roots = current.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root"))
    return nodes.select("id").distinct().join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("component"))
