"""Centroid clustering whose assignments are tournaments of bisectors, in integers throughout.

Vectors are scaled and floored to integers. For two centroids i < j the points nearer to j than to i lie on the positive side
of their bisecting plane: x . 2(c_j - c_i) > |c_j|^2 - |c_i|^2. Normals and thresholds of all pairs are computed once a round.
A vector then needs k - 1 sign tests: centroid 0 meets centroid 1, the winner meets centroid 2, and so on; zero favours the
smaller number. That gives the nearest centroid exactly, and its distance is computed once, at the end.

A round is one pass over the stored vectors: a task adds up its vectors per centroid and sends at most k rows of sums, which
are added up again per centroid. Only k rows of sums reach the driver, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.session import cut_lineage


def largest_component(dims: int) -> int:
    """Components up to this size keep every test and distance below 2^63."""
    return 1 << ((61 - (dims - 1).bit_length()) // 2)


def integer_vectors(vectors: DataFrame, ident: str, vector: str, dims: int, scale: int) -> DataFrame:
    """(id, v): the vectors of exactly ``dims`` components that are all finite, as floor(scale * x) in little-endian 32 bits."""
    schema = T.StructType([T.StructField("id", vectors.schema[ident].dataType), T.StructField("v", T.BinaryType())])
    most = min(largest_component(dims), (1 << 31) - 1)

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            whole = pc.fill_null(pc.equal(pc.list_value_length(lists), dims), False)
            ids, lists = batch.column(0).filter(whole), lists.filter(whole)
            x = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(ids), dims)
            good = np.isfinite(x).all(axis=1)
            x = np.floor(x[good] * np.float64(scale))
            if (np.abs(x) > most).any():
                raise ValueError(f"a scaled component is beyond {most}: distances would not fit into 64 bits; use a smaller scale")
            flat = pa.py_buffer(x.astype("<i4").tobytes())
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * (4 * dims)).buffers()[1]
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(good)), pa.Array.from_buffers(pa.binary(), len(x), [None, offsets, flat])], names=schema.names)

    return vectors.select(F.col(ident).alias("id"), F.col(vector).alias("v")).mapInArrow(run, schema)


def decoded(column: pa.Array, dims: int) -> np.ndarray:
    if not len(column):
        return np.empty((0, dims), np.int64)
    data = np.frombuffer(column.buffers()[2], "<i4")[column.offset * dims:(column.offset + len(column)) * dims]
    return data.reshape(len(column), dims).astype(np.int64)


class Tournament:
    def __init__(self, centroids: list[list[int]]):
        self.c = np.array(centroids, np.int64)
        square = (self.c * self.c).sum(axis=1)
        self.normal = 2 * (self.c[None, :, :] - self.c[:, None, :])
        self.threshold = square[None, :] - square[:, None]

    def winners(self, x: np.ndarray) -> np.ndarray:
        """Number of the nearest centroid of every row of ``x``, the smaller one of equally near ones."""
        best = np.zeros(len(x), np.int64)
        for j in range(1, len(self.c)):
            side = np.einsum("nd,nd->n", x, self.normal[best, j]) - self.threshold[best, j]
            best[side > 0] = j
        return best

    def distances(self, x: np.ndarray, winner: np.ndarray) -> np.ndarray:
        gap = x - self.c[winner]
        return np.einsum("nd,nd->n", gap, gap)


def first_centroids(kept: DataFrame, k: int, salt: str, dims: int) -> list[list[int]]:
    """The vectors with the ``k`` smallest hashes of their ids; equal hashes go by components, null ids come last."""
    key = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    return [np.frombuffer(r["v"], "<i4").tolist() for r in kept.select(key.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()]


def moved(kept: DataFrame, centroids: list[list[int]], dims: int) -> list[list[int]]:
    """The centroids after one round: exact floors of the means; a centroid without vectors stays."""
    schema = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("s", T.ArrayType(T.LongType()))])

    def run(batches):
        tournament, count, total = Tournament(centroids), np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dims), np.int64)
        for batch in batches:
            x = decoded(batch.column(0), dims)
            winner = tournament.winners(x)
            count += np.bincount(winner, minlength=len(count))
            for c in np.unique(winner):
                total[c] += x[winner == c].sum(axis=0)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))], names=schema.names)

    sums = kept.select("v").mapInArrow(run, schema).groupBy("cluster").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i].cast("decimal(20,0)")) for i in range(dims)]).alias("s"))
    out = list(centroids)
    for r in sums.collect():  # at most one row a centroid
        out[r["cluster"]] = [int(s) // r["n"] for s in r["s"]]
    return out


def assigned(kept: DataFrame, centroids: list[list[int]], dims: int) -> DataFrame:
    """(id, cluster, distance)"""
    schema = T.StructType([kept.schema["id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def run(batches):
        tournament = Tournament(centroids)
        for batch in batches:
            x = decoded(batch.column(1), dims)
            winner = tournament.winners(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(winner.astype(np.int32)), pa.array(tournament.distances(x, winner))], names=schema.names)

    return kept.mapInArrow(run, schema)


def cluster_vectors(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", dims: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, salt: str = "3:") -> tuple[DataFrame, DataFrame]:
    """Assignments (id, cluster, distance) of all usable vectors, and centroids (cluster, centroid, n, cluster_inertia).

    Usable vectors have ``dims`` components, none null or not finite; the others have no row. ``k`` and ``dims`` bound what
    the driver and each task hold besides one batch: k * k * dims numbers. Fewer than ``k`` usable vectors are centroids each,
    copies included; equal vectors are always in one cluster. Repeated ids are vectors of their own, a null id never
    precedes another as a first centroid. Without usable vectors both tables are empty. Other columns are not read. A scaled
    component that would not let distances fit into 64 bits raises an error.
    """
    kept = cut_lineage(integer_vectors(vectors, ident, vector, dims, scale))
    centroids = first_centroids(kept, k, salt, dims)
    for _ in range(rounds if centroids else 0):
        centroids = moved(kept, centroids, dims)
    out = cut_lineage(assigned(kept, centroids, dims)) if centroids else kept.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0)
    totals = {r["cluster"]: (r["n"], r["inertia"]) for r in out.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("distance").alias("inertia")).collect()}
    rows = [(c, v, *totals.get(c, (0, 0))) for c, v in enumerate(centroids)]
    return out, vectors.sparkSession.createDataFrame(rows, "cluster int, centroid array<long>, n long, cluster_inertia long")


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
