"""Vector retrieval by matrix products inside tasks.

A set of queries whose measured size fits BROADCAST_BYTES is sent to every task, and the corpus is
read once where it lies, with no shuffle. A larger set is packed, like the corpus, into blocks
chosen by a hash of the (unique) id, so no block depends on how the data is skewed, and one row per
block pair is scored. Either way only the answer (k rows per query, pairs above a threshold, or one
count per query) leaves a task, and no table of pairs exists.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions.sampling import md5_key
from rankweave.functions.vectors import l2_normalize
from rankweave.operators.lexical import top_k
from rankweave.session import cut_lineage

BLOCK = 1024  # rows per block of the replicated side
WIDE_BLOCK = 16 * BLOCK  # rows per block of the other side: fewer blocks, fewer replicas
SELF_BLOCK = 4 * BLOCK
RINGS = 64  # rings of a cell at most; a ring of more rows than a block has several parts
GUESTS = 2048  # rows that are placed at once
COPIES = 16  # guests a row at most, on average, if blocks are met by copies of rows
PROBED = 1 << 16  # rows whose guests are counted to tell that
LIST = 32  # copies of a vector that are compared as one row
BROADCAST_BYTES = 32 << 20
PLACES = 9
SLACK = 1.1e-9  # what rounding to PLACES can move a score, and a little more
TILE, TILE_ROWS = 1 << 20, 256  # scores that a task holds at once, and rows of such a tile


def _blocks(n: int, block: int) -> int:
    return max(1, -(-n // block))


def pack_blocks(df: DataFrame, keys: Sequence[str], side: str, extra: Sequence[str] = ()) -> DataFrame:
    """(keys, {side}_id list, {side}_vec list, ...) from rows (keys, id, vec, ...)."""
    fields = ["id", "vec", *extra]
    packed = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("rows"))
    return packed.select(*keys, *[F.col(f"rows.{f}").alias(f"{side}_{f}") for f in fields])


def _matrix(cell: pa.ListScalar) -> np.ndarray:
    rows = cell.values
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column positions of the k best columns per row; equal scores keep the lower column."""
    rows, cols = scores.shape
    k = min(k, cols)
    if np.abs(scores).max(initial=0.0) < 1e5:
        key = np.rint(scores * 10**PLACES).astype(np.int64) * cols + np.arange(cols - 1, -1, -1)
        if k < cols:
            chosen = np.argpartition(-key, k - 1, axis=1)[:, :k]
        else:
            chosen = np.broadcast_to(np.arange(cols), (rows, cols))
    else:
        chosen = np.argsort(-np.round(scores, PLACES), axis=1, kind="stable")[:, :k]
    return np.repeat(np.arange(rows), k), chosen.ravel()


def _tiles(rows: int, cols: int) -> Iterator[tuple[slice, slice]]:
    """Parts of a matrix of scores with at most TILE cells each; all columns of a row part come one after the other."""
    for r in range(0, rows, TILE_ROWS):
        for c in range(0, cols, TILE // TILE_ROWS):
            yield slice(r, r + TILE_ROWS), slice(c, min(cols, c + TILE // TILE_ROWS))


def _merge_best(row: np.ndarray, col: np.ndarray, score: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, col, score, least): the k best per row, equal scores by the lower column; least is each row's k-th score, -inf with fewer."""
    rounded = np.round(score, PLACES)
    order = np.lexsort((col, -rounded, row))
    place = np.arange(len(order)) - np.searchsorted(row[order], row[order])
    kept, last = order[place < k], order[place == k - 1]
    least = np.full(rows, -np.inf)
    least[row[last]] = np.where(np.isnan(rounded[last]), -np.inf, rounded[last])
    return row[kept], col[kept], score[kept], least


def _block_best(q_vec: np.ndarray, c_vec: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, score) of the k best columns of every row, a part of the rows at a time."""
    kept, least = None, None
    for rows, cols in _tiles(len(q_vec), len(c_vec)):
        scores = q_vec[rows] @ c_vec[cols].T
        if cols.start == 0:
            r, c = _best(scores, k)
            kept = r, c, scores[r, c]
        else:
            r, c = np.nonzero(~(scores <= least[:, None] - SLACK))
            kept = np.concatenate([kept[0], r]), np.concatenate([kept[1], c + cols.start]), np.concatenate([kept[2], scores[r, c]])
        *kept, least = _merge_best(*kept, len(scores), k)
        if cols.stop == len(c_vec):
            yield kept[0] + rows.start, kept[1], kept[2]


def _topk_kernel(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                q_id, c_id = batch["q_id"][i].values, batch["c_id"][i].values
                for r, c, score in _block_best(_matrix(batch["q_vec"][i]), _matrix(batch["c_vec"][i]), k):
                    yield pa.RecordBatch.from_arrays([q_id.take(pa.array(r)), c_id.take(pa.array(c)), pa.array(score)], ["query_id", "item_id", "score"])

    return run


def _schema(q: DataFrame, c: DataFrame, tail: str) -> str:
    return f"query_id {q.schema['id'].dataType.simpleString()}, item_id {c.schema['id'].dataType.simpleString()}, {tail}"


def _block_pairs(queries: DataFrame, corpus: DataFrame, nq: int, block: int, extra: Sequence[str] = ()) -> DataFrame:
    """Every (query block, corpus block) pair once; the side with fewer rows is the replicated one."""
    nc = corpus.count()
    wide = block * (WIDE_BLOCK // BLOCK)
    bq, bc = (_blocks(nq, block), _blocks(nc, wide)) if nq <= nc else (_blocks(nq, wide), _blocks(nc, block))
    q = pack_blocks(queries.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(bq))), ["qb"], "q", extra)
    c = pack_blocks(corpus.withColumn("cb", F.pmod(F.xxhash64("id"), F.lit(bc))), ["cb"], "c")
    if nq <= nc:
        q = q.withColumn("cb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bc - 1).cast("long"))))
        return q.join(c, "cb")
    c = c.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bq - 1).cast("long"))))
    return q.join(c, "qb")


def _shipped(queries: DataFrame, limit: int, extra: Sequence[str] = ()) -> tuple[int, tuple | None]:
    """Row count, and the queries as arrays when their measured bytes are within ``limit``.

    NumPy pads every id to the longest one, so ids count with the longest.
    """
    width = F.max(F.octet_length(F.col("id").cast("string"))).alias("width")
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dims"), width).first()
    if size["n"] == 0 or size["n"] * (8 * size["dims"] + 64 + 4 * (size["width"] or 0)) > limit:
        return size["n"], None
    rows = queries.select("id", "vec", *extra).collect()
    return size["n"], (_ids([r["id"] for r in rows]), np.array([r["vec"] for r in rows], dtype=np.float64), *[np.array([r[e] for r in rows]) for e in extra])


def _arrow_kind(df: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema["id"].dataType)


def _ids(values: list) -> np.ndarray:
    return np.array(values)


def _batch_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order and their vectors, so that equal scores keep the lower id."""
    ids = _ids(batch["id"].to_pylist())
    vec = batch["vec"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
    order = np.argsort(ids, kind="stable")
    return ids[order], vec[order]


def _stream_topk(shared, k: int, q_kind: pa.DataType, c_kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keep the k best corpus rows per query over all batches of a partition; only a tile of scores exists at a time."""
    def run(batches):
        q_ids, q_vec = shared.value
        kept = [None] * -(-len(q_ids) // TILE_ROWS)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            c_ids, c_vec = _batch_rows(batch)
            for rows, cols in _tiles(len(q_ids), len(c_ids)):
                scores, i = q_vec[rows] @ c_vec[cols].T, rows.start // TILE_ROWS
                if kept[i] is None:
                    r, c = _best(scores, k)
                    row, ids, best = r, c_ids[cols][c], scores[r, c]
                else:
                    row, ids, best, least = kept[i]
                    r, c = np.nonzero(~(scores < least[:, None] - SLACK))
                    row, ids, best = np.concatenate([row, r]), np.concatenate([ids, c_ids[cols][c]]), np.concatenate([best, scores[r, c]])
                kept[i] = _merge_best(row, ids, best, len(scores), k)
        for i, found in enumerate(kept):
            if found is not None:
                row, ids, best, _ = found
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[row + i * TILE_ROWS].tolist(), q_kind), pa.array(ids.tolist(), c_kind), pa.array(best)], ["query_id", "item_id", "score"])

    return run


def exact_topk(queries: DataFrame, corpus: DataFrame, k: int, block: int = BLOCK, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(query_id, item_id, score, rank): best ``k`` by inner product of (id, vec) rows; ids must be unique.

    Rows with a null vector have no score: such a query gets no answer and such an item is never one.
    """
    queries, corpus = queries.where(F.col("vec").isNotNull()), corpus.where(F.col("vec").isNotNull())
    schema = _schema(queries, corpus, "score double")
    nq, small = _shipped(queries.select("id", "vec"), broadcast_bytes)
    if small is not None:
        shared = queries.sparkSession.sparkContext.broadcast(small)
        partial = corpus.select("id", "vec").mapInArrow(_stream_topk(shared, k, _arrow_kind(queries), _arrow_kind(corpus)), schema)
    else:
        pairs = _block_pairs(queries.select("id", "vec"), corpus.select("id", "vec"), nq, block)
        partial = pairs.select("q_id", "q_vec", "c_id", "c_vec").mapInArrow(_topk_kernel(k), schema)
    return top_k(partial, k, item="item_id")


def filtered_topk(queries: DataFrame, corpus: DataFrame, k: int, keep: Column) -> DataFrame:
    """The filter runs before the search, so the k places are filled with rows that pass it."""
    return exact_topk(queries, corpus.where(keep), k)


def target_rank(queries: DataFrame, items: DataFrame, block: int = BLOCK, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rank of ``target_score`` among all items: one count of better items per query, no sort.

    ``queries`` has id, vec and target_score; ``items`` has unique id and vec.
    """
    def better(q_vec, goal, c_vec):
        total, goal = np.zeros(len(q_vec), np.int64), np.round(goal, PLACES)
        for rows, cols in _tiles(len(q_vec), len(c_vec)):
            total[rows] += (np.round(q_vec[rows] @ c_vec[cols].T, PLACES) > goal[rows, None]).sum(axis=1)
        return total

    def stream(batches):
        q_ids, q_vec, goal = shared.value
        total = np.zeros(len(q_ids), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                total += better(q_vec, goal, _batch_rows(batch)[1])
        yield pa.RecordBatch.from_arrays([pa.array(q_ids.tolist(), kind), pa.array(total)], ["query_id", "better"])

    def blocks(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                goal = batch["q_target_score"][i].values.to_numpy(zero_copy_only=False)
                count = better(_matrix(batch["q_vec"][i]), goal, _matrix(batch["c_vec"][i]))
                yield pa.RecordBatch.from_arrays([batch["q_id"][i].values, pa.array(count)], ["query_id", "better"])

    queries, items = queries.where(F.col("vec").isNotNull()), items.where(F.col("vec").isNotNull())
    kind = _arrow_kind(queries)
    schema = f"query_id {queries.schema['id'].dataType.simpleString()}, better bigint"
    asked = queries.select("id", "vec", "target_score")
    nq, small = _shipped(asked, broadcast_bytes, ["target_score"])
    if small is not None:
        shared = queries.sparkSession.sparkContext.broadcast(small)
        counts = items.select("id", "vec").mapInArrow(stream, schema)
    else:
        pairs = _block_pairs(asked, items.select("id", "vec"), nq, block, ["target_score"])
        counts = pairs.select("q_id", "q_vec", "q_target_score", "c_id", "c_vec").mapInArrow(blocks, schema)
    return counts.groupBy("query_id").agg((F.sum("better") + 1).alias("rank"))


@dataclass(frozen=True)
class Cells:
    """A partition of unit vectors by their nearest pivot, in blocks of bounded size.

    A cell is cut into rings by the angle to its pivot, a ring into parts by a hash of the id. Block b holds rows of cell
    ``cell[b]`` at angles in [low[b], high[b]]; blocks are numbered by cell, ring and part.
    """

    pivots: np.ndarray
    edges: list[np.ndarray]
    parts: np.ndarray
    first: np.ndarray

    @staticmethod
    def fit(rows: DataFrame, block: int, most_pivots: int, seed: int = 7) -> Cells:
        """Pivots and cell sizes; the driver holds four times ``most_pivots`` vectors and RINGS angles of each pivot."""
        n = rows.count()
        wanted = min(most_pivots, max(1, 4 * n // block))
        pivots = spread_out(np.array([v for _, v in choose_pivots(rows, 4 * wanted, seed)], dtype=np.float64), wanted) if n else np.zeros((1, 1))

        def angles(batches):
            for batch in batches:
                if batch.num_rows:
                    angle = np.arccos(np.clip(_vectors(batch["vec"], batch.num_rows) @ pivots.T, -1.0, 1.0))
                    home = angle.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(home), pa.array(angle[np.arange(len(home)), home])], ["cell", "angle"])

        cuts = F.percentile_approx("angle", [i / RINGS for i in range(1, RINGS)], 10 * RINGS)
        found = rows.select("vec").mapInArrow(angles, "cell long, angle double").groupBy("cell").agg(
            F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"), cuts.alias("cuts")).collect()
        edges, parts = [np.array([0.0, np.pi])] * len(pivots), np.ones(len(pivots), np.int64)
        for r in found:
            rings = min(RINGS, -(-r["n"] // block))
            inner = sorted({r["cuts"][i * RINGS // rings - 1] for i in range(1, rings)} - {r["low"], r["high"]})
            edges[r["cell"]] = np.array([r["low"], *inner, r["high"]])
            parts[r["cell"]] = -(-r["n"] // (rings * block))
        sizes = np.array([(len(e) - 1) for e in edges]) * parts
        return Cells(pivots, edges, parts, np.concatenate([[0], np.cumsum(sizes)]))

    def placed(self, vec: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(angles to all pivots, home cell, home block) of each row; ``ids`` are hashes."""
        angle = np.arccos(np.clip(vec @ self.pivots.T, -1.0, 1.0))
        home, block = angle.argmin(axis=1), np.empty(len(vec), np.int64)
        for c in np.unique(home):
            own = np.flatnonzero(home == c)
            ring = np.clip(np.searchsorted(self.edges[c], angle[own, c], "right") - 1, 0, len(self.edges[c]) - 2)
            block[own] = self.first[c] + ring * self.parts[c] + ids[own] % self.parts[c]
        return angle, home, block

    def layout(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, low, high) of every block."""
        cell = np.repeat(np.arange(len(self.pivots)), np.diff(self.first))
        low = np.concatenate([np.repeat(e[:-1], p) for e, p in zip(self.edges, self.parts, strict=True)])
        high = np.concatenate([np.repeat(e[1:], p) for e, p in zip(self.edges, self.parts, strict=True)])
        return cell, low, high


def spread_out(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the sampled unit vectors, each the one farthest from those before it: every dense region gets one."""
    chosen, near = [0], sample @ sample[0]
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[chosen[-1]])
    return sample[chosen]


def _vectors(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _packed(rows: pa.RecordBatch, vec: np.ndarray, row: np.ndarray, target: np.ndarray) -> pa.RecordBatch:
    """(block, ids, vecs, marks): row numbers ``row`` of a batch, a pack for each of their targets."""
    order = np.argsort(target, kind="stable")
    row, target = row[order], target[order]
    used, first = np.unique(target, return_index=True)
    edge = np.append(first, len(target))
    ids, marks = (pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), rows[c].take(pa.array(row))) for c in ("id", "mark"))
    vecs = pa.array([vec[row[x:y]].tobytes() for x, y in zip(edge[:-1], edge[1:], strict=True)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), ids, vecs, marks], ["block", "ids", "vecs", "marks"])


def _slices(batches) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, GUESTS):
            rows = batch.slice(at, GUESTS)
            yield rows, _vectors(rows["vec"], rows.num_rows)


def _guests(rows: pa.RecordBatch, vec: np.ndarray, cells: Cells, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, block): a row is a guest of a later block if a vector in there can be nearer to it than ``reach``.

    Its angle to the block's pivot then differs from the block's angles by no more than that, and from its angle to its own
    pivot by no more than twice that.
    """
    cell, low, high = cells.layout()
    number = np.arange(len(cell))
    angle, home, block = cells.placed(vec, rows["hash"].to_numpy())
    step = max(1, TILE // len(cell))
    for i in range(0, len(block), step):
        a, own = angle[i:i + step], angle[np.arange(len(block)), home][i:i + step, None]
        near = (a <= own + 2 * reach)[:, cell]
        wide = a[:, cell]
        r, b = np.nonzero(near & (wide >= low - reach) & (wide <= high + reach) & (number > block[i:i + step, None]))
        yield r + i, b


def _packs(batches, cells: Cells, reach: float | None) -> Iterator[pa.RecordBatch]:
    """The rows of a batch that are at home in a block, or, with ``reach``, its guests."""
    for rows, vec in _slices(batches):
        if reach is None:
            block = cells.placed(vec, rows["hash"].to_numpy())[2]
            yield _packed(rows, vec, np.arange(len(block)), block)
        else:
            for row, block in _guests(rows, vec, cells, reach):
                yield _packed(rows, vec, row, block)


def _guest_share(stored: DataFrame, cells, reach: float, n: int) -> float:
    """Guests a row, counted on about PROBED rows by hash. It only tells which of two complete plans is cheaper."""
    parts = max(1, n // PROBED)

    def count(batches):
        for rows, vec in _slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([rows.num_rows]), pa.array([sum(len(r) for r, _ in _guests(rows, vec, cells.value, reach))])], ["n", "guests"])

    found = stored.where(F.pmod("hash", F.lit(parts)) == 0).mapInArrow(count, "n long, guests long").agg(F.sum("n").alias("n"), F.sum("guests").alias("guests")).first()
    return found["guests"] / found["n"] if found["n"] else 0.0


def pivot_blocks(reps: DataFrame, threshold: float, block: int = SELF_BLOCK, most_pivots: int = 4096, copies: float = COPIES) -> DataFrame:
    """(q_ids, q_vecs, q_marks, packs, same): what has to be compared for all pairs of unit vectors with cosine above ``threshold``.

    ``packs`` is a whole block, the q rows (``q_vecs`` in pieces) some of its guests (``same``: the block itself). Angles are a metric,
    so a row is copied only to blocks within the threshold's angle of it; how few these are depends on how clustered the vectors are.
    If they are more than ``copies`` a row, as with vectors spread evenly over all directions, no row is copied: blocks by hash are
    stored once, and Spark's product of that table with itself reads every pair of blocks where they lie, without a shuffle.
    A long ``mark`` of a row (1 if there is no such column) goes with it.
    """
    reach = float(np.arccos(np.clip(threshold, -1.0, 1.0))) + 1e-6
    mark = F.col("mark") if "mark" in reps.columns else F.lit(1).cast("long")
    stored = cut_lineage(reps.select("id", "vec", mark.alias("mark"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("hash")))
    n = stored.count()
    cells = stored.sparkSession.sparkContext.broadcast(Cells.fit(stored, block, most_pivots))
    schema = f"block bigint, ids array<{reps.schema['id'].dataType.simpleString()}>, vecs binary, marks array<bigint>"
    pieces = F.collect_list(F.struct("ids", "vecs", "marks")).alias("packs")
    whole = [F.flatten(F.col("packs.ids")).alias("q_ids"), F.col("packs.vecs").alias("q_vecs"), F.flatten(F.col("packs.marks")).alias("q_marks")]
    if _guest_share(stored, cells, reach, n) > copies:
        parts = _blocks(n, block)

        def by_hash(batches):
            for rows, vec in _slices(batches):
                yield _packed(rows, vec, np.arange(len(vec)), rows["hash"].to_numpy() % parts)

        homes = cut_lineage(stored.mapInArrow(by_hash, schema).groupBy("block").agg(pieces))
        left = homes.select(F.col("block").alias("q_block"), *whole)
        met = left.crossJoin(homes).where(F.col("q_block") <= F.col("block"))
        return met.select("q_ids", "q_vecs", "q_marks", "packs", (F.col("q_block") == F.col("block")).alias("same"))
    homes = cut_lineage(stored.mapInArrow(lambda b: _packs(b, cells.value, None), schema).groupBy("block").agg(pieces))
    guests = stored.mapInArrow(lambda b: _packs(b, cells.value, reach), schema)
    met = guests.join(homes, "block").select(F.col("ids").alias("q_ids"), F.array("vecs").alias("q_vecs"), F.col("marks").alias("q_marks"), "packs", F.lit(False).alias("same"))
    return met.unionByName(homes.select(*whole, "packs", F.lit(True).alias("same")))


class Compared:
    """One row of ``pivot_blocks``: ids, vectors and marks of both sides."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        packs, self.same = batch["packs"][i].values, batch["same"][i].as_py()
        joined = lambda vecs, n: np.frombuffer(b"".join(v.as_py() for v in vecs)).reshape(n, -1)
        numbers = lambda marks: marks.to_numpy(zero_copy_only=False).astype(np.int64)
        self.c_id = pa.concat_arrays([p.values for p in packs.field("ids")])
        self.c_vec = joined(packs.field("vecs"), len(self.c_id))
        self.c_mark = numbers(pa.concat_arrays([p.values for p in packs.field("marks")]))
        self.q_id = self.c_id if self.same else batch["q_ids"][i].values
        self.q_vec = self.c_vec if self.same else joined(batch["q_vecs"][i].values, len(self.q_id))
        self.q_mark = self.c_mark if self.same else numbers(batch["q_marks"][i].values)

    def close(self, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, column, rounded score) of the pairs, each once, with a score of about ``least`` or more, a tile at a time."""
        for rows, cols in _tiles(len(self.q_id), len(self.c_id)):
            if self.same and rows.start >= cols.stop:
                continue
            scores = self.q_vec[rows] @ self.c_vec[cols].T
            r, c = np.divmod(np.flatnonzero(scores >= least - SLACK), scores.shape[1])
            score = np.round(scores[r, c], PLACES)
            r, c = r + rows.start, c + cols.start
            yield (r[r < c], c[r < c], score[r < c]) if self.same else (r, c, score)

    @property
    def own(self) -> int:
        """Where the columns begin if rows and columns are numbered together."""
        return 0 if self.same else len(self.q_id)

    @property
    def ids(self) -> pa.Array:
        return self.c_id if self.same else pa.concat_arrays([self.q_id, self.c_id])


def compared(batches) -> Iterator[Compared]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Compared(batch, i)


def link(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of ``a`` and ``b``, edge by edge; ``root`` has the least member of each number's set."""
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = root[root]
            if np.array_equal(further, root):
                break
            root[:] = further


class Forest:
    """Edges that connect the same ids as all edges added: cut down to fewer than ids whenever they double."""

    def __init__(self, limit: int = TILE):
        self.parts, self.n, self.limit = [], 0, limit

    def add(self, ids: pa.Array, root: np.ndarray) -> None:
        """Sets of ``ids`` by the position of their root."""
        moved = np.flatnonzero(root != np.arange(len(root)))
        if len(moved):
            self.parts.append((ids.take(pa.array(root[moved])), ids.take(pa.array(moved))))
            self.n += len(moved)
        if self.n > self.limit:
            self.cut()
            self.limit = max(self.limit, 2 * self.n)

    def cut(self) -> None:
        a, z = (pa.concat_arrays([p[i] for p in self.parts]) for i in range(2))
        both = pa.concat_arrays([a, z]).dictionary_encode()
        code, root = both.indices.to_numpy(), np.arange(len(both.dictionary))
        link(root, code[:len(a)], code[len(a):])
        self.parts, self.n = [], 0
        moved = np.flatnonzero(root != np.arange(len(root)))
        if len(moved):
            self.parts, self.n = [(both.dictionary.take(pa.array(root[moved])), both.dictionary.take(pa.array(moved)))], len(moved)

    def edges(self) -> Iterator[tuple[pa.Array, pa.Array]]:
        if self.n:
            self.cut()
        for a, z in self.parts:
            for low in range(0, len(a), 1 << 16):
                yield a.slice(low, 1 << 16), z.slice(low, 1 << 16)


def copy_lists(df: DataFrame) -> DataFrame:
    """(id, vec): the ids of equal vectors in lists of at most LIST; a vector of more copies gets several rows."""
    many = cut_lineage(df.groupBy("vec").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LIST))
    parts = F.coalesce(F.ceil(F.col("n") / LIST), F.lit(1)).cast("long")
    dealt = df.join(many, "vec", "left").select("vec", "id", F.pmod(F.xxhash64("id"), parts).alias("part"))
    lists = dealt.groupBy("vec", "part").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    # parts are dealt by a hash: some are a little longer, those of an id that comes many times much longer
    return lists.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("ids"), F.lit(LIST)), lambda i: F.slice("ids", i, LIST))).alias("id"), "vec")


class Copies:
    """Ids of the copies of each row, laid end to end."""

    def __init__(self, lists: pa.ListArray):
        self.ids, self.n = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.first = np.cumsum(self.n) - self.n


def crossed(q: Copies, c: Copies, rows: np.ndarray, cols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pair, q place, c place) for each copy of a pair's row with each copy of its column, about TILE of them at a time."""
    each = q.n[rows] * c.n[cols]
    upto, low = np.cumsum(each), 0
    first = upto - each
    while low < len(each):
        high = max(low + 1, int(np.searchsorted(upto, first[low] + TILE, "right")))
        pair = np.repeat(np.arange(low, high), each[low:high])
        nth, width = np.arange(first[low], upto[high - 1]) - first[pair], c.n[cols[pair]]
        yield pair, q.first[rows[pair]] + nth // width, c.first[cols[pair]] + nth % width
        low = high


def similar_pairs(df: DataFrame, threshold: float, block: int = SELF_BLOCK, most_pivots: int = 4096, spanning: bool = False, copies: bool = False) -> DataFrame:
    """(src, dst, score) with cosine strictly above ``threshold`` and src < dst.

    Equal vectors are first merged: pairs are searched among one representative (lowest id) per
    distinct vector, and each copy is tied to its representative by one edge. Any number of copies
    thus costs a linear number of edges, and connected components stay the same.

    With ``spanning``, every pair is compared too, but a task hands on only so many edges (src, dst) as connect what all its pairs
    connect, fewer than it has rows: what connected components need, where nearly all rows may be alike.

    With ``copies`` every pair of rows is returned, those of copies with each other and with what their vector is like included.
    Vectors are still compared once: lists of copies take the place of representatives, and a task multiplies the pairs it finds.
    """
    # a null or zero vector has no direction: it is like nothing, not even like itself
    df = df.select("id", "vec").where(l2_normalize(F.col("vec")).isNotNull())
    if copies:
        return _all_pairs(df.where(F.col("id").isNotNull()), threshold, block, most_pivots)
    # the representative is found by groupBy, so a vector shared by many rows merges map-side
    groups = df.groupBy("vec").agg(F.min("id").alias("rep"))
    reps = _directed(groups.select(F.col("rep").alias("id"), l2_normalize(F.col("vec")).alias("vec")))
    tied = (
        df.select("id", "vec").join(groups, "vec").where(F.col("id") != F.col("rep"))
        .select(F.col("rep").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("score"))
    )
    if threshold >= 1.0:
        tied = tied.limit(0)
    kind = df.schema["id"].dataType.simpleString()

    def pairs(batches):
        for both in compared(batches):
            for r, c, score in both.close(threshold):
                hit = score > threshold
                yield pa.RecordBatch.from_arrays([both.q_id.take(pa.array(r[hit])), both.c_id.take(pa.array(c[hit])), pa.array(score[hit])], ["a", "z", "score"])

    def edges(batches):
        forest = Forest()
        for both in compared(batches):
            root = np.arange(both.own + len(both.c_id))
            for r, c, score in both.close(threshold):
                hit = score > threshold
                link(root, r[hit], c[hit] + both.own)
            forest.add(both.ids, root)
        for a, z in forest.edges():
            yield pa.RecordBatch.from_arrays([a, z], ["a", "z"])

    work = pivot_blocks(reps, threshold, block, most_pivots)
    ends = [F.least("a", "z").alias("src"), F.greatest("a", "z").alias("dst")]
    if spanning:
        return work.mapInArrow(edges, f"a {kind}, z {kind}").select(*ends).unionByName(tied.drop("score"))
    return work.mapInArrow(pairs, f"a {kind}, z {kind}, score double").select(*ends, "score").unionByName(tied)


def _directed(units: DataFrame) -> DataFrame:
    """Rows without NaN: no angle to such a vector can be told, so one among the pivots would keep others from being compared."""
    return units.where(~F.exists("vec", F.isnan))


def _all_pairs(df: DataFrame, threshold: float, block: int, most_pivots: int) -> DataFrame:
    """``similar_pairs`` of every two rows; a row that comes more than once pairs as often, two rows of one id do not."""
    kind = df.schema["id"].dataType.simpleString()

    def pairs(batches):
        for both in compared(batches):
            c = Copies(both.c_id)
            q = c if both.same else Copies(both.q_id)
            for row, col, score in both.close(threshold):
                hit = score > threshold
                for pair, a, z in crossed(q, c, row[hit], col[hit]):
                    yield pa.RecordBatch.from_arrays([q.ids.take(pa.array(a)), c.ids.take(pa.array(z)), pa.array(score[hit][pair])], ["a", "z", "score"])
            if both.same and threshold < 1.0:
                several = np.flatnonzero(c.n > 1)
                for _, a, z in crossed(c, c, several, several):
                    a, z = a[a < z], z[a < z]
                    yield pa.RecordBatch.from_arrays([c.ids.take(pa.array(a)), c.ids.take(pa.array(z)), pa.array(np.ones(len(a)))], ["a", "z", "score"])

    lists = cut_lineage(_directed(copy_lists(df).select("id", l2_normalize(F.col("vec")).alias("vec"))))
    size = lists.agg(F.count(F.lit(1)).alias("lists"), F.sum(F.size("id")).alias("rows")).first()
    # blocks of as many copies as a block of single rows has rows, so that a task's pairs do not grow with the lists
    block = max(1, block * size["lists"] // size["rows"]) if size["lists"] else block
    work = pivot_blocks(lists, threshold, block, most_pivots).mapInArrow(pairs, f"a {kind}, z {kind}, score double")
    return work.where(F.col("a") != F.col("z")).select(F.least("a", "z").alias("src"), F.greatest("a", "z").alias("dst"), "score")


def choose_pivots(corpus: DataFrame, pivots: int, seed: int = 7) -> list[tuple[object, list[float]]]:
    """An md5-ordered sample of the corpus that spans the cells; only these rows reach the driver."""
    rows = corpus.select("id", "vec").withColumn("o", md5_key(seed, "id")).orderBy("o").limit(pivots).collect()
    return sorted(((r["id"], list(r["vec"])) for r in rows), key=lambda p: p[0])


def assign_cells(df: DataFrame, pivots: Sequence[tuple[object, Sequence[float]]], probes: int, group: int = 4096) -> DataFrame:
    """(id, vec, cell, place) for the ``probes`` nearest pivots of each row, the nearest at place 1.

    Pivots beyond ``group`` are compared group by group, and the best of all groups kept.
    """
    kind, vec_kind = df.schema["id"].dataType.simpleString(), df.schema["vec"].dataType.simpleString()

    def nearest(centers: np.ndarray, first: int):
        def run(batches):
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                scores = _vectors(batch["vec"], batch.num_rows) @ centers.T
                r, c = _best(scores, probes)
                score = np.round(scores[r, c], PLACES)
                order = np.lexsort((c, -score, r))
                place = np.tile(np.arange(1, min(probes, len(centers)) + 1, dtype=np.int32), batch.num_rows)
                rows = pa.array(r[order])
                yield pa.RecordBatch.from_arrays([batch["id"].take(rows), batch["vec"].take(rows), pa.array(c[order].astype(np.int64) + first), pa.array(score[order]), pa.array(place)], ["id", "vec", "cell", "score", "place"])

        return run

    found = None
    for low in range(0, len(pivots), group):
        centers = np.asarray([p[1] for p in pivots[low:low + group]], dtype=np.float64)
        part = df.select("id", "vec").mapInArrow(nearest(centers, low), f"id {kind}, vec {vec_kind}, cell bigint, score double, place int")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return df.select("id", "vec", F.lit(0).cast("long").alias("cell"), F.lit(1).alias("place")).limit(0)
    if len(pivots) <= group:
        return found.drop("score")
    order = Window.partitionBy("id").orderBy(F.col("score").desc(), "cell")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= probes).drop("score")


def ann_topk(queries: DataFrame, corpus: DataFrame, k: int, pivots: int = 64, probes: int = 4, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """Search only the cells of the ``probes`` nearest pivots; scores inside them are exact.

    A crowded cell is cut into parts of about ``block`` rows, each a key of its own, and met by its queries
    part by part. ``probe_recall`` tells what a number of probes finds.
    """
    centers = choose_pivots(corpus, pivots, seed)
    members = cut_lineage(assign_cells(corpus, centers, 1).drop("place"))
    asked = cut_lineage(assign_cells(queries, centers, probes).drop("place"))

    def parts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias(name))  # a row a pivot

    c_parts = parts(members, "n_c")
    c = pack_blocks(members.join(F.broadcast(c_parts), "cell").withColumn("cp", F.pmod(F.xxhash64("id"), F.col("n_c"))), ["cell", "cp"], "c")
    q = pack_blocks(asked.join(F.broadcast(parts(asked, "n_q")), "cell").withColumn("qp", F.pmod(F.xxhash64("id"), F.col("n_q"))), ["cell", "qp"], "q")
    q = q.join(F.broadcast(c_parts), "cell").withColumn("cp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_c") - 1)))
    pairs = q.join(c, ["cell", "cp"]).select("q_id", "q_vec", "c_id", "c_vec")
    return top_k(pairs.mapInArrow(_topk_kernel(k), _schema(queries, corpus, "score double")), k, item="item_id")


def probe_recall(queries: DataFrame, corpus: DataFrame, k: int, pivots: int = 64, seed: int = 7) -> DataFrame:
    """(probes, recall): the share of the exact ``k`` nearest items of ``queries`` that each number of probes finds.

    An item is found if its cell is among the probed ones, so one exact search tells the recall of every number of probes.
    """
    centers = choose_pivots(corpus, pivots, seed)
    exact = exact_topk(queries.select("id", "vec"), corpus.select("id", "vec"), k).select("query_id", F.col("item_id").alias("id"))
    home = assign_cells(corpus.join(exact.select("id").distinct(), "id", "left_semi"), centers, 1).select("id", "cell")
    order = assign_cells(queries, centers, len(centers)).select(F.col("id").alias("query_id"), "cell", "place")
    wanted = exact.join(home, "id").join(order, ["query_id", "cell"])
    counts = wanted.groupBy("place").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("probes").rowsBetween(Window.unboundedPreceding, 0)  # a row a pivot
    steps = queries.sparkSession.range(1, len(centers) + 1).select(F.col("id").cast("int").alias("probes"))
    filled = steps.join(counts, steps["probes"] == counts["place"], "left").select("probes", F.coalesce("n", F.lit(0)).alias("n"))
    total = filled.agg(F.sum("n")).first()[0] or 0
    return filled.select("probes", (F.sum("n").over(upto) / F.lit(float(max(1, total)))).alias("recall"))


def probes_for_recall(queries: DataFrame, corpus: DataFrame, k: int, recall: float = 0.9, pivots: int = 64, seed: int = 7) -> int:
    """The least number of probes that finds ``recall`` of the exact answers of the (sampled) ``queries``."""
    found = probe_recall(queries, corpus, k, pivots, seed).where(F.round("recall", PLACES) >= recall).agg(F.min("probes")).first()[0]
    return found or pivots
