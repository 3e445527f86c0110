"""Postings packed by document, and top-k searches over them inside the documents' own tasks.

A row holds one document: its distinct terms and their counts (or given weights). A search ships the query terms, whose
bytes are measured, to the tasks; larger query sets go in groups of that size. A task reads its documents block by block.
A block becomes a small inverted index; the largest weight of each term in it bounds what the block can score for a query, and
a query whose k best so far lie above the bound skips the block. Only k rows per query leave a task, so no (document, query)
pair is ever shuffled, and a frequent term is never gathered in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from rankweave.session import cut_lineage

#: bytes of query terms that a task holds at once
QUERY_BYTES = 32 << 20
#: documents in a block, and (query, document) cells or postings that are scored at once
BLOCK_ROWS, CELLS = 4096, 1 << 20
#: texts whose tokens are counted at once
TEXT_ROWS = 256
#: scores are equal if they agree to so many places; the slack covers what rounding can move
PLACES, SLACK = 9, 1.1e-9

Weigh = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def spans(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [low, high), one range after the other."""
    n = high - low
    return np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())


def term_lists(docs: DataFrame, fields: Mapping[str, Column], drop: Sequence[str] = (), only: pa.Array | None = None, whole: Sequence[str] = ()) -> DataFrame:
    """(doc_id, lengths, sizes, terms, counts), one row per row of ``docs``, in one pass over it.

    ``fields``: prefix of the terms -> tokens. ``lengths`` has the number of tokens of each field, without those in ``drop``;
    ``terms`` are the distinct ones, field after field, ``sizes`` of them each. ``only`` keeps no other terms; lengths are of all.
    Nothing is dropped from the fields in ``whole``.
    """
    names = [f"__t{i}" for i in range(len(fields))]
    ints, strings = T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType())
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("lengths", ints), T.StructField("sizes", ints), T.StructField("terms", strings), T.StructField("counts", ints)])
    prefixes = list(fields)

    def run(batches):
        dropped = pa.array(list(drop), pa.string())
        for batch in (b.slice(low, TEXT_ROWS) for b in batches for low in range(0, b.num_rows, TEXT_ROWS)):
            n = batch.num_rows
            lengths, sizes, rows, words, counts = np.zeros((n, len(names)), np.int32), np.zeros((n, len(names)), np.int32), [], [], []
            for i, prefix in enumerate(prefixes):
                tokens = batch.column(i + 1)
                row = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
                coded = tokens.flatten().cast(pa.string()).dictionary_encode()
                code, word = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
                used = np.ones(len(code), bool) if prefix in whole or not len(code) else ~pc.is_in(word, dropped).to_numpy(zero_copy_only=False)[code]
                lengths[:, i] = np.bincount(row[used], minlength=n)
                if prefix:
                    word = pc.binary_join_element_wise(prefix, word, "")
                if only is not None and len(code):
                    used &= pc.is_in(word, only).to_numpy(zero_copy_only=False)[code]
                pair, times = np.unique(row[used] * max(1, len(word)) + code[used], return_counts=True)
                own = pair // max(1, len(word))
                sizes[:, i] = np.bincount(own, minlength=n)
                rows.append(own)
                words.append(word.take(pa.array(pair % max(1, len(word)))))
                counts.append(times)
            order = np.argsort(np.concatenate(rows), kind="stable")
            edge = np.concatenate([[0], np.cumsum(sizes.sum(axis=1))]).astype(np.int32)
            per_field = pa.array(np.arange(n + 1, dtype=np.int32) * len(names))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.ListArray.from_arrays(per_field, pa.array(lengths.ravel())), pa.ListArray.from_arrays(per_field, pa.array(sizes.ravel())),
                pa.ListArray.from_arrays(pa.array(edge), pa.concat_arrays(words).take(pa.array(order))),
                pa.ListArray.from_arrays(pa.array(edge), pa.array(np.concatenate(counts)[order].astype(np.int32)))], names=schema.names)

    return docs.select("doc_id", *[t.alias(n) for n, t in zip(names, fields.values(), strict=True)]).mapInArrow(run, schema)


def given_weights(postings: DataFrame) -> DataFrame:
    """(doc_id, terms, counts) from rows (doc_id, term, d_weight): a document's terms meet in one row."""
    packed = postings.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("term", F.col("d_weight").cast("double").alias("w")))).alias("l"))
    return packed.select("doc_id", F.col("l.term").alias("terms"), F.col("l.w").alias("counts"))


def bm25_weigh(means: Sequence[float], k1: float, b: float) -> Weigh:
    """Weight of a posting without idf; ``means`` are the mean lengths of the fields."""
    def weigh(counts: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        ratio = lengths.reshape(-1, len(means)) / np.array(means)
        norm = np.repeat(ratio.ravel(), sizes)
        return counts / (counts + k1 * ((1.0 - b) + b * norm))

    return weigh


class Asked:
    """A group of queries: their ids, and for query i the terms ``code`` and weights in [edge[i], edge[i + 1])."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks().sort_by([("query_id", "ascending"), ("term", "ascending")])
        ids = rows.column("query_id").combine_chunks().dictionary_encode()
        terms = rows.column("term").combine_chunks().dictionary_encode()
        self.ids, self.terms = ids.dictionary, terms.dictionary
        owner = ids.indices.to_numpy(zero_copy_only=False)
        self.edge = np.searchsorted(owner, np.arange(len(self.ids) + 1))
        self.code, self.weight = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64), rows.column("q_weight").to_numpy().astype(np.float64)
        required = rows.column("required").to_numpy(zero_copy_only=False) if "required" in rows.column_names else np.zeros(len(owner), bool)
        self.must = np.full(len(self.ids), -1, np.int64)
        self.must[owner[required]] = self.code[required]
        self.only_required = bool(required.any())


class Block:
    """An inverted index over the documents of one block, for the terms of one group of queries."""

    def __init__(self, ids: pa.Array, row: np.ndarray, code: np.ndarray, weight: np.ndarray, n_terms: int):
        order = np.argsort(code, kind="stable")
        self.ids, self.row, self.weight = ids, row[order], weight[order]
        self.edge = np.searchsorted(code[order], np.arange(n_terms + 1))
        self.high, self.low = np.zeros(n_terms), np.zeros(n_terms)
        present = np.flatnonzero(np.diff(self.edge))
        if len(present):
            self.high[present] = np.maximum(np.maximum.reduceat(self.weight, self.edge[present]), 0)
            self.low[present] = np.minimum(np.minimum.reduceat(self.weight, self.edge[present]), 0)

    def bounds(self, asked: Asked) -> tuple[np.ndarray, np.ndarray]:
        """Per query: the most that a document of this block can score, and the postings its terms have here."""
        best = np.maximum(asked.weight * self.high[asked.code], asked.weight * self.low[asked.code])
        n = np.diff(self.edge)[asked.code]
        total, seen = np.concatenate([[0.0], np.cumsum(best)]), np.concatenate([[0], np.cumsum(n)])
        return total[asked.edge[1:]] - total[asked.edge[:-1]], seen[asked.edge[1:]] - seen[asked.edge[:-1]]

    def scores(self, asked: Asked, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores, found) of some queries, a row each: found marks documents that hold a term of the query (the required one)."""
        shape = (len(queries), len(self.ids))
        entry = spans(asked.edge[queries], asked.edge[queries + 1])
        owner = np.repeat(np.arange(len(queries)), asked.edge[queries + 1] - asked.edge[queries])
        low, high = self.edge[asked.code[entry]], self.edge[asked.code[entry] + 1]
        at = spans(low, high)
        cell = np.repeat(owner, high - low) * shape[1] + self.row[at]
        value = np.repeat(asked.weight[entry], high - low) * self.weight[at]
        dense = np.bincount(cell, value, shape[0] * shape[1]).reshape(shape)
        if asked.only_required:
            found = np.zeros(shape, bool)
            must = asked.must[queries]
            low, high = self.edge[must], self.edge[must + 1]
            found[np.repeat(np.arange(len(queries)), high - low), self.row[spans(low, high)]] = True
            return dense, found
        return dense, dense > 0 if (value > 0).all() else np.bincount(cell, minlength=dense.size).reshape(shape) > 0


class Best:
    """The k best (score, id) of every query so far."""

    def __init__(self, n: int, k: int, kind: pa.DataType):
        self.k, self.query, self.score, self.id = k, np.empty(0, np.int64), np.empty(0), pa.array([], kind)
        self.least = np.full(n, -np.inf)

    def add(self, query: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        query, score, ids = np.concatenate([self.query, query]), np.concatenate([self.score, score]), pa.concat_arrays([self.id, ids])
        rounded = np.round(score, PLACES)
        order = np.lexsort((pc.rank(ids, tiebreaker="dense").to_numpy(), -rounded, query))
        place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        kept = order[place < self.k]
        self.query, self.score, self.id = query[kept], score[kept], ids.take(pa.array(kept))
        last = order[place == self.k - 1]
        self.least[query[last]] = rounded[last]


def _search_block(block: Block, asked: Asked, best: Best) -> None:
    bound, postings = block.bounds(asked)
    live = np.flatnonzero((postings > 0) & (bound + SLACK >= best.least))
    if asked.only_required:
        live = live[asked.must[live] >= 0]
    n, k = len(block.ids), best.k
    load = np.cumsum(np.maximum(postings[live], n)) // CELLS
    new_query, new_score, new_row = [], [], []
    for part in np.split(live, np.flatnonzero(np.diff(load)) + 1) if len(live) else []:
        dense, found = block.scores(asked, part)
        least = best.least[part]
        if n > k:
            least = np.maximum(least, np.partition(np.where(found, dense, -np.inf), n - k, axis=1)[:, n - k])
        q, row = np.nonzero(found & (dense >= least[:, None] - SLACK))
        new_query.append(part[q])
        new_score.append(dense[q, row])
        new_row.append(row)
    if new_query:
        best.add(np.concatenate(new_query), np.concatenate(new_score), block.ids.take(pa.array(np.concatenate(new_row))))


def _kernel(shared, k: int, weigh: Weigh | None, kind: pa.DataType):
    def run(batches):
        asked = shared.value
        best = Best(len(asked.ids), k, kind)
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK_ROWS):
                block = batch.slice(low, BLOCK_ROWS)
                terms = block.column("terms")
                row = np.repeat(np.arange(block.num_rows), pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False))
                code = pc.fill_null(pc.index_in(terms.flatten().cast(asked.terms.type), value_set=asked.terms), -1).to_numpy(zero_copy_only=False)
                weight = block.column("counts").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                if weigh is not None:
                    weight = weigh(weight, *(block.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("lengths", "sizes")))
                used = code >= 0
                if used.any():
                    _search_block(Block(block.column("doc_id"), row[used], code[used].astype(np.int64), weight[used], len(asked.terms)), asked, best)
        yield pa.RecordBatch.from_arrays([asked.ids.take(pa.array(best.query)), best.id, pa.array(best.score)], names=["query_id", "doc_id", "score"])

    return run


def groups_of(terms: DataFrame, limit: int) -> Iterator[Asked]:
    """The query terms in groups of about ``limit`` measured bytes; all terms of a query are in one group."""
    n, size = terms.agg(F.count(F.lit(1)), F.sum(F.octet_length("term") + F.octet_length(F.col("query_id").cast("string")) + 32)).first()
    parts = max(1, -(-(size or 0) // limit))
    for part in range(parts if n else 0):
        rows = terms if parts == 1 else terms.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        asked = rows.toArrow()
        if asked.num_rows:
            yield Asked(asked)


def distinct_terms(terms: DataFrame, limit: int = QUERY_BYTES) -> pa.Array | None:
    """The distinct query terms if they are within ``limit`` measured bytes, else None."""
    distinct = terms.select("term").distinct()
    size = distinct.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    return distinct.toArrow().column("term").combine_chunks().cast(pa.string()) if size <= limit else None


def best_documents(lists: DataFrame, terms: DataFrame, k: int, weigh: Weigh | None = None, limit: int | None = None) -> DataFrame:
    """(query_id, doc_id, score): per task, the ``k`` best documents of every query by the sum over shared terms.

    ``lists``: rows of ``term_lists`` (weighed by ``weigh``) or of ``given_weights``; ``terms``: (query_id, term, q_weight), each
    term once a query. With a flag column ``required``, a query finds only documents that hold its required term.
    Equal scores (to 9 places) go by id. The final cut over the tasks is the caller's.
    """
    kind = lists.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("query_id", terms.schema["query_id"].dataType), T.StructField("doc_id", kind), T.StructField("score", T.DoubleType())])
    spark, out = lists.sparkSession, None
    rows = lists.select("doc_id", *(["lengths", "sizes"] if weigh is not None else []), "terms", "counts")
    for asked in groups_of(cut_lineage(terms), limit or QUERY_BYTES):
        part = rows.mapInArrow(_kernel(spark.sparkContext.broadcast(asked), k, weigh, to_arrow_type(kind)), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)
