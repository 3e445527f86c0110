"""Packing by lexical retrieval: windows are filled with the BM25 neighbours of a seed document.

Texts are tokenised once and stored. Whole windows of a long text are sequences of their own, in rows of at most
``BLOCK`` windows; what is left of each document, under one window, is what has to be packed with others.

The index is over whole documents, and its terms are the vocabulary's ids, so its statistics (document frequencies, mean
length) are bounded by the vocabulary and the same in every shard. A document belongs to its topic, a term that is frequent in it and
rare elsewhere: neighbours tend to share it. Topics are laid out in shards of about ``shard_tokens`` tokens
by their exact totals (one number a vocabulary entry on the driver); a topic beyond that is split by a hash of the row, so
no shard grows with a hot topic or a hot group of copies.

A shard is an inverted index of its remainders, in one task. The next unused document is a seed; the index returns the
unused documents that share its strongest terms, best first; they fill the window. The last one is cut, and its rest is the
next seed. When the neighbours run out, unused documents follow in order of the shard. What remains at the end of a shard
is cut into sequences of powers of two, so nothing is padded.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.llm.base import row_key, small_batches
from rankweave.session import cut_lineage

#: windows in one stored row of a long text
BLOCK = 16
#: characters of a text that are encoded at once; a text is cut before a space that follows another character
PART = 1 << 18
#: what a row counts for beside its tokens, so that a shard holds a bounded number of tiny documents, too
ROW_COST = 32
K1, B = 1.2, 0.75
#: the pattern of the byte-level pre-tokenizer (fixed value)
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Ids of a tokenizer file, without added special tokens.

    A byte-level BPE file whose ids follow its merges is handed to tiktoken, which gives the same ids several times faster;
    any other file is used by the tokenizers library itself.
    """

    def __init__(self, file: str):
        self.file, self.tokenizer, self.fast = file, None, None
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        ranks = self._ranks(spec)
        if ranks is not None:
            import tiktoken

            special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
            self.fast = tiktoken.Encoding("file", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def _one(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all")
            except ValueError:  # its pattern engine gives up on very long runs of blanks
                pass
        if self.tokenizer is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            import tokenizers

            self.tokenizer = tokenizers.Tokenizer.from_file(self.file)
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    @staticmethod
    def _ranks(spec: dict) -> dict[bytes, int] | None:
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "unk_token"))
        level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        added = spec.get("added_tokens") or []
        if not (plain and level) or spec.get("normalizer") or any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in added):
            return None
        # the printable stand-in of each byte: itself if it prints, else the next character from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        vocab = model["vocab"]
        if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
            return None
        names = {t["content"] for t in added}
        return {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in names}

    def ids(self, text: str) -> np.ndarray:
        if len(text) <= PART:
            return self._one(text) if text else np.empty(0, np.uint32)
        out, low = [], 0
        while low < len(text):
            at = text.find(" ", low + PART)
            while at >= 0 and text[at - 1].isspace():
                at = text.find(" ", at + 1)
            high = at if at >= 0 else len(text)
            out.append(self._one(text[low:high]))
            low = high
        return np.concatenate(out)


def narrow(ids: np.ndarray) -> bytes:
    """Little-endian, two bytes an id if all of them fit, else four; ``widened`` tells by the length."""
    return ids.astype("<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4").tobytes()


def widened(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype(np.uint32)


def tokenised(docs: DataFrame, file: str, ident: str, text: str, window: int, end_id: int) -> DataFrame:
    """Rows (id, k, t, start, length, doc_tokens, topic, ids, terms, counts): whole windows, BLOCK at most a row, and the remainder.

    The remainder has the document's topic, whole windows -1. The last row of a document of more than ``window`` tokens
    carries the document's distinct terms and their counts; in a shorter one its ids tell them.
    """
    schema = T.StructType([
        T.StructField("id", docs.schema[ident].dataType), *[T.StructField(c, T.LongType()) for c in ("k", "t", "start", "length", "doc_tokens", "topic")],
        *[T.StructField(c, T.BinaryType()) for c in ("ids", "terms", "counts")]])

    def run(batches):
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(file)
            same = batch.column(3).fill_null("").dictionary_encode()
            encoded = [np.append(encoder.ids(x.as_py()), np.uint32(end_id)) for x in same.dictionary]
            known = [np.unique(e[:-1], return_counts=True) for e in encoded]
            topic = [topic_of(*k) for k in known]
            source, rows = [], []
            for i, e in enumerate(same.indices.to_pylist()):
                ids, n = encoded[e], len(encoded[e])
                whole = n // window * window
                edges = [*range(0, whole, BLOCK * window), whole, *([n] if n > whole else [])]
                for low, high in zip(edges[:-1], edges[1:], strict=True):
                    told = high == n > window
                    source.append(i)
                    rows.append((low, high - low, n, topic[e] if high > whole else -1, narrow(ids[low:high]),
                                 narrow(known[e][0]) if told else None, known[e][1].astype("<u4").tobytes() if told else None))
                if len(rows) >= 4096 or i == batch.num_rows - 1:
                    keys = [batch.column(c).take(pa.array(source, pa.int64())) for c in range(3)]
                    yield pa.RecordBatch.from_arrays([*keys, *[pa.array([r[j] for r in rows], kind) for j, kind in enumerate([pa.int64()] * 4 + [pa.binary()] * 3)]], names=schema.names)
                    source, rows = [], []

    keys = [c.alias(n) for c, n in zip(row_key(ident, text), ("k", "t"), strict=True)]
    return small_batches(docs).select(F.col(ident).alias("id"), *keys, F.col(text).alias("text")).mapInArrow(run, schema)


def term_rows(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of a batch or table of last rows, by row and term."""
    row, term, count = [], [], []
    n, whole = rows.column("length").to_numpy(), rows.column("doc_tokens").to_numpy()
    ids, terms, counts = (rows.column(c) for c in ("ids", "terms", "counts"))
    brief = np.flatnonzero(n == whole)
    flat = [widened(ids[int(i)].as_py(), int(n[i]))[:-1] for i in brief]
    if flat:
        key, times = np.unique(np.repeat(brief, [len(f) for f in flat]) << 32 | np.concatenate(flat).astype(np.int64), return_counts=True)
        row, term, count = [key >> 32], [key & 0xFFFFFFFF], [times]
    for i in np.flatnonzero(n != whole):
        times = np.frombuffer(counts[int(i)].as_py(), "<u4").astype(np.int64)
        row.append(np.full(len(times), i))
        term.append(widened(terms[int(i)].as_py(), len(times)).astype(np.int64))
        count.append(times)
    if not row:
        return (np.empty(0, np.int64),) * 3
    row, term, count = np.concatenate(row), np.concatenate(term), np.concatenate(count)
    order = np.argsort(row, kind="stable")
    return row[order], term[order], count[order]


class Statistics:
    """Document frequencies by vocabulary id, number of documents and their mean length."""

    def __init__(self, df: np.ndarray, documents: int, mean_length: float):
        self.df, self.mean_length = df, mean_length
        self.idf = np.log1p((documents - df + 0.5) / (df + 0.5))

    def weights(self, term: np.ndarray, count: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self.idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * length / self.mean_length))


def statistics(stored: DataFrame) -> Statistics:
    """Over all documents; the driver gets one number a vocabulary entry."""
    last = stored.where(F.col("start") + F.col("length") == F.col("doc_tokens"))

    def run(batches):
        df = np.zeros(0, np.int64)
        for batch in batches:
            more = np.bincount(term_rows(batch)[1])
            if len(more) > len(df):
                df, more = more, df
            df[:len(more)] += more
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(df[used])], names=["term", "df"])

    found = last.select("length", "doc_tokens", "ids", "terms", "counts").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(int(found["term"].max()) + 1 if len(found) else 0, np.int64)
    df[found["term"].to_numpy(np.int64)] = found["df"].to_numpy(np.int64)
    n, mean = last.agg(F.count(F.lit(1)), F.avg(F.col("doc_tokens") - 1)).first()
    return Statistics(df, n, mean or 1.0)


def topic_of(terms: np.ndarray, counts: np.ndarray) -> int:
    """The term that says most about a document, -1 without terms: frequent there, and late in the vocabulary.

    A vocabulary of merges lists frequent terms first, so a term's number tells how rare it is in general, and the topic is
    known as soon as a text is tokenised.
    """
    if not len(terms):
        return -1
    return int(terms[np.argmax(np.log1p(terms) * (counts / (counts + K1)))])


def layout(totals: dict[int, int], shard_tokens: int) -> list[tuple[int, int, int]]:
    """(topic, first shard, parts): small topics share a shard, a large one is split over several."""
    out, shard, used = [], 0, 0
    for topic in sorted(totals):
        size = totals[topic]
        if used and used + size > shard_tokens:
            shard, used = shard + 1, 0
        parts = max(1, -(-size // shard_tokens))
        out.append((topic, shard, parts))
        if parts > 1:
            shard += parts
        else:
            used += size
    return out


def sharded(stored: DataFrame, shard_tokens: int) -> DataFrame:
    """``stored`` with its shard. The driver sees one total a topic, at most as many as the vocabulary has entries."""
    totals = stored.groupBy("topic").agg(F.sum(F.col("length") + ROW_COST).alias("size")).collect()
    plan = stored.sparkSession.createDataFrame(layout({r["topic"]: r["size"] for r in totals}, shard_tokens), "topic long, first long, parts long")
    part = F.pmod(F.xxhash64("k", "t", "start"), F.col("parts"))
    return stored.join(F.broadcast(plan), "topic").withColumn("shard", F.col("first") + part).drop("first", "parts", "topic")


class ShardIndex:
    """An inverted index over the rows of one shard."""

    def __init__(self, rows, stats: Statistics, asked: int):
        self.n = rows.num_rows
        row, term, count = term_rows(rows)
        weight = stats.weights(term, count, rows.column("doc_tokens").to_numpy()[row] - 1) if len(row) else np.empty(0)
        strongest = np.lexsort((term, -weight, row))
        edge = np.searchsorted(row[strongest], np.arange(self.n + 1))
        self.query = [term[strongest[a:min(a + asked, b)]] for a, b in zip(edge[:-1], edge[1:], strict=True)]
        order = np.lexsort((row, term))
        self.row, self.weight, term = row[order], weight[order], term[order]
        self.terms, first = np.unique(term, return_index=True)
        self.edge = np.append(first, len(term))

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused rows that share one of the seed's strongest terms, by falling score, then by number."""
        at = np.searchsorted(self.terms, self.query[seed])
        spans = [slice(self.edge[i], self.edge[i + 1]) for i in at]
        if not spans:
            return np.empty(0, np.int64)
        score = np.bincount(np.concatenate([self.row[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)
        found = np.flatnonzero((score > 0) & unused)
        return found[np.argsort(-score[found], kind="stable")]


def fill_windows(length: np.ndarray, index: ShardIndex, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (row, start in the row, length); all but the last are full."""
    n = len(length)
    unused, taken = np.ones(n, bool), np.zeros(n, np.int64)
    out, cut, following = [], -1, 0
    while True:
        if cut < 0:
            while following < n and not unused[following]:
                following += 1
            if following == n:
                return out
            cut = following
        seed, cut = cut, -1
        unused[seed] = False
        sequence, room = [(seed, int(taken[seed]), int(length[seed] - taken[seed]))], window - int(length[seed] - taken[seed])
        for source in (index.neighbours(seed, unused) if room else [], None):
            at = 0
            while room:
                if source is None:  # no neighbour left: the next unused rows
                    while following < n and not unused[following]:
                        following += 1
                    if following == n:
                        break
                    row = following
                elif at < len(source):
                    row, at = int(source[at]), at + 1
                else:
                    break
                part = min(room, int(length[row]))
                sequence.append((row, 0, part))
                unused[row], taken[row], room = False, part, room - part
                if part < length[row]:
                    cut = row
        out.append(sequence)


def powers(sequence: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A sequence cut into sequences whose lengths are powers of two, the largest first."""
    rest, out = sum(n for _, _, n in sequence), []
    pieces = list(reversed(sequence))
    while rest:
        room, own = 1 << (rest.bit_length() - 1), []
        rest -= room
        while room:
            row, start, n = pieces.pop()
            part = min(n, room)
            own.append((row, start, part))
            room -= part
            if part < n:
                pieces.append((row, start + part, n - part))
        out.append(own)
    return out


def pack_shard(rows: pa.Table, stats: Statistics, window: int, asked: int) -> pa.Table:
    """All pieces of one shard."""
    rows = rows.combine_chunks().sort_by([("k", "ascending"), ("t", "ascending"), ("start", "ascending")])
    length = rows.column("length").to_numpy()
    part = np.flatnonzero(length < window)
    sequences = [[(i, at, window)] for i in np.flatnonzero(length >= window).tolist() for at in range(0, int(length[i]), window)]
    if len(part):
        filled = fill_windows(length[part], ShardIndex(rows.take(pa.array(part)), stats, asked), window)
        if sum(n for _, _, n in filled[-1]) < window:
            filled[-1:] = powers(filled[-1])
        sequences += [[(int(part[row]), start, n) for row, start, n in s] for s in filled]
    number = np.repeat(np.arange(len(sequences)), [len(s) for s in sequences])
    row, start, size = (np.array([p[j] for s in sequences for p in s], np.int64) for j in range(3))
    before = np.cumsum(size) - size
    offset = before - np.repeat(before[np.searchsorted(number, np.arange(len(sequences)))], [len(s) for s in sequences])
    ids = [widened(x.as_py(), int(n)) for x, n in zip(rows.column("ids"), length, strict=True)]
    pieces = [ids[r][s:s + n].astype("<u4").tobytes() for r, s, n in zip(row.tolist(), start.tolist(), size.tolist(), strict=True)]
    shard = rows.column("shard")[0].as_py()
    at = pa.array(row)
    return pa.table({
        "id": rows.column("id").take(at), "start": pa.array(rows.column("start").to_numpy()[row] + start), "length": pa.array(size),
        "doc_tokens": rows.column("doc_tokens").take(at), "sequence_id": pa.array((shard << 32) + number), "offset": pa.array(offset), "ids": pa.array(pieces, pa.binary())})


def pack_documents(docs: DataFrame, file: str, ident: str = "doc_id", text: str = "text", window: int = 1024, end_id: int = 0, shard_tokens: int = 1 << 19, asked: int = 32) -> DataFrame:
    """Pieces (id, start, length, doc_tokens, sequence_id, offset, ids) of all documents; ``ids`` are little-endian 32-bit numbers.

    Every document ends with ``end_id``, so a null or empty text is one token. Each of its ids lies in one piece. Sequences hold
    ``window`` tokens, or a power of two at the end of a shard. Rows with the same id are packed one by one; a null id is
    an id. An empty table gives an empty one. Other columns are not read. ``asked``: terms of a seed that its query takes,
    the strongest ones. Sequence numbers are unique, and the same on every run. The file must be readable by every worker.
    """
    stored = cut_lineage(tokenised(docs, file, ident, text, window, end_id))
    stats = statistics(stored)
    placed = sharded(stored, shard_tokens)
    schema = T.StructType([stored.schema["id"], *[T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")], T.StructField("ids", T.BinaryType())])
    return placed.groupBy("shard").applyInArrow(lambda rows: pack_shard(rows, stats, window, asked), schema)
