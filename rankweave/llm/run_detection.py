"""Runs (maximal repetitions) of words, found by dyadic catchers of squares.

As soon as a block of 2^k words is complete, it gets a catcher: the catcher watches the words that are appended 2^(k+1) to
2^(k+2) - 1 places later and compares the latest 2^k of them with its block. A square whose period lies in that range holds a
whole block in its first half, so its catcher sees the block again one period later. A sighting then grows: to the left into
the words before the block, to the right with each further word, until the words one period apart differ. If the stretch is
two periods long it is a square, and sightings of neighbouring catchers at the same distance are one run. Multiples of a
period catch the same stretch as the period itself, so of equal stretches the least period stays.

All texts of a batch are one line of word hashes with a separator of its own between any two, and each step is taken for all
catchers of a level at once. Suffixes are compared by their hashes (words doubled level by level), so a sighting grows in
as many steps as its level, whatever its length. A text of n words costs about 2 n comparisons a level, and has log2(n) levels.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rankweave.llm.base import small_batches
from rankweave.llm.decontaminate import pieces
from rankweave.llm.wordscan import ODD, WordScanner, chain, mix

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
#: periods up to this one are compared place by place
DENSE = 3
#: lines of more words keep only every third level of hashes
LONG_LINE = 1 << 21
#: bytes of a text that are split into words at once
PART = 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")


class CaseScanner(WordScanner):
    """Words between ASCII spaces, as they are written."""

    def __init__(self):
        super().__init__()
        self.value = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(ODD))


class SuffixHashes:
    """Hashes of the 2^k words from every place of a line, for growing levels k; some levels are kept for later comparison."""

    def __init__(self, line: np.ndarray):
        self.n, self.level, self.now = len(line), 0, line
        self.gap = 1 if len(line) <= LONG_LINE else 3
        self.kept = [(0, line)]

    def up(self) -> np.ndarray:
        """The next level."""
        half = 1 << self.level
        self.now, self.level = chain(self.now[:-half], self.now[half:]), self.level + 1
        if self.level % self.gap == 0:
            self.kept.append((self.level, self.now))
        return self.now

    def grown(self, low: np.ndarray, high: np.ndarray, period: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Stretches [low, high) whose words equal those ``period`` later, made as long as they go: by under 2^level words a side."""
        above = level
        for k, hashes in reversed([x for x in self.kept if x[0] < level]):
            step, last = 1 << k, len(hashes) - 1
            for _ in range((1 << (above - k)) - 1):
                at = low - step
                low = np.where((at >= 0) & (hashes[np.maximum(at, 0)] == hashes[np.minimum(np.maximum(at, 0) + period, last)]), at, low)
                at = high + period
                high = np.where((at <= last) & (hashes[np.minimum(high, last)] == hashes[np.minimum(at, last)]), high + step, high)
            above = k
        return low, high


def sightings(suffixes: SuffixHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first block, last block, distance) of all chains of blocks of this level that are seen again at one distance."""
    level, hashes = suffixes.level, suffixes.now
    size, width = 1 << level, 2 << level
    blocks = (len(hashes) - 1) // size + 1
    padded = np.zeros(blocks * size + 2 * width, np.uint64)
    padded[:len(hashes)] = hashes
    later = np.lib.stride_tricks.as_strided(padded[width:], (blocks, width), (8 * size, 8))
    seen = np.flatnonzero((later == padded[:blocks * size:size, None]).ravel())
    block, distance = seen // width, seen % width + width
    order = np.lexsort((block, distance))
    block, distance = block[order], distance[order]
    fresh = np.ones(len(block) + 1, bool)
    fresh[1:-1] = (distance[1:] != distance[:-1]) | (block[1:] != block[:-1] + 1)
    at = np.flatnonzero(fresh)
    return block[at[:-1]], block[at[1:] - 1], distance[at[:-1]]


def runs_of_line(line: np.ndarray, longest: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the runs of a line, by start and period; no text in it has more than ``longest`` words."""
    found = []
    for d in range(1, min(DENSE, longest // 2) + 1):
        edge = np.diff(np.concatenate([[False], line[:-d] == line[d:], [False]]).astype(np.int8))
        low, high = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        found.append((low, high, np.full(len(low), d)))
    suffixes, level = SuffixHashes(line), 1
    while 4 << level <= longest:
        suffixes.up()
        first, last, distance = sightings(suffixes)
        if len(first):
            found.append((*suffixes.grown(first << level, last + 1 << level, distance, level), distance))
        level += 1
    if not found:
        return (np.empty(0, np.int64),) * 3
    low, high, period = (np.concatenate([f[i] for f in found]) for i in range(3))
    good = (high - low >= period) & (high - low + period >= least)
    start, period = low[good], period[good]
    end = high[good] + period
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[first], end[first], period[first]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def runs_of_texts(words: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) by text, start and period; texts of about the same length share a line."""
    n, out = np.diff(bounds), []
    size = np.zeros(len(n), np.int64)
    size[n > 0] = np.log2(n[n > 0]).astype(np.int64)
    size[n < least] = -1
    for c in np.unique(size[size >= 0]):
        rows = np.flatnonzero(size == c)
        line_bounds = np.concatenate([[0], np.cumsum(n[rows] + 1)])  # each text is followed by a separator
        line = mix(np.arange(line_bounds[-1], dtype=np.uint64) + np.uint64(1 << 62))
        place = np.arange(line_bounds[-1])
        inside = np.ones(len(line), bool)
        inside[line_bounds[1:] - 1] = False
        line[inside] = words[(place + np.repeat(bounds[rows] - line_bounds[:-1], n[rows] + 1))[inside]]
        start, end, period = runs_of_line(line, int(n[rows].max()), least)
        text = np.searchsorted(line_bounds, start, "right") - 1
        out.append((rows[text], start - line_bounds[text], end - start, period))
    if not out:
        return (np.empty(0, np.int64),) * 4
    text, start, length, period = (np.concatenate([o[i] for o in out]) for i in range(4))
    order = np.argsort(text, kind="stable")
    return text[order], start[order], length[order], period[order]


def kept_words(text: bytes, keep: np.ndarray | None) -> bytes:
    """The words of a text that ``keep`` marks (None: all) joined by single spaces; a long text is split part by part."""
    out, at, low = [], 0, 0
    while low < len(text):
        cut = SPACE.search(text, low + PART)
        high = cut.end() if cut else len(text)
        words = text[low:high].split()
        if keep is not None:
            words, at = [w for w, k in zip(words, keep[at:at + len(words)].tolist(), strict=True) if k], at + len(words)
        if words:
            out.append(b" ".join(words))
        low = high
    return b" ".join(out)


def detect_runs(docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None, least: int = 12) -> DataFrame:
    """``keep`` (default: all columns but the text) with runs and collapsed, one row per row of ``docs``.

    Words lie between ASCII spaces and are compared as written. ``runs``: array of (start, length, period) by start and
    period; a run has its smallest period, is at least ``least`` words and two periods long, and no neighbouring word
    extends it. ``collapsed``: the words that no run holds after its first period, joined by single spaces. A null, empty
    or blank text has no runs and collapses to an empty text; equal rows get equal answers; an empty table stays empty;
    columns whose names clash with the new ones are replaced. A text is handled whole, in memory of 8 bytes a word for each of
    its log2(n) levels (for every third level beyond 2^21 words).
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in (text, "runs", "collapsed")]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])

    def run(batches):
        scanner = CaseScanner()
        for batch in batches:
            words, bounds = scanner.scan(batch.column(0))
            for first, last in pieces(bounds):
                own = bounds[first:last + 1]
                row, *values = runs_of_texts(words, own, least)
                n = np.diff(own)
                edge = np.concatenate([[0], np.cumsum(n)])
                change = np.zeros(edge[-1] + 1, np.int64)
                start, length, period = values
                np.add.at(change, edge[row] + start + period, 1)
                np.add.at(change, edge[row] + start + length, -1)
                rest = np.cumsum(change) == 0
                has_run = np.zeros(len(n), bool)
                has_run[row] = True
                texts = batch.column(0).slice(first, last - first).cast(pa.binary())
                collapsed = [kept_words(t.as_py() or b"", rest[edge[i]:edge[i + 1]] if has_run[i] else None) for i, t in enumerate(texts)]
                offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(n)))]).astype(np.int32)
                runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(v.astype(np.int64)) for v in values], names=RUN.names))
                others = [batch.column(i + 1).slice(first, last - first) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*others, runs, pa.array(collapsed, pa.binary()).cast(pa.string())], names=schema.names)

    return small_batches(docs).select(docs[text].alias("__text"), *[docs[c] for c in kept]).mapInArrow(run, schema)
