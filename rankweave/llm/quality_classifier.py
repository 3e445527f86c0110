"""Quality classifier: a generalised additive model with pairwise interactions.

The model is one lookup table per feature and one per chosen pair of features. Tables are learned by cyclic boosting: each
round visits every table in turn and adds a small step of a shallow tree fitted to the current residuals. A score is the
sum of table entries at the bins of a text, so scoring is a few vectorised additions.

Features come from the text alone and are computed in SQL expressions for every document; the fit sees a bounded sample of
labelled rows, drawn by a hash of the id.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.base import word_list
from rankweave.session import cut_lineage

FEATURES = ["words", "word_length", "longest_word", "line_words", "distinct_words", "same_lines", "symbols", "capitals", "digits", "exclaims", "bars", "stops", "non_ascii"]
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, STEP, RIDGE = 120, 60, 0.2, 2.0


def features(text: Column) -> Column:
    """An array of doubles in the order of FEATURES; null and empty texts have defined values."""
    x = F.coalesce(text, F.lit(""))

    def build(x, words, lines):
        n, chars = F.size(words).cast("double"), F.greatest(F.lit(1), F.char_length(x)).cast("double")
        share = lambda chosen: (F.char_length(x) - F.char_length(F.translate(x, chosen, ""))) / chars
        some = F.greatest(F.lit(1.0), n)
        return F.array(
            F.log1p(n), F.char_length(x) / some, F.coalesce(F.array_max(F.transform(words, F.char_length)), F.lit(0)).cast("double"),
            n / F.size(lines), F.size(F.array_distinct(words)) / some, 1 - F.size(F.array_distinct(lines)) / F.size(lines),
            share("#*$%&<>@^~_="), share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("0123456789"), share("!?"), share("|"), share(".,;:"),
            (F.octet_length(x) - F.char_length(x)) / chars)

    bound = F.transform(F.array(F.struct(x.alias("x"), word_list(x).alias("w"), F.split(x, "\n", -1).alias("l"))), lambda s: build(s["x"], s["w"], s["l"]))
    return F.get(bound, 0)


@dataclass
class AdditiveModel:
    edges: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], "right") for i, e in enumerate(self.edges)], axis=1)

    def coarse(self, bins: np.ndarray, i: int) -> np.ndarray:
        return bins[:, i] * PAIR_BINS // (len(self.edges[i]) + 1)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for i, t in enumerate(self.tables):
            out += t[bins[:, i]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            out += t[self.coarse(bins, i), self.coarse(bins, j)]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(self.binned(x))))


def gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def shallow_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf value per bin of a tree that cuts the ordered bins, best cut first, ``depth`` levels deep."""
    total_g, total_h = g.sum(), h.sum()
    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        better = gain(left_g, left_h) + gain(total_g - left_g, total_h - left_h) - gain(total_g, total_h)
        cut = int(np.argmax(better)) + 1
        if better[cut - 1] > 1e-9:
            return np.concatenate([shallow_tree(g[:cut], h[:cut], depth - 1), shallow_tree(g[cut:], h[cut:], depth - 1)])
    return np.full(len(g), total_g / (total_h + RIDGE))


def four_leaves(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, leaf value per cell) of the best single cut along both axes of a table."""
    sums = [np.cumsum(np.cumsum(a, axis=0), axis=1) for a in (g, h)]
    quarter = []
    for s in sums:
        a = s[:-1, :-1]
        top, left = s[:-1, -1:], s[-1:, :-1]
        quarter.append((a, top - a, left - a, s[-1, -1] - top - left + a))
    value = sum(gain(x, y) for x, y in zip(*quarter, strict=True))
    i, j = np.unravel_index(int(np.argmax(value)), value.shape)
    leaf = np.empty(g.shape)
    for k, (rows, cols) in enumerate(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None)))):
        leaf[rows, cols] = quarter[0][k][i, j] / (quarter[1][k][i, j] + RIDGE)
    return float(value[i, j]), leaf


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting of feature tables, then of the pairs that explain most of what is left."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, i], np.arange(1, BINS) / BINS)) if n else np.empty(0) for i in range(width)]
    rate = (y.sum() + 1) / (n + 2)
    model = AdditiveModel(edges, float(np.log(rate / (1 - rate))), [np.zeros(len(e) + 1) for e in edges], [], [])
    if n == 0 or y.min() == y.max():
        return model
    bins = model.binned(x)
    f = model.raw(bins)

    def residuals():
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for i, t in enumerate(model.tables):
            g, h = residuals()
            step = STEP * shallow_tree(np.bincount(bins[:, i], g, len(t)), np.bincount(bins[:, i], h, len(t)))
            t += step
            f += step[bins[:, i]]
    coarse = [model.coarse(bins, i) for i in range(width)]
    cells = lambda i, j, a: np.bincount(coarse[i] * PAIR_BINS + coarse[j], a, PAIR_BINS * PAIR_BINS).reshape(PAIR_BINS, PAIR_BINS)
    g, h = residuals()
    ranked = sorted(((four_leaves(cells(i, j, g), cells(i, j, h))[0], i, j) for i in range(width) for j in range(i)), reverse=True)
    model.pairs = [(i, j) for _, i, j in ranked[:PAIRS]]
    model.pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
            g, h = residuals()
            step = STEP * four_leaves(cells(i, j, g), cells(i, j, h))[1]
            t += step
            f += step[coarse[i], coarse[j]]
    return model


def training_sample(rows: DataFrame, labels: DataFrame, ident: str, label: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` labelled rows, those with the least hash of id and features; rows without a 0/1 label are left out.

    A threshold from the counted rows leaves little more than ``most`` of them (six standard deviations), so what the tasks
    send to the driver does not grow with their number.
    """
    own = labels.where(F.col(label).isin(0, 1)).select(F.col(ident).alias("id"), F.col(label).cast("int").alias("y"))
    joined = rows.where(~F.col("held_out")).select("id", "x").join(own, "id").select("x", "y", F.xxhash64("id", "x").alias("at"))
    n = joined.count()
    share = min(1.0, (most + 6 * most**0.5) / max(1, n))
    below = joined if share == 1.0 else joined.where(F.col("at") < F.lit(int(share * 2**64) - 2**63))
    drawn = below.orderBy("at", "y").limit(most).toPandas()
    if not len(drawn):
        return np.empty((0, len(FEATURES))), np.empty(0)
    return np.array(drawn["x"].tolist(), float), drawn["y"].to_numpy(float)


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, ident: str = "doc_id", text: str = "text", label: str = "quality", limit: float = 0.3, most: int = 50_000) -> DataFrame:
    """(id, held_out, score, predicted), one row per row of ``docs``.

    The fit uses at most ``most`` labelled rows that are not held out. Null and empty texts have features and a score; rows
    with a null id are scored but never learned from; repeated rows score alike; labels other than 0 and 1 are ignored;
    without labels every score is 0.5, with one class it is the smoothed rate. Other columns are not read.
    """
    rows = cut_lineage(docs.select(F.col(ident).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), features(F.col(text)).alias("x")))
    model = docs.sparkSession.sparkContext.broadcast(fit(*training_sample(rows, labels, ident, label, most)))

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.value.predict(np.array(x.tolist(), float).reshape(len(x), -1)) if len(x) else np.empty(0))

    return rows.select("id", "held_out", score("x").alias("score")).withColumn("predicted", (F.col("score") >= limit).cast("int"))
