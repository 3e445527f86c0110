"""Quality rules with robust multivariate outliers, in SQL expressions only.

Each text gives a few counts; ratios of them, transformed to be roughly normal, form its vector. Per (language, source) a
minimum-covariance-determinant estimate is found by concentration steps: of all vectors of the group the
three fifths nearest to the present centre give the next centre and covariance, until they give themselves again. As whole
rings of distance are taken, a few groups end in a cycle of cores instead; they use its core of least determinant. Vectors
far from the centre of their group by Mahalanobis distance are rejected. Groups too small for an estimate use that of
their language, else of the whole table.

Only sums leave a task: moments and histograms of distances per group. Sums are taken over integers, so a rerun gives the
same verdicts whatever the order of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.llm.base import small_side, stripped, word_list
from rankweave.session import cut_lineage

SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: vector entries are integers in units of 1/UNIT
UNIT = 4096
#: quantiles of chi-squared by degrees of freedom (fixed values): median, and the rejection limit at 0.9999
CHI2_HALF = {3: 2.366, 4: 3.357, 5: 4.351, 6: 5.348}
CHI2_TAIL = {3: 21.108, 4: 23.513, 5: 25.745, 6: 27.856}


def with_counts(docs: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """``keep`` with the counts of the text, the number of its lines with a word, and of its capital letters."""
    body = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__x"))
    parts = body.withColumns({"__w": word_list(F.col("__x")), "__l": F.filter(F.split("__x", "\n", -1), lambda s: stripped(s) != "")})
    n = F.size("__w")
    triples = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2))))
    bare = F.translate("__x", " \t\n\x0b\x0c\r", "")
    counted = parts.select(
        *keep, n.cast("long").alias("n_words"), F.char_length(bare).cast("long").alias("word_chars"),
        (F.char_length("__x") - F.char_length(F.translate("__x", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("__l").cast("long").alias("__lines"), (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        (F.char_length(bare) - F.char_length(F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("__capitals"),
        triples.alias("__h"))
    # windows side by side with their equals, then the words that repeated windows cover; skipped where all differ
    repeats = F.size(F.array_distinct("__h")) < F.size("__h")
    ordered = counted.withColumn("__p", F.when(repeats, F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twin = F.filter("__p", lambda p, j: (p["h"] == F.get("__p", j - 1)["h"]) | (p["h"] == F.get("__p", j + 1)["h"]))
    covered = ordered.withColumn("__r", F.transform(twin, lambda p: p["i"]))
    words = F.size(F.array_distinct(F.flatten(F.transform("__r", lambda i: F.array(i, i + 1, i + 2)))))
    return covered.withColumn("n_repeat_words", F.when(F.col("__p").isNull(), F.lit(0)).otherwise(words).cast("long")).drop("__h", "__p", "__r")


def vector() -> dict[str, Column]:
    """The statistic vector: log for a size, arcsine of the root for shares; in integer units."""
    share = lambda a, b: F.asin(F.sqrt(F.least(F.lit(1.0), F.col(a) / F.greatest(F.lit(1), F.col(b)))))
    raw = {
        "word_length": F.log(F.greatest(F.lit(1), F.col("word_chars")) / F.greatest(F.lit(1), F.col("n_words"))),
        "symbols": share("n_symbols", "word_chars"),
        "same_lines": share("n_dup_lines", "__lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "capitals": share("__capitals", "word_chars"),
    }
    return {f"v_{k}": F.round(c * UNIT).cast("long") for k, c in raw.items()}


def _alone(share: float) -> float:
    """The floor at which a share that no other text of the group has rejects by itself beyond ``share``."""
    return math.asin(math.sqrt(share)) / math.sqrt(CHI2_TAIL[5])


#: least spread per statistic: differences well below these are never held against a text. Most groups have no spread of
#: the two shares of copies, so these floors decide there; the spread that a group has comes on top
FLOOR = {"v_word_length": 0.04, "v_symbols": 0.05, "v_same_lines": _alone(0.45), "v_repeats": _alone(0.35), "v_capitals": 0.03}
#: documents a group needs for an estimate of its own; share of a group that the estimate rests on
LEAST_GROUP, CORE = 60, 0.6
#: steps after which a group that is not at its end keeps its least determinant; log determinants that differ by less are of one core
MOST_STEPS, SETTLED = 200, 1e-9
#: groups whose estimates (some 250 bytes each) may be broadcast; more are joined by shuffle
MOST_SENT = 100_000


def group_ids(keys: Sequence[str]) -> list[Column]:
    """A number per level: all keys, all but the last, .., none. Nulls are values of their own."""
    out = []
    for k in range(len(keys), -1, -1):
        own = [c for name in keys[:k] for c in (F.col(name).isNull(), F.col(name))]
        out.append(F.xxhash64(F.lit(k), *own).alias(f"__g{k}"))
    return out


def _pairs(n: int):
    return [(i, j) for i in range(n) for j in range(i + 1)]


def _factored(params: DataFrame, n: int) -> DataFrame:
    """Params with log determinant and the inverse covariance: Cholesky factor, its inverse, and their product."""
    at = lambda p, i, j: F.col(f"{p}_{i}_{j}")
    for j in range(n):  # a column at a time: fewer projections to analyze
        rest = {i: at("s", i, j) for i in range(j, n)}
        for k in range(j):
            rest = {i: r - at("l", i, k) * at("l", j, k) for i, r in rest.items()}
        params = params.withColumn(f"l_{j}_{j}", F.sqrt(rest.pop(j)))
        params = params.withColumns({f"l_{i}_{j}": r / at("l", j, j) for i, r in rest.items()})
    for i in range(n):
        row = {}
        for j in range(i + 1):
            value = F.lit(1.0 if i == j else 0.0)
            for k in range(j, i):
                value = value - at("l", i, k) * at("w", k, j)
            row[f"w_{i}_{j}"] = value / at("l", i, i)
        params = params.withColumns(row)
    inverse = {f"a_{i}_{j}": sum((at("w", k, i) * at("w", k, j) for k in range(i + 1, n)), at("w", i, i) * at("w", i, j)) for i, j in _pairs(n)}
    logdet = 2 * sum((F.log(at("l", i, i)) for i in range(1, n)), F.log(at("l", 0, 0)))
    return params.select("__g", "size", *[f"m_{i}" for i in range(n)], *[c.alias(k) for k, c in inverse.items()], logdet.alias("logdet"))


def _distance(names: Sequence[str]) -> Column:
    x = [F.col(v) / UNIT - F.col(f"m_{i}") for i, v in enumerate(names)]
    return sum((F.col(f"a_{i}_{j}") * x[i] * x[j] * (1 if i == j else 2) for i, j in _pairs(len(names))), F.lit(0.0))


def _moments(sums: DataFrame, names: Sequence[str]) -> DataFrame:
    """Centre and floored covariance from summed integers."""
    floor = [FLOOR[v] ** 2 for v in names]
    mean = [F.col(f"x_{i}") / F.col("n") / UNIT for i in range(len(names))]
    cov = {f"s_{i}_{j}": F.col(f"x_{i}_{j}") / F.col("n") / UNIT ** 2 - mean[i] * mean[j] + F.lit(floor[i] if i == j else 0.0) for i, j in _pairs(len(names))}
    return sums.select("__g", "size", *[m.alias(f"m_{i}") for i, m in enumerate(mean)], *[c.alias(k) for k, c in cov.items()])


def _first_guess(rows: DataFrame, sizes: DataFrame, names: Sequence[str]) -> DataFrame:
    """Median and interquartile range per statistic, from histograms."""
    bin_width = 8
    cells = cut_lineage(rows.select("__g", F.posexplode(F.array(*[F.floor(F.col(v) / bin_width) for v in names])).alias("f", "bin")).groupBy("__g", "f", "bin").agg(F.count(F.lit(1)).alias("c")))
    upto = Window.partitionBy("__g", "f").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = cells.withColumn("cum", F.sum("c").over(upto)).join(sizes, "__g")
    at = lambda q: F.min(F.when(F.col("cum") >= F.col("size") * q, (F.col("bin") + 0.5) * bin_width / UNIT))
    spread = ranked.groupBy("__g", "size", "f").agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    centre = lambda i: F.max(F.when(F.col("f") == i, F.col("q2"))).alias(f"m_{i}")
    width = lambda i: (F.max(F.when(F.col("f") == i, F.pow((F.col("q3") - F.col("q1")) / 1.349, F.lit(2.0)))) + FLOOR[names[i]] ** 2).alias(f"s_{i}_{i}")
    n = len(names)
    wide = spread.groupBy("__g", "size").agg(*[centre(i) for i in range(n)], *[width(i) for i in range(n)])
    return wide.select("*", *[F.lit(0.0).alias(f"s_{i}_{j}") for i, j in _pairs(n) if i != j])


def robust_estimates(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """(__g, centre, inverse covariance, settled, limit) for every group of ``rows`` (__g and the vector) that is large enough.

    ``settled`` is false for a group that was not at a fixed point after MOST_STEPS; its least determinant so far stands.
    """
    sizes = cut_lineage(rows.groupBy("__g").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= LEAST_GROUP))
    groups = sizes.count()
    rows = rows.join(small_side(sizes.select("__g"), groups, MOST_SENT), "__g", "left_semi")
    n = len(names)
    params = cut_lineage(_factored(_first_guess(rows, sizes, names), n))
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(f"x_{i}") for i, v in enumerate(names)], *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"x_{i}_{j}") for i, j in _pairs(n)]]
    ring = F.floor(F.log2(_distance(names) + 1) * 32).cast("int")
    nearer = Window.partitionBy("__g").orderBy("ring").rowsBetween(Window.unboundedPreceding, -1)

    def ringed(p: DataFrame, aggregates: Sequence[Column]) -> DataFrame:
        # stored: the window would else gather the unmerged sums of every task by group alone
        summed = cut_lineage(rows.join(small_side(p, groups, MOST_SENT), "__g").groupBy("__g", "size", ring.alias("ring")).agg(*aggregates))
        return summed.withColumn("before", F.coalesce(F.sum("n").over(nearer), F.lit(0)))

    fields = [*[f"m_{i}" for i in range(n)], *[f"a_{i}_{j}" for i, j in _pairs(n)]]
    state = F.struct("logdet", *fields)
    params = params.withColumn("past", F.slice(F.array(state), 1, 0))
    settled = []
    for _ in range(MOST_STEPS):
        core = ringed(params, sums).where(F.col("before") < F.col("size") * CORE)
        total = core.groupBy("__g", "size").agg(*[F.sum(c).alias(c) for c in ("n", *[f"x_{i}" for i in range(n)], *[f"x_{i}_{j}" for i, j in _pairs(n)])])
        following = _factored(_moments(total, names), n).join(small_side(params.select("__g", "past"), groups, MOST_SENT), "__g")
        again = F.array_position(F.transform("past", lambda p: F.abs(p["logdet"] - F.col("logdet")) < SETTLED), True)
        following = cut_lineage(following.withColumn("again", again).withColumn("past", F.concat("past", F.array(state))))
        cycle = F.slice("past", F.greatest(F.col("again"), F.lit(1)).cast("int"), F.size("past"))
        ended = F.array_min(cycle).alias("p")
        settled.append(following.where("again > 0").select("__g", "size", ended).select("__g", "size", "p.*", F.lit(True).alias("settled")))
        params = following.where("again = 0")  # groups at their end take no part in later steps
        if not params.count():
            break
    else:
        settled.append(params.select("__g", "size", F.array_min("past").alias("p")).select("__g", "size", "p.*", F.lit(False).alias("settled")))
    params = cut_lineage(reduce(DataFrame.unionByName, settled))
    middle = ringed(params, sums[:1]).where(F.col("before") < F.col("size") * 0.5).groupBy("__g").agg((F.pow(F.lit(2.0), (F.max("ring") + 1) / 32) - 1).alias("half"))
    return cut_lineage(params.join(middle, "__g").withColumn("limit", F.greatest(F.lit(1.0), F.col("half") / CHI2_HALF[n]) * CHI2_TAIL[n]).drop("size", "logdet", "half"))


def quality_rules(docs: DataFrame, text: str = "text", keys: Sequence[str] = ("lang", "source"), keep: Sequence[str] | None = None, least_words: int = 50) -> DataFrame:
    """``keep`` (all columns by default) with the counts, base_failed, distance, settled (see ``robust_estimates``) and kept.

    base_failed: fewer than ``least_words`` words, or over half of them inside repeated three-word windows. A null, empty or
    blank text has no words. Null keys are values of their own. Equal rows get equal verdicts. Groups of fewer than 60
    documents that pass the base rules use the estimate of their outer group; a table that small keeps all that pass.
    Columns of ``docs`` that clash with the new ones are replaced.
    """
    added = {*COUNTS, "base_failed", "distance", "settled", "kept"}
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    names = [f"v_{k}" for k in ("word_length", "symbols", "same_lines", "repeats", "capitals")]
    ids = group_ids(keys)
    levels = [f"__g{k}" for k in range(len(keys), -1, -1)]
    carried = docs.select(*[F.col(c) for c in keep], *ids, F.col(text).alias("__body"))
    stats = with_counts(carried, "__body", [*keep, *levels])
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = cut_lineage(stats.withColumns(vector()).withColumn("base_failed", failed).drop("__lines", "__capitals"))
    rows = stats.where(~F.col("base_failed")).select(F.explode(F.array(*levels)).alias("__g"), *names)
    estimates = robust_estimates(rows, names)
    groups = estimates.count()
    fields = [c for c in estimates.columns if c != "__g"]
    out = stats
    for level in levels:  # the narrowest group with an estimate decides
        own = estimates.join(stats.select(F.col(level).alias("__g")).distinct(), "__g", "left_semi")
        own = cut_lineage(own.select(F.col("__g").alias(level), F.struct(*fields).alias(f"__e{level}")))
        out = out.join(small_side(own, groups, MOST_SENT), level, "left")
    chosen = out.withColumn("__e", F.coalesce(*[F.col(f"__e{level}") for level in levels]))
    judged = chosen.select(*keep, *COUNTS, "base_failed", *names, "__e.*").withColumn("distance", _distance(names))
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= F.col("limit"), F.lit(True))).select(*keep, *COUNTS, "base_failed", "distance", "settled", "kept")
