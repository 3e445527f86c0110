"""User features over time windows, scaling and encoding, histories and sequences."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave import skew
from rankweave.functions.scalar import days_between, last_digits, year_month
from rankweave.functions.vectors import let

WINDOWS = (1, 7, 30, 90)


def _in_window(ts: Column, as_of: Column, days: int) -> Column:
    return (ts >= as_of - F.make_dt_interval(F.lit(days))) & (ts < as_of)


def window_features(users: DataFrame, transactions: DataFrame, events: DataFrame, as_of: str, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """Counts, mean amount, velocity, clicks, searches and distinct clicked links per window.

    One pass: rows are first merged per (user, detail), so the distinct links of a window are
    the details whose last click lies in it, and no distinct-count expansion is needed.
    """
    now = F.lit(as_of).cast("timestamp")
    rows = transactions.select("user_id", "ts", F.lit("tx").alias("kind"), "amount", F.lit(None).cast("string").alias("detail")).unionByName(
        events.select("user_id", "ts", F.col("event_type").alias("kind"), F.lit(None).cast("double").alias("amount"), "detail")
    ).where(_in_window(F.col("ts"), now, max(windows)))
    first, second = [], []
    for w in windows:
        inside = _in_window(F.col("ts"), now, w)
        first += [
            F.count_if(inside & (F.col("kind") == "tx")).alias(f"tx_{w}"),
            F.sum(F.when(inside & (F.col("kind") == "tx"), F.col("amount"))).alias(f"amount_{w}"),
            F.count_if(inside & (F.col("kind") == "nav_click")).alias(f"click_{w}"),
            F.count_if(inside & (F.col("kind") == "search")).alias(f"search_{w}"),
        ]
        second += [
            F.sum(f"tx_{w}").alias(f"transaction_count_{w}d"),
            F.sum(f"amount_{w}").alias(f"amount_{w}"),
            F.sum(f"click_{w}").alias(f"nav_clicks_{w}d"),
            F.sum(f"search_{w}").alias(f"search_queries_{w}d"),
            F.count_if((F.col(f"click_{w}") > 0) & F.col("detail").isNotNull()).alias(f"unique_nav_links_{w}d"),
        ]
    per_user = rows.groupBy("user_id", "detail").agg(*first).groupBy("user_id").agg(*second)
    out = users.select("user_id").join(per_user, "user_id", "left")
    columns = ["user_id"]
    for w in windows:
        count = F.coalesce(F.col(f"transaction_count_{w}d"), F.lit(0))
        columns += [
            count.alias(f"transaction_count_{w}d"),
            F.when(count > 0, F.col(f"amount_{w}") / count).otherwise(F.lit(0.0)).alias(f"avg_transaction_amount_{w}d"),
            (count / F.lit(float(w))).alias(f"transaction_velocity_{w}d"),
            *[F.coalesce(F.col(f"{c}_{w}d"), F.lit(0)).alias(f"{c}_{w}d") for c in ("nav_clicks", "search_queries", "unique_nav_links")],
        ]
    return out.select(*columns)


def decayed_spend(transactions: DataFrame, as_of: str, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """Per user and category: spend weighted by a half-life of half the window, one column per window."""
    now = F.lit(as_of).cast("timestamp")
    age = days_between(now, F.col("ts"))
    sums = []
    for w in windows:
        half_life = w / 2
        weight = F.exp(F.lit(-math.log(2) / half_life) * age) if half_life > 0 else F.lit(1.0)
        sums.append(F.coalesce(F.sum(F.when(_in_window(F.col("ts"), now, w), F.col("amount") * weight)), F.lit(0.0)).alias(f"spending_decay_{w}d"))
    return transactions.groupBy("user_id", "category").agg(*sums)


def spend_wide(decayed: DataFrame, categories: Sequence[str], windows: Sequence[int] = WINDOWS) -> DataFrame:
    """One column per (category, window) for a given category list."""
    aggs = [
        F.coalesce(F.sum(F.when(F.col("category") == c, F.col(f"spending_decay_{w}d"))), F.lit(0.0)).alias(f"{c}_spending_decay_{w}d")
        for c in categories for w in windows
    ]
    return decayed.groupBy("user_id").agg(*aggs)


def trend_ratio(features: DataFrame, short: str = "transaction_count_7d", long: str = "transaction_count_30d") -> DataFrame:
    return features.withColumn("transaction_trend_7d_vs_30d", F.col(short) / F.greatest(F.col(long), F.lit(1)))


def recency(users: DataFrame, events: DataFrame, details: Sequence[str], as_of: str, bound_to_as_of: bool = False) -> DataFrame:
    """Whole days since the last event with each detail value, -1 when there is none."""
    now = F.lit(as_of).cast("timestamp")
    rows = events.where(F.col("detail").isin(list(details)))
    if bound_to_as_of:
        rows = rows.where(F.col("ts") < now)
    last = rows.groupBy("user_id").agg(*[F.max(F.when(F.col("detail") == d, F.col("ts"))).alias(f"last_{d}") for d in details])
    return users.select("user_id").join(last, "user_id", "left").select(
        "user_id",
        *[F.coalesce(F.floor(days_between(now, F.col(f"last_{d}"))), F.lit(-1)).alias(f"days_since_last_{d}") for d in details],
    )


def profile_aggregate(rows: DataFrame, key: str, measures: Sequence[str], flags: Sequence[str]) -> DataFrame:
    return rows.groupBy(key).agg(*[F.avg(m).alias(m) for m in measures], *[F.max(f).alias(f) for f in flags])


def standard_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Population z-score; a constant column is only centred. Fitted values enter as scalar subqueries."""
    fitted = df.agg(F.struct(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in cols]).alias("s")).scalar()
    staged = df.withColumn("__fit", fitted)
    scaled = {c: (F.col(c) - F.col(f"__fit.{c}.mean")) / F.when(F.col(f"__fit.{c}.std") > 0, F.col(f"__fit.{c}.std")).otherwise(F.lit(1.0)) for c in cols}
    return staged.withColumns({f"{c}_z": v for c, v in scaled.items()}).drop("__fit")


def minmax_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - min) / (max - min); a constant column becomes 0."""
    fitted = df.agg(F.struct(*[F.struct(F.min(c).alias("low"), F.max(c).alias("high")).alias(c) for c in cols]).alias("s")).scalar()
    staged = df.withColumn("__fit", fitted)
    out = {}
    for c in cols:
        low, width = F.col(f"__fit.{c}.low"), F.col(f"__fit.{c}.high") - F.col(f"__fit.{c}.low")
        out[f"{c}_mm"] = F.when(width > 0, (F.col(c) - low) / width).otherwise(F.lit(0.0))
    return staged.withColumns(out).drop("__fit")


def category_index(df: DataFrame, col: str) -> DataFrame:
    """(value, index): the distinct values in order, from 0; any number of them, numbered by ranges."""
    values = df.select(F.col(col).alias("value")).where(F.col("value").isNotNull()).distinct()
    return skew.numbered(values, [F.col("value")], "index").select("value", (F.col("index") - 1).cast("int").alias("index"))


def with_index(rows: DataFrame, col: str, index: DataFrame, out: str) -> DataFrame:
    """``rows`` with the index of their category, null for an unknown one; the planner broadcasts the table if its size allows."""
    return rows.join(index.select(F.col("value").alias(col), F.col("index").alias(out)), col, "left")


def sparse(size: int, indices: Column, values: Column) -> Column:
    """A sparse vector: its size, and the places (ascending) that are not zero."""
    return F.struct(F.lit(size).alias("size"), indices.cast("array<int>").alias("indices"), values.cast("array<double>").alias("values"))


def one_hot(rows: DataFrame, col: str, index: DataFrame, out: str) -> DataFrame:
    """``rows`` with the sparse one-hot vector of a category column; all zeros for an unknown category."""
    found = F.array_compact(F.array(F.col("__i")))
    return with_index(rows, col, index, "__i").withColumn(out, sparse(index.count(), found, F.transform(found, lambda i: F.lit(1.0)))).drop("__i")


def dense(vector: Column) -> Column:
    """All places of a sparse vector, zeros included."""
    places = F.when(vector["size"] > 0, F.sequence(F.lit(0), vector["size"] - 1)).otherwise(F.array().cast("array<int>"))
    filled = lambda m: F.transform(places, lambda i: F.coalesce(F.element_at(m, i), F.lit(0.0)))
    return let(F.map_from_arrays(vector["indices"], vector["values"]), filled)


def cyclic(value: Column, cycle: int) -> list[Column]:
    angle = F.lit(2 * math.pi) * value.cast("double") / F.lit(float(cycle))
    return [F.sin(angle), F.cos(angle)]


@dataclass
class UserEncoder:
    """Fit on a user and a context table; ``transform`` gives one vector per row.

    Order: min-max columns, z-score columns, one-hot blocks, pass-through columns, hour and weekday cycles. Categories are
    looked up in (value, index) tables, so a block may be of any size.
    """

    minmax: Sequence[str]
    zscore: Sequence[str]
    categorical: Sequence[str]
    passthrough: Sequence[str]
    hour: str = "current_hour"
    weekday: str = "current_day_of_week"
    stats: dict = field(default_factory=dict)
    indexes: dict = field(default_factory=dict)
    sizes: dict = field(default_factory=dict)

    def fit(self, users: DataFrame, contexts: DataFrame) -> UserEncoder:
        aggs = [f(c).cast("double").alias(f"{n}_{c}") for c in self.minmax for n, f in (("min", F.min), ("max", F.max))]
        aggs += [f(c).cast("double").alias(f"{n}_{c}") for c in self.zscore for n, f in (("avg", F.avg), ("std", F.stddev_pop))]
        self.stats = users.agg(*aggs).first().asDict()
        self.indexes = {c: category_index(contexts, c) for c in self.categorical}
        self.sizes = {c: index.count() for c, index in self.indexes.items()}
        return self

    def transform(self, rows: DataFrame, out: str = "vector", as_sparse: bool = False) -> DataFrame:
        """``out`` is an array of all places, or with ``as_sparse`` a sparse vector of the places that may not be zero."""
        if not self.stats:
            raise RuntimeError("fit the encoder before transform")
        head = []
        for c in self.minmax:
            low, high = self.stats[f"min_{c}"], self.stats[f"max_{c}"]
            head.append((F.col(c) - F.lit(low)) / F.lit(high - low) if high > low else F.lit(0.0))
        for c in self.zscore:
            std = self.stats[f"std_{c}"] or 1.0
            head.append((F.col(c) - F.lit(self.stats[f"avg_{c}"])) / F.lit(std))
        staged, hot, at = rows, [], len(head)
        for i, c in enumerate(self.categorical):
            staged = with_index(staged, c, self.indexes[c], f"__i{i}")
            hot.append(F.col(f"__i{i}") + at)
            at += self.sizes[c]
        tail = [F.col(c).cast("double") for c in self.passthrough] + cyclic(F.col(self.hour), 24) + cyclic(F.col(self.weekday), 7)
        places = F.concat(F.array(*[F.lit(i) for i in range(len(head))]).cast("array<int>"), F.array_compact(F.array(*hot).cast("array<int>")), F.array(*[F.lit(at + i) for i in range(len(tail))]))
        ones = F.transform(F.array_compact(F.array(*hot).cast("array<int>")), lambda i: F.lit(1.0))
        values = F.concat(F.array(*head).cast("array<double>"), ones, F.array(*tail).cast("array<double>"))
        vector = staged.withColumn(out, sparse(at + len(tail), places, values)).drop(*[f"__i{i}" for i in range(len(hot))])
        return vector if as_sparse else vector.withColumn(out, dense(F.col(out)))


def query_features(df: DataFrame, text: str) -> DataFrame:
    words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    return df.withColumns({
        "word_count": F.size(words),
        "has_number": F.col(text).rlike(r"\d").cast("int"),
        "has_financial_keyword": (F.col(text).contains("save") | F.col(text).contains("loan")).cast("int"),
    })


def month_number(month: Column, legacy: bool = False) -> Column:
    """Sortable month: year and month when both are given, else the last digit run, else 0."""
    digits = F.coalesce(last_digits(month), F.lit(0).cast("long"))
    return digits if legacy else F.coalesce(year_month(month), digits)


def monthly_history(rows: DataFrame, users: DataFrame, features: Sequence[str], months: int = 9, legacy_month: bool = False) -> DataFrame:
    """Last ``months`` rows per known user, oldest first, right-aligned after zero rows, with the real length."""
    known = rows.join(users.select("user_id"), "user_id", "left_semi")
    value = F.array(*[F.coalesce(F.col(f).try_cast("double"), F.lit(0.0)) for f in features])
    staged = known.select("user_id", month_number(F.col("month").cast("string"), legacy_month).alias("m"), value.alias("v"))
    newest = Window.partitionBy("user_id").orderBy(F.col("m").desc(), F.col("v").desc())
    kept = staged.withColumn("r", F.row_number().over(newest)).where(F.col("r") <= months)
    packed = kept.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("r")).alias("o"), "v"))).alias("l"))
    zero = F.array_repeat(F.lit(0.0), len(features))
    rows_of = F.coalesce(F.transform("l", lambda s: s["v"]), F.array().cast("array<array<double>>"))
    return users.select("user_id").join(packed, "user_id", "left").select(
        "user_id",
        F.concat(F.array_repeat(zero, F.lit(months) - F.size(rows_of)), rows_of).alias("history"),
        F.size(rows_of).alias("length"),
    )


def prefix_windows(sequences: DataFrame, length: int = 8) -> DataFrame:
    """(user_id, seq) to rows (user_id, step, input, target): months before ``step`` padded at the end, and month ``step``."""
    used = sequences.withColumn("seq", F.slice("seq", 1, length)).where(F.size("seq") >= 2)
    steps = used.select("user_id", "seq", F.explode(F.sequence(F.lit(1), F.size("seq") - 1)).alias("step"))
    zero = F.transform(F.element_at("seq", 1), lambda x: F.lit(0.0).cast("double"))
    return steps.select(
        "user_id",
        "step",
        F.concat(F.slice("seq", F.lit(1), F.col("step")), F.array_repeat(zero, F.lit(length - 1) - F.col("step"))).alias("input"),
        F.element_at("seq", F.col("step") + 1).alias("target"),
    )


def key_index(df: DataFrame, col: str, coarse: Column) -> DataFrame:
    """Ids 0..n-1 in key order; ``coarse`` must not decrease along the key."""
    keys = df.select(col).where(F.col(col).isNotNull()).distinct()
    numbered = skew.ordinal(keys, [], [F.col(col)], coarse, "id")
    return numbered.withColumn("id", F.col("id") - 1)
