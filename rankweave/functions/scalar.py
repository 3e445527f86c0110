"""Scalar helpers over rows, strings and times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankweave.functions.vectors import let


def first_present(record: Column, names: Sequence[str], default: Column | None = None) -> Column:
    """Value of the first alias that is present in a map, even when that value is null."""
    out = F.lit(None).cast("string") if default is None else default
    for name in reversed(names):
        out = F.when(F.map_contains_key(record, F.lit(name)), F.element_at(record, F.lit(name))).otherwise(out)
    return out


def epoch_to_iso(number: Column) -> Column:
    """Epoch seconds, or milliseconds from 1e11 on, as UTC ISO-8601; null outside the years 1 to 9999."""
    seconds = F.when(number >= 1e11, number / 1e3).otherwise(number)
    known = (seconds >= -62135596800) & (seconds < 253402300800)
    return timestamp_to_iso(F.timestamp_micros(F.round(F.when(known, number) * F.when(number >= 1e11, 1e3).otherwise(1e6)).try_cast("long")))


def timestamp_to_iso(ts: Column) -> Column:
    """Microseconds are written only when there are any."""
    return F.replace(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"), F.lit(".000000"), F.lit(""))


def to_iso(value: Column) -> Column:
    """An epoch number in a string becomes ISO-8601; any other string is kept."""
    return F.coalesce(epoch_to_iso(value.try_cast("double")), value)


def days_between(end: Column, start: Column) -> Column:
    """Fractional days."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(86_400_000_000.0)


def is_title_case(text: Column) -> Column:
    """Every cased run starts with an upper-case letter and goes on in lower case."""
    cased = r"[\p{Lu}\p{Lt}\p{Ll}]"
    upper_inside = r"[\p{Lu}\p{Lt}\p{Ll}][\p{Lu}\p{Lt}]"
    lower_first = r"(^|[^\p{Lu}\p{Lt}\p{Ll}])\p{Ll}"
    return text.rlike(cased) & ~text.rlike(upper_inside) & ~text.rlike(lower_first)


def last_digits(text: Column) -> Column:
    """The last run of digits as a bigint, null without digits."""
    runs = F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1))
    return F.when(F.size(runs) > 0, F.element_at(runs, -1).cast("long"))


def year_month(text: Column) -> Column:
    """``2025-09`` -> 202509, so that months of different years stay in order."""
    return (
        F.regexp_extract(text, r"(\d{4})-(\d{1,2})", 1).try_cast("long") * 100
        + F.regexp_extract(text, r"(\d{4})-(\d{1,2})", 2).try_cast("long")
    )


def lookup(mapping: Column, key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(mapping, key), default)


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def strip_code_fence(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"```(json)?", ""))


def softmax(scores: Column) -> Column:
    """Max-shifted softmax of an array of doubles."""
    def scaled(weights: Column) -> Column:
        total = F.aggregate(weights, F.lit(0.0).cast("double"), lambda a, b: a + b)
        return let(total, lambda t: F.transform(weights, lambda w: w / t))

    return let(scores, lambda v: let(F.array_max(v), lambda top: let(F.transform(v, lambda s: F.exp(s - top)), scaled)))


def log_sigmoid(x: Column) -> Column:
    """Stable on both sides: -(max(-x, 0) + log1p(exp(-|x|)))."""
    return -(F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))))


def smooth_l1(x: Column, y: Column) -> Column:
    gap = F.abs(x - y)
    return F.when(gap < 1, 0.5 * gap * gap).otherwise(gap - 0.5)
