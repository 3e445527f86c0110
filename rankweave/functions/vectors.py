"""Vector arithmetic on array columns (JVM side, no Python)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row.

    Inside a lambda every mention of an outer expression is evaluated again for each element;
    binding it to a lambda variable first avoids that.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def l2_normalize(v: Column) -> Column:
    """Unit vector; null for a zero vector."""
    return let(norm(v), lambda length: F.when(length > 0, F.transform(v, lambda x: x.cast("double") / length)))


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))))


def vector_mean(v: Column) -> Column:
    return _sum(v) / F.size(v)


def argmax(v: Column) -> Column:
    """1-based position of the largest element, the first on ties."""
    return F.array_position(v, F.array_max(v))


def add_scaled(a: Column, b: Column, weight: float) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + F.lit(weight) * y.cast("double"))
