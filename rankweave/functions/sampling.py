"""Repeatable random order: md5 of a seed and a key, the same on every engine and rerun."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_key(seed: int | str, *cols: Column | str) -> Column:
    parts = [c if isinstance(c, Column) else F.col(c) for c in cols]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def md5_long(seed: int | str, *cols: Column | str) -> Column:
    """The first 15 hex digits as a non-negative bigint."""
    return F.conv(F.substring(md5_key(seed, *cols), 1, 15), 16, 10).cast("long")


def bucket(seed: int | str, buckets: int, *cols: Column | str) -> Column:
    return F.pmod(md5_long(seed, *cols), F.lit(buckets))
