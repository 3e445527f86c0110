"""Tokenizers and small text expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokenize_alnum(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def tokenize_words(text: Column) -> Column:
    """Lower-case runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))


def tokenize_space(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")


def explode_tokens(df: DataFrame, keys: Sequence[str | Column], tokens: Column, name: str = "term") -> DataFrame:
    """One row per token.

    The outer form is used on purpose: for a plain explode the optimizer adds a filter on the size of
    the array below it, which would run the tokenizer a second and a third time on every text.
    """
    return df.select(*keys, F.explode_outer(tokens).alias(name)).where(F.col(name).isNotNull())
