"""Readers: JSON arrays, tolerant JSON Lines, wide CSV, Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Files that each hold one JSON array of records; a schema is required, nothing is inferred.

    A file is parsed by one task, so large inputs should come as many files or as JSON Lines.
    """
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON Lines; lines that do not parse are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_wide_csv(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """CSV with a header; every column but the keys is a number, with 0.0 for blank or other text.

    Rows with a blank key are dropped.
    """
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    require_columns(raw, keys)
    features = [c for c in raw.columns if c not in keys]
    if not features:
        raise ValueError("the file has no feature columns")
    kept = raw
    for k in keys:
        kept = kept.where(F.length(F.trim(F.col(f"`{k}`"))) > 0)
    return kept.select(*[F.trim(F.col(f"`{k}`")).alias(k) for k in keys], *[F.coalesce(F.trim(F.col(f"`{c}`")).try_cast("double"), F.lit(0.0)).alias(c) for c in features])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_parquet_glob(spark: SparkSession, pattern: str) -> DataFrame:
    """All files of a glob as one table; no match is an error (raised by Spark's reader)."""
    return spark.read.parquet(pattern)


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}; found {df.columns}")
    return df
