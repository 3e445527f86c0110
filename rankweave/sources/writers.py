"""Writers: JSON Lines, Parquet, sharded Parquet, resumable append, metric rows, taxonomies."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARD_ROWS = 250_000  # fixed value: records per file


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object per line, UTF-8, explicit nulls kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_sharded_parquet(df: DataFrame, path: str, max_records: int = SHARD_ROWS, split: str = "split", mode: str = "errorifexists") -> None:
    """At most ``max_records`` rows per file, one folder per split."""
    df.write.mode(mode).option("maxRecordsPerFile", max_records).partitionBy(split).parquet(path)


def append_resume(tasks: DataFrame, path: str, keys: Sequence[str], work: Callable[[DataFrame], DataFrame]) -> None:
    """Run ``work`` on the tasks whose keys are not in the output yet, and append its rows.

    The anti join stands before ``work``, so a task that was done is never computed again.
    """
    try:
        done = tasks.sparkSession.read.parquet(path).select(*keys).distinct()
        tasks = tasks.join(done, list(keys), "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    work(tasks).write.mode("append").parquet(path)


def append_metrics(spark: SparkSession, path: str, values: Mapping[str, float], epoch: int, step: int) -> None:
    """Add one run's metric values as rows (epoch, step, metric, value)."""
    rows = [(epoch, step, name, float(v)) for name, v in sorted(values.items())]
    spark.createDataFrame(rows, "epoch int, step int, metric string, value double").coalesce(1).write.mode("append").parquet(path)


def save_taxonomy(nodes: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Nodes without their embedding."""
    write_jsonl(nodes.drop("embedding"), path, mode)


def load_taxonomy(spark: SparkSession, path: str, schema: str = "id string, level int, name string, description string") -> DataFrame:
    return spark.read.schema(schema).json(path).withColumn("embedding", F.lit(None).cast("array<double>"))
