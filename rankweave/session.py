"""Session settings the jobs rely on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: stage folders written by this driver and not yet removed
_stages: list[str] = []


def configure(spark: SparkSession) -> SparkSession:
    """Pin the time zone and turn on the adaptive rules; runtime settings only."""
    for key, value in (
        ("spark.sql.session.timeZone", "UTC"),
        ("spark.sql.adaptive.enabled", "true"),
        ("spark.sql.adaptive.skewJoin.enabled", "true"),
        # split a skewed join side even if that costs one more exchange afterwards
        ("spark.sql.adaptive.forceOptimizeSkewedJoin", "true"),
        # what a Python worker gets at once, however many rows of its task there are
        ("spark.sql.execution.arrow.maxBytesPerBatch", "16777216b"),
    ):
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; a scratch folder only on a local master."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="rankweave-checkpoint-"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the session's checkpoint folder, which every executor can reach."""
    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/rankweave-{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the frame to the shared folder and read it back.

    Like a reliable checkpoint it survives lost executors and ends the lineage. As a Parquet table it
    also keeps column pruning, and its real size is known to the planner, so a small result is
    broadcast by measured size and a large one is not.
    """
    path = shared_folder(df.sparkSession, "stage")
    _stages.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def job_stages(spark: SparkSession) -> Iterator[None]:
    """Remove the stages that the work inside has stored; write its results before leaving.

    ``with job_stages(spark): job(spark).write.parquet(path)``
    """
    kept = len(_stages)
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _stages[kept:]:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)
        del _stages[kept:]
