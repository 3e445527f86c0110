"""Labelling of session files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from rankweave.operators import clicklog as cl


def label_session_files(
    spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str,
    config: cl.LabelConfig = cl.LabelConfig(sample_negatives=False), files_per_batch: int = 100,
) -> StreamingQuery:
    """Read new session files, label them with the batch job and write one folder per micro-batch.

    A replayed batch overwrites its own folder, so every example is written exactly once. Weights
    are normalized per session, so a session must lie in one file.
    """
    sessions = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)

    def write(batch: DataFrame, batch_id: int) -> None:
        labelled = cl.build_dataset(cl.unnest_sessions(batch), config)
        labelled.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return sessions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
