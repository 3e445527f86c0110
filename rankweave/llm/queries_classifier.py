"""op9: quality classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankweave.catalog.base import table
from rankweave.llm import quality_classifier
from rankweave.llm.base import query


@query("op9_quality_classifier")
def op9(spark, sf_dir):
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    out = quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out)
    return out.withColumnRenamed("id", "doc_id")
