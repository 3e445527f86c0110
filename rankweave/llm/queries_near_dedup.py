"""op6: near-duplicate groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankweave.catalog.base import table
from rankweave.llm import near_dedup
from rankweave.llm.base import query


@query("op6_near_dedup")
def op6(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=2).withColumnRenamed("id", "doc_id").select("doc_id", F.col("n_shingles"), "component_id", "kept")
