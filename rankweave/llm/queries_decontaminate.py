"""op1: benchmark decontamination."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankweave.catalog.base import table
from rankweave.llm import decontaminate
from rankweave.llm.base import query


@query("op1_decontaminate")
def op1(spark, sf_dir):
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.concat_ws(",", "items"), "UTF-8"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
