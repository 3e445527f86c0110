"""op4: language-model scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankweave.catalog.base import table
from rankweave.llm import lm_score
from rankweave.llm.base import query


@query("op4_lm_score")
def op4(spark, sf_dir):
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return lm_score.score_texts(table(spark, sf_dir, "documents"), held_out).withColumnRenamed("id", "doc_id")
