"""The corpus pipeline: documents through five training-data operators, each stage on all that the one before kept.

quality: documents that the rules reject go. near_dedup: one document of each near-duplicate group stays
(shingles of five words, similarity 0.8). decontaminate: documents that hold a window of a benchmark item go. mix: each
document as often as the mix to target weights takes it. shard: every row with its size, its shard and its slot there;
equal texts share a shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm import decontaminate, mixing, near_dedup, quality_rules, sharding
from rankweave.session import configure, cut_lineage

#: words of a shingle in the near_dedup stage; two are op6's contract only
SHINGLE = 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(docs).where("kept").select(*docs.columns)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.clean(docs, near_dedup.near_duplicates(docs, size=SHINGLE))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean(docs, decontaminate.find_contamination(docs, items))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(docs, F.col("source"), mixing.word_size(F.col("text")), [F.col("doc_id"), F.xxhash64("text")])
    return mixing.repeated(mixed, docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_by_size(docs, "text", "doc_id")


STAGES = [("quality", quality), ("near_dedup", dedup), ("decontaminate", decontaminated), ("mix", mix), ("shard", shard)]
ORACLE_SQL = None  # robust estimates and sketches have no SQL form; tests/llm compares every stage with a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
