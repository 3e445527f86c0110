"""The numbered queries: each applies one operator to its whole tables and derives the agreed columns."""

from __future__ import annotations

import importlib

from pyspark.sql import functions as F

from rankweave.catalog.base import table
from rankweave.llm import base, line_dedup, mixing, sharding, token_counts
from rankweave.llm.base import query
from rankweave.session import cut_lineage

LINE_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)),
keyed AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
frequent AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (f.key IS NOT NULL AND k.doc_id <> f.last) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY i) FILTER (f.key IS NULL OR k.doc_id = f.last), '')) AS kept_sha256
FROM keyed k LEFT JOIN frequent f ON f.key = k.key GROUP BY k.doc_id
"""


@query("op2_line_dedup", LINE_SQL)
def op2(spark, sf_dir):
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


@query("op3_shard")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sharding.shard_by_size(docs.withColumn("text_crc32", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))), "text", "doc_id")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op5_token_counts")
def op5(spark, sf_dir):
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op10_mix_sources")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sized = cut_lineage(docs.select("doc_id", "source", F.xxhash64("text").alias("__text"), mixing.word_size(F.col("text")).alias("words")))
    mixed = mixing.mix_sources(sized, F.col("source"), F.col("words"), [F.col("doc_id"), F.col("__text")])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


for _module in ("decontaminate", "near_dedup", "lm_score", "quality", "license", "classifier", "runs", "tournament", "packing"):
    importlib.import_module(f"rankweave.llm.queries_{_module}")

LLM_QUERIES, LLM_ORACLE = base.LLM_QUERIES, base.LLM_ORACLE
