"""op11: periodic runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.catalog.base import table
from rankweave.llm import run_detection
from rankweave.llm.base import query, word_list


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document by the hash of its id repeats a stretch of its own words from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    listed = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, word_list(F.col("text"))).alias("w"))
    n = F.nullif(F.size("w").cast("long"), F.lit(0).cast("long"))
    placed = listed.withColumns({"n": n, "a": F.pmod(F.col("g"), n)})
    sized = placed.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    left, part = F.col("n") - F.col("a"), F.slice("w", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    whole = F.flatten(F.array_repeat(part, F.floor(left / F.col("p")).cast("int")))
    words = F.concat(F.slice("w", 1, F.col("a").cast("int")), whole, F.slice("w", (F.col("a") + 1).cast("int"), (left % F.col("p")).cast("int")))
    return sized.select("doc_id", F.when(F.col("n") > 0, F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


def sha(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


@query("op11_periodic_runs")
def op11(spark, sf_dir):
    found = run_detection.detect_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"), sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))
    length = -F.col("best.l")
    return best.select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
