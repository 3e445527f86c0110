"""The near_dedup stage works on shingles of five words; two are op6's contract only."""

import corpus_pipeline
from tests.llm import plain


def test_stage_links_by_five_words(spark, base):
    at = base.replace("0.001", "0.01")
    words = [f"w{i}" for i in range(100)]
    odd = ["x" if i % 20 == 10 else w for i, w in enumerate(words)]  # 0.82 alike by two words, 0.59 by five
    near = [*words[:99], "end"]
    real = [tuple(r) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()]
    rows = [*real, *[(10**6 + i, " ".join(w)) for i, w in enumerate([words, odd, near])]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = corpus_pipeline.dedup(spark, docs, at)
    kept = sorted(r["doc_id"] for r in out.collect())
    assert kept == sorted(i for i, (_, c) in plain.components(rows, size=5).items() if i == c)
    assert {10**6, 10**6 + 1} <= set(kept) and 10**6 + 2 not in kept
