"""op12: packing by lexical retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankweave.catalog.base import table
from rankweave.llm import retrieval_packing
from rankweave.llm.base import query


@query("op12_retrieval_packing")
def op12(spark, sf_dir):
    import public_tokenizers

    pieces = retrieval_packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
