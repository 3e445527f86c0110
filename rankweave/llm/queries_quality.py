"""op7: quality rules."""

from __future__ import annotations

from rankweave.catalog.base import table
from rankweave.llm import quality_rules
from rankweave.llm.base import query


@query("op7_quality_rules")
def op7(spark, sf_dir):
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "distance")
