"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "L_flagship_label_report", "L7_mixed_negative_sampling", "L8_build_click_dataset", "U1_multi_window_counts", "U12_monthly_history",
    "T2_build_vocabulary", "T5_bm25_index", "T6_bm25_search", "V2_exact_topk", "V5_similarity_self_join", "V9_rrf_fuse", "V12_adaptive_k",
    "N2_mine_hard_negatives", "N5_passage_to_triplets", "N6_class_triplets", "C2_connected_components", "C5_density_cluster", "E5_entity_metrics",
    "E8_extract_entities", "M4_mean_average_precision", "M8_auc", "M11_ranker_report",
]


def main():
    from pyspark.sql import SparkSession

    from rankweave.catalog import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()  # warm the session
    seconds = {}
    for name in names:
        start = time.perf_counter()
        # a full materialization of every output column, without moving rows to the driver
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
