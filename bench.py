"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from linkloom.plans import catalogue

NAMES = ["link_exact_words", "link_one_way_words", "fuzzy_trigram", "decide_words", "link_by_language", "ner_merge", "span_audit", "coref_single", "coref_groups", "rerank_blend", "eval_breakdown", "eval_sets", "exact_duplicates", "trace_replay", "vector_topk"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    catalogue.QUERIES["kb_alias_index"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the executors' threads and compiles code
    for name in NAMES:
        start = time.time()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf_dir.rstrip("/").rpartition("sf")[2] or 0)}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
