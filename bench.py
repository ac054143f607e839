"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

NAMES = ["hybrid_search", "bm25_stats", "bm25_topk", "vector_topk", "chunk_fixed", "chunk_recursive", "chunk_semantic", "upsert_new_chunks", "memory_window", "session_stats", "tool_summary", "log_latest_snapshot", "cache_lookup", "ext_join_large", "ext_asof"]


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "4")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "4g"))
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from skarn.plans import QUERIES

    took = {}
    for name in NAMES:
        best = float("inf")
        for _ in range(2):  # the first run also compiles code
            start = time.perf_counter()
            QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": d.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
