"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = ["span_normalize", "dedup_first", "dedup_ttl", "late_drop", "tumbling_aligned", "tumbling_anchored", "sliding_zscore", "zscore_anomalies", "detect_full", "iforest_windows", "debounce", "cascade_bfs"]


def main() -> None:
    from tidewatch.plans import catalog

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    fixed = spark.range(20_000_000).selectExpr("xxhash64(id) % 1000 AS k", "id").groupBy("k").agg({"id": "sum"})
    for _ in range(2):  # the same work on any tables: tells a slower machine from slower code
        began = time.time()
        fixed.write.format("noop").mode("overwrite").save()
        calibration = round(time.time() - began, 3)
    for name in HEADLINE:
        query = catalog.QUERIES[name]
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()  # compiles code
        began = time.time()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "calibration": calibration, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
