"""Times the headline graph queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "placed_by_segment", "two_hops", "region_path", "optional_match", "exists_subquery", "not_exists", "call_topk_per_row", "pattern_comprehension",
    "percentiles", "top_k", "union_all", "except_all", "bounded_repetition", "any_shortest",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from tessera.plans.bench_queries import QUERIES

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        best = None
        for _ in range(2):  # cold, then warm; the better counts
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(time.perf_counter() - began, best or 1e9)
        took[name] = round(best, 3)
    spark.stop()
    print(json.dumps({"metric": "graph_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir).removeprefix("sf")}))


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    main()
