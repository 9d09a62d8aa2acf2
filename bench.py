"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "units_from_events", "unit_geometry", "simple_box_label", "mbb_vs_exact", "sequenced_2", "sequenced_3", "sequenced_4", "sequenced_3_by_joins", "activity_join", "activity_runs", "split_long_units",
    "route_accumulate", "id_remap", "str_plain", "str_lf", "hilbert_leaves", "leaf_summary", "internal_summary", "interval_set_build", "hilbert_index",
    "selectivity_report", "shared_ids", "pruned_equals_full", "pruned_interval_ids", "pruned_bloom_ids", "levelwise_leaves", "tree_stats", "query_set_averages", "index_build",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from strail.plans.catalogue import QUERIES

    seconds: dict[str, float] = {}
    for name in HEADLINE:
        best = None
        for _ in range(2):  # the first run compiles
            begun = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - begun
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    print(json.dumps({"metric": "headline queries, best of two", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
