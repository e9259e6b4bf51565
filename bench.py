"""Times of the headline queries; prints one JSON line.

Reads ``BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[BENCH_CPUS]``.  Each query runs once to
warm up, then ``BENCH_RUNS`` times into the noop sink; the median counts.
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from visitprep.plans import registry

HEADLINE = {
    "dedupe_last_by_arrival": "dedupe_last_ordered",
    "duplicate_classification": "dup_groups",
    "duplicate_summary": "dup_by_facility",
    "care_setting_all_fixes": "care_fix_all",
    "facility_review_daily": "review_both_daily_by_type",
    "linkage_long_two_pull": "link_long_two_pull",
    "linkage_collapsed_two_pull": "link_collapsed_two_pull",
    "geography_preserve": "geo_treating_preserve",
    "pipeline_clean": "pipeline_clean",
}


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = registry.queries(), {}
    for name, key in HEADLINE.items():
        taken = []
        for _ in range(runs + 1):
            begun = time.perf_counter()
            queries[key](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - begun)
        times[name] = round(median(taken[1:]), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rstrip("/").rpartition("sf")[2], "cpus": int(cpus), "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
