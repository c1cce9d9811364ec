"""Times the headline queries, warm, and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from concordance import queries as engine  # noqa: E402

HEADLINE = ("keyed_summary", "keyed_composite_key", "keyed_field_evidence", "aggregate_grouped_measures", "aggregate_measure_classes", "multiset_summary", "reference_check_forbid", "conservation_check", "range_discovery", "record_preflight")
REPEATS = 3


def main() -> None:
    cpus, folder = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(1 + REPEATS):
            begin = time.perf_counter()
            engine.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - begin)
        took[name] = round(median(times[1:]), 3)
    print(json.dumps({"metric": "headline comparisons, median seconds, warm", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
