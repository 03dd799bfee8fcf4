"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. Each query runs twice, the second counts."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from larkspur.queries import QUERIES

HEADLINE = ["pricing_summary", "filters", "computed_key", "inner_join", "semi_join", "asof_join", "window_join", "filter_by", "running", "moving", "neighbours", "order_statistics", "pivoted", "update_by", "last_of_group", "sorted_top"]


def main() -> None:
    cpus, sf = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf)}))
    spark.stop()


if __name__ == "__main__":
    main()
