"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR   folder with the parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_RUNS     runs of each query, of which the median counts (default 3)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "segment_totals", "trim_whitespace", "standardise_capitalisation", "normalise_categories", "find_replace", "clean_html",
    "standardise_dates", "parse_currency", "cast_type", "fill_missing_median", "fill_missing_grouped", "fill_missing_ffill",
    "clip_outliers", "scale_numeric", "bin_numeric", "add_rank", "lag_column", "rolling_stats", "cumulative_sum",
    "group_by", "pivot_table", "histogram", "sql_query", "run_validation", "pattern_validate", "detect_pii", "mask_pii_in_text",
    "profile_dataset", "detect_issues", "health_score", "correlations", "detect_outliers_iqr", "timeseries_anomalies",
    "remove_duplicates", "dedupe_by_key", "remove_fuzzy_duplicates", "compare_datasets", "diff_by_key", "auto_clean",
    "run_pipeline", "extract_dataset_features",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from scrubline import catalog

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("scrubline-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1").config("spark.driver.bindAddress", "127.0.0.1").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in HEADLINE if n in catalog.QUERIES]
    # warm up the JVM and the file cache
    catalog.QUERIES["segment_totals"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        runs = []
        for _ in range(int(os.environ.get("BENCH_RUNS", "3"))):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "total time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
