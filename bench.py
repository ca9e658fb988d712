"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import QUERIES  # noqa: E402

HEADLINE = (
    "filter_between", "filter_any", "filtered_aggregate", "group_aggregate2", "monthly_totals",
    "count_distinct", "compare_months", "change_breakdown", "top_groups", "top_rows_highest",
    "rank_groups", "winner_monthly", "numeric_statistics", "outlier_profile", "top_values",
    "profile_lineitem", "dataset_summary", "correlation_matrix", "time_aggregation", "histogram",
    "box_stats", "line_data", "column_roles", "dq_issues_clean", "dq_issues", "duplicate_rows",
    "category_variants", "resample_many", "forecast_many", "forecast_many_series",
    "mask_pii_documents", "pii_counts", "extract_numbers", "overclaim_flags_documents",
    "ground_claims", "run_sql_join_window", "session_admission", "window_usage", "insights", "report_tables",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "16g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # start the engine before timing anything
    QUERIES["row_count"](spark, folder).collect()
    times = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).replace("sf", ""),
    }))


if __name__ == "__main__":
    main()
