"""Headline queries over the benchmark tables; prints one JSON line.

BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS choose the tables, the local cores and the
number of timed runs per query (the median counts, after one warm-up query);
BENCH_WORK_DIR is the folder for intermediate tables.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from spanloom.plans.queries import REGISTRY  # noqa: E402

HEADLINE = [
    "red_by_service",
    "trace_summary",
    "trace_summary_attr",
    "trace_search",
    "span_dedupe",
    "service_edges",
    "trace_tree_order",
    "trace_critical_path",
    "trace_ancestors",
    "trace_geometry",
    "log_search",
    "log_text_filter",
    "log_span_correlation",
    "metric_rollup_numbers",
    "metric_rollup_hist",
    "metric_series",
    "metric_facet_gauge",
    "metric_facet_rate",
    "metric_histogram",
    "metric_hist_facet",
    "metric_catalog",
    "series_labels",
    "alert_eval",
    "alert_backtest",
    "alert_events_feed",
    "otlp_metrics",
    "otlp_traces",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.checkpoint.dir", os.environ.get("BENCH_WORK_DIR") or tempfile.mkdtemp(prefix="bench-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    REGISTRY["service_nodes"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
                "cpus": cpus,
                "runs": runs,
            }
        )
    )


if __name__ == "__main__":
    main()
