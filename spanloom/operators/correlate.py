"""From one signal to another: logs of spans, traces around a chart, traces behind exemplars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom import params
from spanloom.functions.times import in_range

KEY = ["trace_id", "span_id"]


def logs_of_spans(spans: DataFrame, logs: DataFrame) -> DataFrame:
    """Log rows beside the span they were written in."""
    return logs.join(
        spans.select(*KEY, F.col("name").alias("span_name"), F.col("service").alias("span_service")), KEY
    )


def log_counts(spans: DataFrame, logs: DataFrame) -> DataFrame:
    """Logs per span; counted before the join, so a chatty span is one row there."""
    counts = logs.where(F.col("trace_id").isNotNull() & F.col("span_id").isNotNull()).groupBy(*KEY).agg(
        F.count("*").alias("logs"), F.count_if(F.coalesce(F.col("severity_number") >= 17, F.lit(False))).alias("errors")
    )
    return spans.select(*KEY, "name", "service").join(counts, KEY)


def exemplar_spans(exemplars: DataFrame, spans: DataFrame) -> DataFrame:
    """Exemplar points with the span behind them."""
    target = spans.select(*KEY, F.col("name").alias("span_name"), "duration_ms", "status_code")
    return exemplars.join(target, KEY, "left")


def spans_in_window(spans: DataFrame, window: params.Window, service: str | None = None) -> DataFrame:
    """Spans started in a chart's window, optionally of the chart's service."""
    rows = in_range(spans, "start_time", window.lo, window.hi)
    return rows if service is None else rows.where(F.col("service") == service)
