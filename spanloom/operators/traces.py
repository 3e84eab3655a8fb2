"""Span and trace reads."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom import params
from spanloom.functions import attributes as at
from spanloom.functions.predicates import is_error
from spanloom.functions.times import in_range, seconds_between


def dedupe_spans(spans: DataFrame, arrival: list[str], stored: DataFrame | None = None) -> DataFrame:
    """First arrived row per (trace_id, span_id), leaving out keys already stored.

    Rank one per key is taken before the shuffle too, so many copies of one key
    shrink to one row per input partition.
    """
    key = ["trace_id", "span_id"]
    first = Window.partitionBy(*key).orderBy(*arrival)
    kept = spans.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")
    return kept if stored is None else kept.join(stored.select(*key), key, "left_anti")


def trace_spans(spans: DataFrame, trace_id: str) -> DataFrame:
    """All spans of one trace, oldest first; no time bound."""
    return spans.where(F.col("trace_id") == trace_id).orderBy("start_time", "span_id")


def summarize_traces(
    spans: DataFrame,
    now: datetime,
    *,
    service: str | None = None,
    name: str | None = None,
    attr: str | None = None,
    errors_only: bool = False,
    min_duration_ms: float | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    max_hours: int | None = None,
) -> DataFrame:
    """One row per trace over the spans that pass the service and time filters.

    Those two filters apply to spans, so counts, root and duration cover only the
    spans that pass. The attribute filter keeps a trace when any of its spans, at any
    time, has the pair; it joins after the grouping, when both sides have one row per
    trace.
    """
    rows = in_range(spans, "start_time", params.list_floor(now, start, max_hours), end)
    if service is not None:
        rows = rows.where(F.col("service") == service)
    traces = rows.groupBy("trace_id").agg(
        F.max("service").alias("service"),
        F.min_by("name", F.struct("start_time", "span_id")).alias("root_name"),
        F.min("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"),
        F.count("*").alias("span_count"),
        F.count_if(is_error(F.col("status_code"))).alias("error_count"),
    )
    traces = traces.withColumn(
        "duration_ms", seconds_between(F.col("end_time"), F.col("start_time")) * 1000.0
    )
    if name is not None:
        traces = traces.where(F.col("root_name").ilike(at.ilike_pattern(name)))
    if errors_only:
        traces = traces.where("error_count > 0")
    if min_duration_ms is not None:
        traces = traces.where(F.col("duration_ms") >= min_duration_ms)
    wanted = at.equals_filter(F.col("attributes"), attr)
    if wanted is not None:
        traces = traces.join(spans.where(wanted).select("trace_id").distinct(), "trace_id", "left_semi")
    return traces.select(
        "trace_id", "service", "root_name", "start_time", "end_time", "duration_ms", "span_count", "error_count"
    )


def search_traces(spans: DataFrame, now: datetime, *, limit: int | None = None, **filters) -> DataFrame:
    """Newest traces first, by the start of the trace."""
    found = summarize_traces(spans, now, **filters)
    return params.top(found.orderBy(F.desc("start_time"), "trace_id"), limit)
