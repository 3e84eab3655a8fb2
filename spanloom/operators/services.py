"""Per-service figures and the dependency graph."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom import params
from spanloom.functions.predicates import is_error
from spanloom.functions.times import in_range
from spanloom.operators.scaling import exact_percentiles

LATENCY = {"p50_ms": 0.50, "p95_ms": 0.95, "p99_ms": 0.99}


def _window(spans: DataFrame, now, start, end, max_hours) -> DataFrame:
    rows = in_range(spans, "start_time", params.list_floor(now, start, max_hours), end)
    return rows.where(F.col("service").isNotNull())


def red_by_service(
    spans: DataFrame,
    now: datetime,
    *,
    start: datetime | None = None,
    end: datetime | None = None,
    max_hours: int | None = None,
    approx: bool = False,
) -> DataFrame:
    """Span count, errors, error rate and duration percentiles per service.

    ``approx=True`` reads the percentiles from one mergeable sketch instead of the
    exact two-pass search.
    """
    rows = _window(spans, now, start, end, max_hours)
    failed = is_error(F.col("status_code"))
    if approx:
        out = rows.groupBy("service").agg(
            F.count("*").alias("spans"),
            F.count_if(failed).alias("errors"),
            *[F.percentile_approx("duration_ms", q, 10_000).alias(n) for n, q in LATENCY.items()],
        )
    else:
        totals = {"spans": F.lit(1), "errors": F.when(failed, 1).otherwise(0)}
        out = exact_percentiles(rows, ["service"], "duration_ms", LATENCY, totals)
    return out.withColumn("error_rate", F.try_divide(F.col("errors").cast("double"), F.col("spans"))).select(
        "service", "spans", "errors", "error_rate", *LATENCY
    )


def ranked_red(spans: DataFrame, now: datetime, **options) -> DataFrame:
    return red_by_service(spans, now, **options).orderBy(F.desc("spans"), "service")


def service_list(
    spans: DataFrame,
    now: datetime,
    *,
    start: datetime | None = None,
    end: datetime | None = None,
    max_hours: int | None = None,
) -> DataFrame:
    """Services seen in a window, by name."""
    return _window(spans, now, start, end, max_hours).select("service").distinct().orderBy("service")


def _recent(spans: DataFrame, now: datetime, hours: float, start: datetime | None) -> DataFrame:
    """Spans that began after ``start``, else in the last ``hours``."""
    return in_range(spans, "start_time", now - timedelta(hours=hours) if start is None else start, strict=True)


def service_nodes(
    spans: DataFrame, now: datetime, hours: float = params.SERVICE_MAP_HOURS, start: datetime | None = None
) -> DataFrame:
    recent = _recent(spans, now, hours, start)
    return recent.where(F.col("service").isNotNull()).select("service").distinct().orderBy("service")


def service_edges(
    spans: DataFrame, now: datetime, hours: float = params.SERVICE_MAP_HOURS, start: datetime | None = None
) -> DataFrame:
    """Calls between different services: recent child spans against parents of any age.

    Children are counted per (trace, parent, service) before the join, so a parent with
    very many children costs one row per service and not one per call.
    """
    recent = _recent(spans, now, hours, start)
    calls = (
        recent.where(F.col("service").isNotNull() & F.col("parent_span_id").isNotNull())
        .groupBy("trace_id", "parent_span_id", F.col("service").alias("target"))
        .agg(F.count("*").alias("calls"))
    )
    parents = spans.where(F.col("service").isNotNull()).select(
        "trace_id", F.col("span_id").alias("parent_span_id"), F.col("service").alias("source")
    )
    return (
        calls.join(parents, ["trace_id", "parent_span_id"])
        .where(~F.col("source").eqNullSafe(F.col("target")))
        .groupBy("source", "target")
        .agg(F.sum("calls").alias("calls"))
        .orderBy(F.desc("calls"), "source", "target")
    )
