"""Metric reads. Each works for one metric name or, with ``name=None``, for all at once."""

from __future__ import annotations

from datetime import datetime, timedelta
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom import params
from spanloom.functions import attributes as at
from spanloom.functions.times import bucket, in_range, seconds_between
from spanloom.operators.metric_facts import facts_of, newest_meta
from spanloom.operators.scaling import small_side


class Facet(NamedTuple):
    """Per-series points, one row per kept series, one row per metric."""

    points: DataFrame
    series: DataFrame
    summary: DataFrame


def named(df: DataFrame, name: str | None) -> DataFrame:
    return df if name is None else df.where(F.col("name") == name)


def within(df: DataFrame, column: str, window: params.Window) -> DataFrame:
    return in_range(df, column, window.lo, window.hi)


def metric_series(
    rollups: DataFrame,
    now: datetime,
    *,
    name: str | None = None,
    service: str | None = None,
    hours: int | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    max_hours: float | None = None,
    base_secs: float = params.BUCKET_SECS,
) -> DataFrame:
    """Count-weighted mean per output bucket over all series of a metric."""
    window = params.metric_window(now, hours, params.SERIES_HOURS, max_hours, start, end)
    rows = within(named(rollups, name), "bucket", window)
    if service is not None:
        rows = rows.where(F.col("service") == service)
    t = bucket(F.col("bucket"), params.window_bucket_secs(window, base_secs)).alias("t")
    return (
        rows.groupBy("name", t)
        .agg(F.try_divide(F.sum("sum"), F.sum("count")).alias("v"))
        .orderBy("name", "t")
    )


def metric_dims(
    points: DataFrame, now: datetime, *, name: str | None = None, hours: float | None = None
) -> DataFrame:
    """Attribute keys of all points, or of those of the last ``hours``."""
    recent = named(points, name)
    if hours is not None:
        recent = in_range(recent, "time", now - timedelta(hours=hours))
    keys = recent.select("name", F.explode(F.map_keys("attributes")).alias("key")).distinct()
    return keys.orderBy("name", "key")


def grouped_series(
    points: DataFrame,
    now: datetime,
    key: str,
    *,
    name: str | None = None,
    hours: float | None = None,
    start: datetime | None = None,
    width_secs: float = params.BUCKET_SECS,
) -> DataFrame:
    """Mean raw value per (attribute value, bucket), for points that have the key."""
    if start is None:
        start = now - timedelta(hours=params.FACET_HOURS if hours is None else hours)
    rows = in_range(named(points, name), "time", start).where(F.map_contains_key("attributes", key))
    label = at.fragment_text(F.col("attributes")[key]).alias("label")
    return (
        rows.groupBy("name", label, bucket(F.col("time"), width_secs).alias("t"))
        .agg(F.avg("value").alias("v"))
        .orderBy("name", F.col("label").asc_nulls_last(), "t")
    )


def metric_exemplars(
    points: DataFrame,
    now: datetime,
    *,
    name: str | None = None,
    service: str | None = None,
    hours: int | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Points that carry a trace exemplar, oldest first; the first ``limit`` if given."""
    window = params.metric_window(now, hours, params.FACET_HOURS, None, start, end)
    rows = within(named(points, name), "time", window).where(F.col("exemplar_trace_id").isNotNull())
    if service is not None:
        rows = rows.where(F.col("service") == service)
    return params.top(
        rows.select(
            "name",
            F.col("time").alias("t"),
            F.col("value").alias("v"),
            F.col("exemplar_trace_id").alias("trace_id"),
            F.col("exemplar_span_id").alias("span_id"),
        ).orderBy("t", "trace_id", "span_id", "name"),
        limit,
    )


def metric_meta(points: DataFrame, rollups: DataFrame, name: str | None = None) -> DataFrame:
    """Newest kind, monotonicity and unit per metric, from all raw points or rollups.

    It looks through whole tables; reads take the kept facts instead.
    """
    return newest_meta(facts_of(named(points, name), named(rollups, name)))


def rank_series(points: DataFrame, cap: int | None) -> tuple[DataFrame, DataFrame]:
    """Series with the most points first: all or the first ``cap``, and totals per metric."""
    sizes = points.groupBy("name", "attrs_json").agg(F.count("*").alias("n_points"))
    order = W.partitionBy("name").orderBy(F.desc("n_points"), "attrs_json")
    kept = sizes.withColumn("series_rank", F.row_number().over(order))
    totals = sizes.groupBy("name").agg(F.count("*").alias("series_total"))
    left = F.lit(0).cast("bigint")
    if cap is not None:
        kept, left = kept.where(F.col("series_rank") <= cap), F.greatest(F.col("series_total") - cap, left)
    return kept, totals.withColumn("truncated", left)


def metric_facet(
    facts: DataFrame,
    rollups: DataFrame,
    now: datetime,
    *,
    name: str | None = None,
    hours: int | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    cap: int | None = None,
    base_secs: float = params.BUCKET_SECS,
    max_hours: float | None = None,
) -> Facet:
    """One line per attribute set: the mean level, or the rate of a monotonic sum.

    ``facts`` is the kept table of ``metric_facts``.
    A series has at most about a thousand output buckets, so the rate window per
    series is small whatever the input.
    """
    window = params.metric_window(now, hours, params.FACET_HOURS, max_hours, start, end)
    t = bucket(F.col("bucket"), params.window_bucket_secs(window, base_secs)).alias("t")
    levels = (
        within(named(rollups, name), "bucket", window)
        .groupBy("name", "attrs_json", t)
        .agg(F.try_divide(F.sum("sum"), F.sum("count")).alias("mean"), F.max("max").alias("level"))
    )
    meta = newest_meta(facts, name).withColumn(
        "rated", F.coalesce((F.col("kind") == "sum") & F.col("is_monotonic"), F.lit(False))
    )
    meta = small_side(meta)

    earlier = W.partitionBy("name", "attrs_json").orderBy("t").rowsBetween(W.unboundedPreceding, -1)
    known_t = F.when(F.col("level").isNotNull(), F.col("t"))
    stepped = levels.withColumns(
        {
            "_level": F.last("level", ignorenulls=True).over(earlier),
            "_t": F.last(known_t, ignorenulls=True).over(earlier),
        }
    )
    return _facet(stepped, meta, cap)


def _facet(stepped: DataFrame, meta: DataFrame, cap: int | None) -> Facet:
    dt = seconds_between(F.col("t"), F.col("_t"))
    rising = (dt > 0) & (F.col("level") >= F.col("_level"))
    rate = F.when(
        F.col("_t").isNotNull() & F.col("level").isNotNull(),
        F.when(rising, F.try_divide(F.col("level") - F.col("_level"), dt)).otherwise(F.lit(0.0)),
    )
    kept, totals = rank_series(stepped, cap)
    lines = (
        stepped.join(kept, ["name", "attrs_json"])
        .join(meta.select("name", "rated"), "name", "left")
        .select(
            "name",
            "attrs_json",
            "series_rank",
            "t",
            F.when(F.col("rated"), rate).otherwise(F.col("mean")).alias("v"),
        )
    )
    summary = totals.join(meta, "name", "left").select(
        "name", "kind", "rated", "unit", "series_total", "truncated"
    )
    return Facet(lines, kept, summary)


def latest_values(lines: DataFrame, columns: list[str]) -> DataFrame:
    """Newest non-NULL value of each column per series."""
    picks = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("t"))).alias(c) for c in columns]
    return lines.groupBy("name", "attrs_json").agg(*picks)
