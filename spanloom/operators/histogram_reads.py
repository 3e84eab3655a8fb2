"""Histogram reads over rollups: distribution over time, percentiles per series, heat map."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom import params
from spanloom.functions.histograms import QUANTILES, with_quantiles
from spanloom.functions.times import bucket
from spanloom.operators.metrics import Facet, named, rank_series, within
from spanloom.operators.rollups import sum_counts


def _per_series(rollups, now, identity, name, hours, start, end, max_hours, base_secs) -> DataFrame:
    """Counts per (metric, series, output bucket) whose length fits their bounds."""
    window = params.metric_window(now, hours, params.FACET_HOURS, max_hours, start, end)
    rows = within(named(rollups, name), "bucket", window).where(
        (F.col("kind") == "histogram") & F.col("bucket_counts").isNotNull()
    )
    rows = rows.withColumn("t", bucket(F.col("bucket"), params.window_bucket_secs(window, base_secs)))
    folded = sum_counts(
        rows.select("name", identity, "t", "bucket_bounds", "unit", "bucket_counts"),
        ["name", identity, "t"],
        variants=["bucket_bounds", "unit"],
        second_pass=[F.min("bucket_bounds").alias("bucket_bounds"), F.min("unit").alias("unit")],
    )
    return folded.where(F.size("bucket_counts") == F.size("bucket_bounds") + 1)


def histogram_series(
    rollups: DataFrame,
    now: datetime,
    *,
    name: str | None = None,
    hours: int | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    max_hours: float | None = None,
    base_secs: float = params.BUCKET_SECS,
) -> DataFrame:
    """Summed counts over all series per output bucket, with percentiles.

    The earliest series row sets the bounds of a metric; rows with another number of
    buckets do not count. Counts are taken as increments of their own interval.
    """
    rows = _per_series(rollups, now, "series_key", name, hours, start, end, max_hours, base_secs)
    first = rows.groupBy("name").agg(
        F.min_by(F.struct("bucket_bounds", "unit"), F.struct("t", "series_key")).alias("_ref")
    )
    # Both sides are small by now: one row per metric, a thousand buckets per metric.
    reference = first.select("name", "_ref.bucket_bounds", "_ref.unit")
    sized = rows.select("name", "t", "bucket_counts", F.size("bucket_counts").alias("_len"))
    summed = sum_counts(sized, ["name", "t", "_len"])
    matched = summed.join(reference, "name").where(F.col("_len") == F.size("bucket_bounds") + 1)
    return (
        with_quantiles(matched, "bucket_bounds", "bucket_counts")
        .select("name", "t", "unit", "bucket_bounds", "bucket_counts", *QUANTILES)
        .orderBy("name", "t")
    )


def histogram_facet(
    rollups: DataFrame,
    now: datetime,
    *,
    name: str | None = None,
    hours: int | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    cap: int | None = None,
    max_hours: float | None = None,
    base_secs: float = params.BUCKET_SECS,
) -> Facet:
    """Percentiles per (attribute set, output bucket) and each series' newest counts."""
    rows = _per_series(rollups, now, "attrs_json", name, hours, start, end, max_hours, base_secs)
    kept, totals = rank_series(rows, cap)
    lines = with_quantiles(rows.join(kept, ["name", "attrs_json"]), "bucket_bounds", "bucket_counts").select(
        "name", "attrs_json", "series_rank", "t", *QUANTILES
    )
    newest = rows.groupBy("name", "attrs_json").agg(F.max_by("bucket_counts", "t").alias("dist"))
    shared = rows.groupBy("name").agg(
        F.min_by("bucket_bounds", F.struct("t", "attrs_json")).alias("bucket_bounds"),
        F.min_by("unit", F.when(F.col("unit").isNotNull(), F.struct("t", "attrs_json"))).alias("unit"),
    )
    return Facet(lines, kept.join(newest, ["name", "attrs_json"]), totals.join(shared, "name"))


def heatmap(distribution: DataFrame) -> DataFrame:
    """Cell intensity of a distribution over time, log-scaled against the metric's fullest cell."""
    cells = distribution.select("name", "t", F.posexplode("bucket_counts").alias("row", "n"))
    # At most about a thousand output buckets per metric: this window is small.
    fullest = F.greatest(F.max("n").over(W.partitionBy("name")), F.lit(1))
    shade = F.when(F.col("n") > 0, F.ln(F.col("n") + 1.0) / F.ln(fullest + 1.0)).otherwise(F.lit(0.0))
    return cells.withColumn("intensity", shade)


def percentile_lines(distribution: DataFrame) -> DataFrame:
    """p50, p95 and p99 as three series of (label, t, v)."""
    return distribution.unpivot(["name", "t"], list(QUANTILES), "label", "v")
