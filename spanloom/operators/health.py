"""Figures about the telemetry tables themselves, as metric points."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.attributes import canonical_json, series_key
from spanloom.functions.times import instant


def table_figures(
    spans: DataFrame, logs: DataFrame, points: DataFrame, rollups: DataFrame, now: datetime
) -> DataFrame:
    """Rows per table, age of the oldest raw point, lag of the newest rollup bucket.

    Ages of empty tables are left out, not reported as zero.
    """
    at_now = F.unix_micros(instant(now))

    def age(time):
        return (at_now - F.unix_micros(time)) / 1e6

    def rows_of(df: DataFrame, table: str) -> DataFrame:
        return df.agg(F.count("*").cast("double").alias("value")).select(
            F.lit("table.rows").alias("name"), F.lit(table).alias("table"), "value"
        )

    parts = [rows_of(df, t) for t, df in (("spans", spans), ("logs", logs))]
    parts.append(rows_of(points, "metrics"))
    parts.append(rows_of(rollups, "metric_series_rollups"))
    parts.append(
        points.agg(age(F.min("time")).alias("value")).select(
            F.lit("retention.oldest_raw_metric_age_seconds").alias("name"), F.lit("metrics").alias("table"), "value"
        )
    )
    parts.append(
        rollups.agg(age(F.max("bucket")).alias("value")).select(
            F.lit("rollup.lag_seconds").alias("name"), F.lit("metric_series_rollups").alias("table"), "value"
        )
    )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where(F.col("value").isNotNull())


def ingest_counters(valid: DataFrame, rejected: DataFrame, name: str) -> DataFrame:
    """Ingested rows, and dropped rows by reason, of one batch."""
    stored = valid.agg(F.count("*").cast("double").alias("value")).select(
        F.lit(f"ingest.{name}_total").alias("name"), F.lit(None).cast("string").alias("reason"), "value"
    )
    dropped = rejected.groupBy("reason").agg(F.count("*").cast("double").alias("value"))
    return stored.unionByName(dropped.select(F.lit("ingest.dropped_total").alias("name"), "reason", "value"))


def as_points(figures: DataFrame, label: str, now: datetime, service: str, counter: bool = False) -> DataFrame:
    """Figures as raw metric points, ready for the rollup fold."""
    value = F.col(label)
    quoted = F.concat(F.lit('"'), value, F.lit('"'))
    attributes = F.when(value.isNotNull(), F.create_map(F.lit(label), quoted)).otherwise(
        F.create_map().cast("map<string,string>")
    )
    rows = figures.select(
        instant(now).alias("time"),
        F.lit(service).alias("service"),
        "name",
        F.lit("sum" if counter else "gauge").alias("kind"),
        "value",
        F.lit(None).cast("bigint").alias("count"),
        F.lit("1").alias("unit"),
        F.lit(True if counter else None).cast("boolean").alias("is_monotonic"),
        F.lit(None).cast("array<double>").alias("bucket_bounds"),
        F.lit(None).cast("array<bigint>").alias("bucket_counts"),
        F.lit(None).cast("string").alias("exemplar_trace_id"),
        F.lit(None).cast("string").alias("exemplar_span_id"),
        attributes.alias("attributes"),
    )
    rows = rows.withColumn("attrs_json", canonical_json(F.col("attributes")))
    return rows.withColumn("series_key", series_key(F.col("service"), F.col("attrs_json")))
