"""Mergeable rollups per (metric, series, time bucket).

A rollup row is a sum of points, and a point is a rollup row of count one. So one
fold serves the partial of a batch, the merge of partials and the compaction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom import params
from spanloom.functions.times import bucket

KEY = ["name", "series_key", "bucket"]
SERIES = ["attrs_json", "service"]
# Columns that may differ between rows of one key; they ride along as grouping keys
# so that the big aggregation only has fixed-width buffers and stays a hash aggregate.
VARIANTS = ["kind", "unit", "is_monotonic", "bucket_bounds"]


def collected_counts(cells: Column) -> Column:
    """Counts array from (position, count) cells; equal positions add up, no cell gives NULL.

    One fold over the sorted cells: the last position is held open until the next one comes.
    """
    zero = F.lit(0).cast("bigint")
    seed = F.struct(F.array().cast("array<bigint>").alias("done"), F.lit(-1).alias("pos"), zero.alias("sum"))

    def step(acc: Column, x: Column) -> Column:
        count, same = F.coalesce(x["c"], zero), x["pos"] == acc["pos"]
        closed = F.when(same | (acc["pos"] < 0), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["sum"])))
        total = F.when(same, acc["sum"] + count).otherwise(count)
        return F.struct(closed.alias("done"), x["pos"].alias("pos"), total.alias("sum"))

    folded = F.aggregate(F.sort_array(cells), seed, step, lambda acc: F.concat(acc["done"], F.array(acc["sum"])))
    return F.when(F.size(cells) > 0, folded)


def sum_counts(
    df: DataFrame,
    keys: Sequence[str],
    counts: str = "bucket_counts",
    variants: Sequence[str] = (),
    first_pass: Sequence[Column] = (),
    second_pass: Sequence[Column] = (),
) -> DataFrame:
    """Element-wise sum of count arrays per key, positions as rows until the last step.

    ``first_pass`` aggregates run per (keys, variants, position); the column ``_once``
    is true on one position of each input row, for figures that must not be repeated.
    ``second_pass`` aggregates merge those per key.
    """
    cells = df.select("*", F.posexplode_outer(counts).alias("_pos", "_c")).withColumn(
        "_once", F.col("_pos").isNull() | (F.col("_pos") == 0)
    )
    summed = cells.groupBy(*keys, *variants, "_pos").agg(F.sum("_c").alias("_c"), *first_pass)
    cell = F.when(F.col("_pos").isNotNull(), F.struct(F.col("_pos").alias("pos"), F.col("_c").alias("c")))
    folded = summed.groupBy(*keys).agg(F.collect_list(cell).alias("_cells"), *second_pass)
    return folded.withColumn(counts, collected_counts(F.col("_cells"))).drop("_cells")


def as_rollup_rows(points: DataFrame, width_secs: float = params.BUCKET_SECS) -> DataFrame:
    """Each raw point as a rollup row of its bucket."""
    histogram = F.col("kind") == "histogram"
    return points.select(
        bucket(F.col("time"), width_secs).alias("bucket"),
        "name",
        "series_key",
        "attrs_json",
        "service",
        "kind",
        "unit",
        "is_monotonic",
        F.when(histogram, F.col("count")).otherwise(F.lit(1)).cast("bigint").alias("count"),
        F.col("value").alias("sum"),
        F.col("value").alias("min"),
        F.col("value").alias("max"),
        F.when(histogram, F.col("bucket_bounds")).alias("bucket_bounds"),
        F.when(histogram, F.col("bucket_counts")).alias("bucket_counts"),
    )


def merge_rollups(partials: DataFrame, version: str | None = None) -> DataFrame:
    """One row per key from any number of partials.

    Counts and sums add, extremes combine, the newest version gives unit and
    monotonicity, the oldest gives kind and bounds, bucket counts add by position.
    """
    rows = partials.withColumn("_v", F.col(version).cast("bigint") if version else F.lit(0).cast("bigint"))

    def once(column: str) -> Column:
        return F.when(F.col("_once"), F.col(column))

    first_pass = [
        F.sum(once("count")).alias("_count"),
        F.sum(once("sum")).alias("_sum"),
        F.min("min").alias("_min"),
        F.max("max").alias("_max"),
        F.min("_v").alias("_oldest"),
        F.max("_v").alias("_newest"),
    ]
    latest = F.struct("unit", "is_monotonic")
    bounds_order = F.when(F.col("bucket_bounds").isNotNull(), F.struct("_oldest", "bucket_bounds"))
    second_pass = [
        F.sum("_count").alias("count"),
        F.sum("_sum").alias("sum"),
        F.min("_min").alias("min"),
        F.max("_max").alias("max"),
        F.min_by("kind", F.struct("_oldest", "kind")).alias("kind"),
        F.max_by(latest, F.struct("_newest", "unit", "is_monotonic")).alias("_latest"),
        F.min_by("bucket_bounds", bounds_order).alias("bucket_bounds"),
    ]
    merged = sum_counts(rows, [*KEY, *SERIES], "bucket_counts", VARIANTS, first_pass, second_pass)
    return merged.select(
        "bucket",
        "name",
        "series_key",
        "attrs_json",
        "service",
        "kind",
        F.col("_latest.unit").alias("unit"),
        F.col("_latest.is_monotonic").alias("is_monotonic"),
        "count",
        "sum",
        "min",
        "max",
        F.try_divide("sum", "count").alias("avg"),
        "bucket_bounds",
        "bucket_counts",
    )


def rollup_points(points: DataFrame, width_secs: float = params.BUCKET_SECS) -> DataFrame:
    """Partial of one batch of raw points: numbers and histograms together."""
    return merge_rollups(as_rollup_rows(points, width_secs))
