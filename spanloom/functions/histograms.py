"""Explicit-bound histograms as array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUANTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


def array_add(left: Column, right: Column) -> Column:
    """Element-wise sum, the shorter side padded with zeros; NULL when both are empty."""
    empty = F.array().cast("array<bigint>")
    a, b = F.coalesce(left, empty), F.coalesce(right, empty)
    zero = F.lit(0).cast("bigint")
    total = F.zip_with(a, b, lambda x, y: F.coalesce(x, zero) + F.coalesce(y, zero))
    return F.when(F.size(total) > 0, total)


def running_counts(counts: Column) -> Column:
    """Running sums, carried through one fold."""
    seed = F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<bigint>").alias("all"))

    def step(acc: Column, c: Column) -> Column:
        return F.struct((acc["sum"] + c).alias("sum"), F.concat(acc["all"], F.array(acc["sum"] + c)).alias("all"))

    return F.aggregate(counts, seed, step, lambda acc: acc["all"])


def interpolate(bounds: Column, counts: Column, running: Column, q: float) -> Column:
    """Quantile by linear interpolation inside the bucket that holds the rank."""
    total = F.get(running, F.size(running) - 1)
    rank = F.lit(q) * total
    index = F.array_position(F.transform(running, lambda c: c >= rank), True).cast("int") - 1
    last = F.get(bounds, F.size(bounds) - 1)
    lower = F.when(index == 0, F.lit(0.0)).otherwise(F.get(bounds, index - 1))
    upper, inside = F.get(bounds, index), F.get(counts, index)
    before = F.get(running, index) - inside
    return (
        F.when((F.coalesce(total, F.lit(0)) == 0) | (F.size(bounds) == 0), F.lit(None).cast("double"))
        .when((index < 0) | upper.isNull(), last)
        .when(inside == 0, upper)
        .otherwise(lower + (upper - lower) * F.try_divide(rank - before, inside))
    )


def with_quantiles(df: DataFrame, bounds: str, counts: str, quantiles: dict[str, float] | None = None) -> DataFrame:
    df = df.withColumn("_running", running_counts(F.col(counts)))
    cols = {
        name: interpolate(F.col(bounds), F.col(counts), F.col("_running"), q)
        for name, q in (quantiles or QUANTILES).items()
    }
    return df.withColumns(cols).drop("_running")
