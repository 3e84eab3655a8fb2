"""Building blocks that keep hot keys from landing in one task.

Used where a plain broadcast, exact percentile or window function would put a whole
key - which may hold a large part of the table - on one executor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.session import written

BROADCAST_ROWS = 20_000
CHUNK_SECS = 3600

# Cells of the percentile grid: 256 per e-fold of magnitude, far fewer than the
# values of a hot key. The offset keeps positive, zero and negative cells apart.
_CELLS_PER_E = 256.0
_CELL_OFFSET = 250_000
_TOP_CELL = 10_000_000


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The same rows, marked for broadcast only after their number was checked.

    At most ``max_rows + 1`` rows reach the driver. A larger side comes back as it is
    and joins by shuffle, where AQE splits skewed partitions.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def _cell(value: Column) -> Column:
    """A coarse, order-keeping integer for a double."""
    inside = F.floor(F.ln(F.abs(value)) * _CELLS_PER_E).cast("bigint") + _CELL_OFFSET
    finite = ~F.isnan(value) & (F.abs(value) < float("inf"))
    return (
        F.when(value == 0, F.lit(0).cast("bigint"))
        .when(finite & (value > 0), inside)
        .when(finite, -inside)
        .when(F.isnan(value) | (value > 0), F.lit(_TOP_CELL).cast("bigint"))
        .otherwise(F.lit(-_TOP_CELL).cast("bigint"))
    )


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: dict[str, float],
    totals: dict[str, Column] | None = None,
) -> DataFrame:
    """Interpolated percentiles per key without gathering a key's values anywhere.

    Pass one counts rows per (key, cell), which combines before the shuffle; the counts are
    written, so the input is read twice in all. The cumulative counts name the few cells
    that hold the wanted ranks. Pass two counts distinct values of those cells only and reads
    the ranks off. ``totals`` are numbers per row to be summed per key in pass one, rows
    without a value included. Keys must not be NULL.
    """
    keys = list(keys)
    totals = totals or {}
    figures = [number.cast("bigint").alias(f"_t_{name}") for name, number in totals.items()]
    every = df.select(*keys, F.col(value).cast("double").alias("_v"), *figures)
    every = every.withColumn("_cell", F.when(F.col("_v").isNotNull(), _cell(F.col("_v"))))
    sums = [F.sum(f"_t_{name}").alias(f"_t_{name}") for name in totals]
    cells = written(every.groupBy(*keys, "_cell").agg(F.count("*").alias("_n"), *sums), "cells")
    celled = every.where(F.col("_v").isNotNull()).select(*keys, "_v", "_cell")

    by_key = Window.partitionBy(*keys)
    counted = (
        cells.where(F.col("_cell").isNotNull())
        .withColumn("_upto", F.sum("_n").over(by_key.orderBy("_cell")))
        .withColumn("_total", F.sum("_n").over(by_key))
        .withColumn("_before", F.col("_upto") - F.col("_n"))
    )

    def rank(q: float, total: Column) -> Column:
        return F.lit(float(q)) * (total - 1)

    def covers(edge: Column, before: Column, upto: Column) -> Column:
        return (edge >= before) & (edge < upto)

    wanted = F.lit(False)
    for q in quantiles.values():
        for snap in (F.floor, F.ceil):
            wanted = wanted | covers(snap(rank(q, F.col("_total"))), F.col("_before"), F.col("_upto"))
    targets = counted.where(wanted).select(*keys, "_cell", "_before", "_total")

    in_cell = Window.partitionBy(*keys, "_cell")
    values = (
        celled.join(small_side(targets), [*keys, "_cell"])
        .groupBy(*keys, "_cell", "_before", "_total", "_v")
        .agg(F.count("*").alias("_n"))
        .withColumn("_upto", F.col("_before") + F.sum("_n").over(in_cell.orderBy("_v")))
        .withColumn("_from", F.col("_upto") - F.col("_n"))
    )
    picks = []
    for name, q in quantiles.items():
        for part, snap in (("lo", F.floor), ("hi", F.ceil)):
            hit = covers(snap(rank(q, F.col("_total"))), F.col("_from"), F.col("_upto"))
            picks.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{name}_{part}"))
    found = values.groupBy(*keys).agg(F.max("_total").alias("_total"), *picks)

    out = []
    for name, q in quantiles.items():
        exact = rank(q, F.col("_total"))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((lo + (hi - lo) * (exact - F.floor(exact))).alias(name))
    if not totals:
        return found.select(*keys, *out)
    summed = cells.groupBy(*keys).agg(*[F.sum(f"_t_{name}").alias(name) for name in totals])
    return summed.join(found.select(*keys, *out), keys, "left")


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    ties: Sequence[str],
    carry: dict[str, str],
    chunk_secs: int = CHUNK_SECS,
) -> DataFrame:
    """``lag`` per key in time order, where a key may hold any share of the rows.

    Windows run per (key, time chunk). A chunk's first row takes its predecessor from
    the newest row of the previous non-empty chunk, which is one small row per chunk.
    ``carry`` maps source columns to the names of their previous values.
    """
    keys = list(keys)
    order = [F.col(time), *[F.col(t) for t in ties]]
    chunk = F.floor(F.unix_micros(F.col(time)) / F.lit(float(chunk_secs * 1_000_000))).cast("bigint")
    rows = df.withColumn("_chunk", chunk)
    payload = F.struct(*[F.col(c).alias(n) for c, n in carry.items()])

    local = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    inner = rows.withColumn("_prev", F.lag(payload).over(local))

    tails = rows.groupBy(*keys, "_chunk").agg(F.max_by(payload, F.struct(*order)).alias("_tail"))
    tails = tails.withColumn("_tail", F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_chunk")))

    joined = inner.join(tails, [*keys, "_chunk"], "left").withColumn("_prev", F.coalesce("_prev", "_tail"))
    return joined.select(
        *[F.col(c) for c in df.columns], *[F.col("_prev")[n].alias(n) for n in carry.values()]
    )


def with_running_sum(
    df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[str], value: str, name: str
) -> DataFrame:
    """Sum of the earlier rows of a key, in two levels like :func:`with_previous`.

    ``chunk`` must not decrease along the order; keys must not be NULL, so that the join
    finds the rows where the window left them.
    """
    keys = list(keys)
    rows = df.withColumn("_chunk", chunk)
    earlier = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumn("_inner", F.coalesce(F.sum(value).over(earlier), F.lit(0)))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_chunk").agg(F.sum(value).alias("_t"))
    totals = totals.withColumn("_base", F.coalesce(F.sum("_t").over(before), F.lit(0))).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_chunk").alias("_kc"), "_base"
    )
    same = F.col("_chunk") == F.col("_kc")
    for i, k in enumerate(keys):
        same = same & (F.col(k) == F.col(f"_k{i}"))
    both = inner.join(totals, same)
    return both.select(*df.columns, (F.col("_inner") + F.coalesce("_base", F.lit(0))).alias(name))
