"""Alert rules replayed over history on a grid of ticks, as one batch job.

A point counts at every tick whose look-back holds it, which is a run of ticks. Points
with the same run are folded first. A run then falls apart into at most two blocks of each
power of two (``tick_blocks``), so into 2 log2(ticks) and not into its length; equal blocks
are folded, and a tick takes in the one block of each size that covers it. Sum, count,
least, greatest and newest all merge that way. Long look-backs on a fine grid so cost no more
rows than the grid times the logarithm of its length, whatever the points.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.predicates import breached
from spanloom.functions.times import in_range, to_micros
from spanloom.operators.alerts import (
    active_rules,
    chosen_aggregate,
    join_rules,
    merged_aggregates,
    only_watched,
    partial_aggregates,
    rule_facts,
    step_value,
    with_steps,
)

TICK_SECS = 30


def checked_tick(tick_secs: int) -> int:
    """The tick as it is; a grid of no or of part seconds is an error."""
    if tick_secs < 1 or tick_secs != int(tick_secs):
        raise ValueError(f"a tick of {tick_secs} seconds")
    return int(tick_secs)


def tick_blocks(lo: Column, hi: Column, top: int) -> Column:
    """The run from ``lo`` to ``hi`` as blocks (first, last) of a power of two ticks, aligned to it.

    ``top`` is the greatest tick of the grid.
    """

    def of_size(level: Column) -> Column:
        size = F.pow(F.lit(2.0), level).cast("bigint")
        # Whole blocks of this size inside the run, from ``left`` to before ``right``; an odd end
        # has no partner in a block of twice the size.
        left = F.floor((lo + size - 1) / size).cast("bigint")
        right = F.floor((hi + 1) / size).cast("bigint")
        block = lambda b: F.struct((b * size).alias("first"), ((b + 1) * size - 1).alias("last"))
        some = left < right
        ends = F.array(F.when(some & (left % 2 == 1), block(left)), F.when(some & (right % 2 == 1), block(right - 1)))
        return F.filter(ends, lambda b: b.isNotNull())

    levels = F.sequence(F.lit(0), F.lit(max(0, int(top + 1).bit_length())))
    return F.flatten(F.transform(levels, of_size))


def tick_values(
    rules: DataFrame, points: DataFrame, first: datetime, last: datetime, facts: DataFrame, tick_secs: int = TICK_SECS
) -> DataFrame:
    """Aggregate of each enabled rule at each tick from ``first`` to ``last`` that has data.

    At a tick only points up to the tick are known. A step between two points counts
    while both are inside the look-back.
    """
    step = checked_tick(tick_secs) * 1_000_000
    t0, t1 = to_micros(first), to_micros(last)
    top = (t1 - t0) // step
    enabled = rules.where("enabled")
    asked = rule_facts(enabled)
    # Nothing older than the first tick's longest look-back counts at any tick.
    since = first - timedelta(seconds=asked.longest_secs)
    known = in_range(only_watched(points, enabled, asked), "time", since, last)
    rows = join_rules(with_steps(known), active_rules(rules, facts), asked.nested)

    at_us, before_us = F.unix_micros("time"), F.unix_micros("prev_time")
    look_back = F.col("window_secs").cast("bigint") * 1_000_000

    def last_tick(since):
        """Newest tick whose look-back still holds that instant."""
        x = since + look_back - t0
        return ((x - F.pmod(x, F.lit(step).cast("bigint"))) / step).cast("bigint")

    def first_tick(since):
        x = since - t0
        return ((x + F.pmod(-x, F.lit(step).cast("bigint"))) / step).cast("bigint")

    # Up to the predecessor's last tick the step counts; after it the point stands alone.
    alone = step_value(F.lit(False))
    paired = step_value(F.col("prev_time").isNotNull())
    pair_end = F.when(F.col("prev_time").isNotNull(), last_tick(before_us))
    start, end = first_tick(at_us), last_tick(at_us)
    split = F.coalesce(F.greatest(pair_end, start - 1), start - 1)
    runs = rows.select(
        "rule_id",
        "agg",
        "time",
        F.explode(
            F.array(
                F.struct(start.alias("lo"), split.alias("hi"), paired.alias("v")),
                F.struct((split + 1).alias("lo"), end.alias("hi"), alone.alias("v")),
            )
        ).alias("r"),
    )
    runs = runs.select(
        "rule_id",
        "agg",
        "time",
        F.greatest("r.lo", F.lit(0)).alias("lo"),
        F.least("r.hi", F.lit(top)).alias("hi"),
        F.col("r.v").alias("v"),
    ).where((F.col("lo") <= F.col("hi")) & F.col("v").isNotNull())

    folded = runs.groupBy("rule_id", "agg", "lo", "hi").agg(*partial_aggregates())
    cut = folded.withColumn("_block", F.explode(tick_blocks(F.col("lo"), F.col("hi"), top)))
    blocks = cut.groupBy("rule_id", "agg", "_block").agg(*merged_aggregates())
    ticks = blocks.withColumn("tick", F.explode(F.sequence("_block.first", "_block.last")))
    values = ticks.groupBy("rule_id", "agg", "tick").agg(*merged_aggregates())
    return values.select(
        "rule_id",
        "tick",
        F.timestamp_micros(F.col("tick") * step + t0).alias("at"),
        chosen_aggregate().alias("value"),
    )


def backtest(
    rules: DataFrame, points: DataFrame, first: datetime, last: datetime, facts: DataFrame, tick_secs: int = TICK_SECS
) -> DataFrame:
    """Events that the rules would have produced: runs of breached ticks with their dwell.

    A tick without data counts as recovered. A run that ends before its dwell time has
    passed leaves nothing; a run still open at the last tick stays pending or firing.
    """
    step_secs = checked_tick(tick_secs)
    top = (to_micros(last) - to_micros(first)) // (step_secs * 1_000_000)
    values = tick_values(rules, points, first, last, facts, tick_secs)
    limits = rules.where("enabled").select(
        "rule_id", "comparator", "threshold", F.greatest(F.coalesce("for_secs", F.lit(0)), F.lit(0)).alias("dwell")
    )
    hits = values.join(limits, "rule_id").where(
        breached(F.col("value"), F.col("comparator"), F.col("threshold"))
    )
    by_rule = W.partitionBy("rule_id").orderBy("tick")
    runs = hits.withColumn("_run", F.col("tick") - F.row_number().over(by_rule))
    started = W.partitionBy("rule_id", "_run")
    aged = runs.withColumn("_start", F.min("tick").over(started))
    mature = (F.col("tick") - F.col("_start")) * step_secs >= F.col("dwell")
    events = aged.groupBy("rule_id", "_run").agg(
        F.min("at").alias("fired_at"),
        F.min(F.when(mature, F.col("at"))).alias("active_at"),
        F.min_by("value", "tick").alias("_first"),
        F.min_by("value", F.when(mature, F.col("tick"))).alias("_mature"),
        F.max("tick").alias("_end"),
        F.max("at").alias("_end_at"),
    )
    closed = F.col("_end") < top
    return events.where(F.col("active_at").isNotNull() | ~closed).select(
        "rule_id",
        F.coalesce("_mature", "_first").alias("value"),
        "fired_at",
        "active_at",
        F.when(closed, F.timestamp_micros(F.unix_micros("_end_at") + step_secs * 1_000_000)).alias("resolved_at"),
    )
