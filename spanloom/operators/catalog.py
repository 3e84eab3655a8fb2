"""The metric list: newest state and a short history of every metric."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom import params
from spanloom.functions.times import in_range
from spanloom.operators.scaling import small_side

def _values_newest_first(condition, column: str):
    """Values in rank order where the condition holds; NULL, not empty, when nothing qualifies."""
    cells = F.collect_list(F.when(condition, F.struct("_rank", F.col(column).cast("double").alias("v"))))
    return F.transform(F.when(F.size(cells) > 0, F.array_sort(cells)), lambda x: x["v"])


def newest_per_name(rows: DataFrame, order: list, keep: int) -> DataFrame:
    """The newest ``keep`` rows of each name, numbered from one in ``_rank``.

    Counts per (name, hour) tell how far back the newest rows reach, so only the rows of
    the last few busy hours are sorted and not the whole table.
    """
    hour = F.floor(F.unix_micros("time") / F.lit(3.6e9)).cast("bigint")
    newer = W.partitionBy("name").orderBy(F.desc("_hour")).rowsBetween(W.unboundedPreceding, -1)
    reach = (
        rows.groupBy("name", hour.alias("_hour"))
        .agg(F.count("*").alias("_n"))
        .withColumn("_newer", F.coalesce(F.sum("_n").over(newer), F.lit(0)))
        .where(F.col("_newer") < keep)
        .groupBy("name")
        .agg(F.min("_hour").alias("_from"))
    )
    recent = rows.join(small_side(reach), "name").where(hour >= F.col("_from")).drop("_from")
    ranked = recent.withColumn("_rank", F.row_number().over(W.partitionBy("name").orderBy(*order)))
    return ranked.where(F.col("_rank") <= keep)


def metric_catalog(
    points: DataFrame,
    *,
    service: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    limit: int | None = None,
) -> DataFrame:
    """One row per metric name: its newest points and the number of its attribute sets.

    There is no default window; ``limit`` keeps the first names of the alphabet. ``dist`` is the newest histogram of the name whatever the
    filters.
    """
    rows = points
    if service is not None:
        rows = rows.where(F.col("service") == service)
    rows = in_range(rows, "time", start, end)
    order = [F.desc("time"), F.col("series_key"), F.col("value")]
    recent = newest_per_name(rows, order, params.SPARK_POINTS)
    valued = F.col("value").isNotNull()
    listed = recent.groupBy("name").agg(
        F.min_by(F.struct("service", "kind", "unit", F.col("value").alias("last_value")), "_rank").alias("n"),
        F.max("time").alias("last_time"),
        _values_newest_first(valued, "value").alias("spark"),
        _values_newest_first(valued & F.col("count").isNotNull(), "count").alias("count_spark"),
    )
    # Equal sets combine before the shuffle; a metric's sets are counted by their number.
    sets = rows.select("name", F.coalesce("attrs_json", F.lit("")).alias("attrs_json")).distinct()
    listed = listed.join(sets.groupBy("name").agg(F.count("*").alias("series_count")), "name")
    counted = points.where(F.col("bucket_counts").isNotNull())
    newest_counts = newest_per_name(counted, [F.desc("time"), F.col("series_key")], 1).select(
        "name", F.col("bucket_counts").alias("_counts")
    )
    out = (
        listed.join(newest_counts, "name", "left")
        .select(
            "name",
            "n.service",
            "n.kind",
            "n.unit",
            "last_time",
            "n.last_value",
            "spark",
            "count_spark",
            F.when(F.col("n.kind") == "histogram", F.col("_counts")).alias("dist"),
            "series_count",
        )
        .orderBy("name")
    )
    return params.top(out, limit)


def counter_steps(spark_values):
    """Increases along a newest-first history, oldest step first; NULL below two points."""
    older = F.slice(spark_values, F.lit(2), F.greatest(F.size(spark_values) - 1, F.lit(0)))
    newer = F.slice(spark_values, F.lit(1), F.greatest(F.size(spark_values) - 1, F.lit(0)))
    steps = F.reverse(F.zip_with(newer, older, lambda a, b: F.greatest(a - b, F.lit(0.0))))
    return F.when(F.size(spark_values) >= 2, steps)
