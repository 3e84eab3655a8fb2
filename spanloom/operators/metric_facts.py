"""What is constant per metric - kind, monotonicity, unit - as a small kept table.

A fact row says when a combination of these was last seen, in raw points or in rollups,
and when a raw point of it last had a value. Facts of two sets of points merge by maxima, so batches
keep the table current one after another, in any order and also twice, and no read has
to look through points for a metric's kind or unit. Its size follows the metric names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType, TimestampType

KEYS = ["name", "kind", "is_monotonic", "unit", "from_raw"]
FACTS = StructType(
    [
        StructField("name", StringType()),
        StructField("kind", StringType()),
        StructField("is_monotonic", BooleanType()),
        StructField("unit", StringType()),
        StructField("from_raw", BooleanType()),
        StructField("last_time", TimestampType()),
        StructField("last_valued", TimestampType()),
    ]
)


def facts_of(points: DataFrame, rollups: DataFrame | None = None) -> DataFrame:
    """Facts of a batch of raw points and, for tables whose points are gone, of rollups."""
    valued = F.when(F.col("value").isNotNull(), F.col("time"))
    rows = points.select(
        *KEYS[:-1], F.lit(True).alias("from_raw"), F.col("time").alias("last_time"), valued.alias("last_valued")
    )
    if rollups is not None:
        never = F.lit(None).cast("timestamp").alias("last_valued")
        rows = rows.unionByName(
            rollups.select(*KEYS[:-1], F.lit(False).alias("from_raw"), F.col("bucket").alias("last_time"), never)
        )
    return merge_facts(rows)


def merge_facts(*tables: DataFrame) -> DataFrame:
    rows = reduce(DataFrame.unionByName, tables)
    latest = [F.max(c).alias(c) for c in ("last_time", "last_valued")]
    return rows.groupBy(*KEYS).agg(*latest)


def newest_meta(facts: DataFrame, name: str | None = None) -> DataFrame:
    """Newest kind, monotonicity and unit per metric; raw points before rollups of their time."""
    rows = facts if name is None else facts.where(F.col("name") == name)
    order = F.struct("last_time", "from_raw", "kind", "is_monotonic", "unit")
    newest = rows.groupBy("name").agg(F.max_by(F.struct("kind", "is_monotonic", "unit"), order).alias("m"))
    return newest.select("name", "m.kind", "m.is_monotonic", "m.unit")


def counters(facts: DataFrame) -> DataFrame:
    """(name, counter): whether the newest raw point that had a value is of a monotonic sum."""
    mono = F.coalesce("is_monotonic", F.lit(False))
    counter = (F.col("kind") == "sum") & mono
    rows = facts.where(F.col("from_raw") & F.col("last_valued").isNotNull())
    order = F.struct("last_valued", "kind", mono)
    return rows.groupBy("name").agg(F.max_by(counter, order).alias("counter"))
