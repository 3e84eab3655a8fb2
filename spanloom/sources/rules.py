"""Alert rules from a JSON file: defaults, validation, normal form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.alerts import AGGREGATES, COMPARATORS

DECLARATION = (
    "name string, metric string, service string, comparator string, threshold double, agg string, "
    "window_secs int, enabled boolean, match string, exclude string, rate boolean, for_secs int"
)


class InvalidRules(ValueError):
    """At least one declared rule is not usable, so none is taken."""


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Declared rules of a JSON array file, validated and in normal form."""
    declared = spark.read.schema(DECLARATION).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return normalize_rules(declared)


def _predicate(text: Column) -> Column:
    """A JSON object as a map of fragments; absent or empty means no predicate.

    Going through VARIANT keeps strings and numbers apart.
    """
    parsed = F.try_parse_json(text).cast("map<string,variant>")
    entries = F.transform_values(parsed, lambda _, v: F.to_json(v))
    return F.when(F.size(parsed) > 0, entries)


def problems(declared: DataFrame) -> DataFrame:
    """Declared rules that break a constraint, with the constraint."""
    blank = (F.trim(F.coalesce("name", F.lit(""))) == "") | (F.trim(F.coalesce("metric", F.lit(""))) == "")
    problem = (
        F.when(blank, "name and metric are required")
        .when(~F.coalesce(F.col("comparator").isin(COMPARATORS), F.lit(False)), "comparator must be gt or lt")
        .when(F.col("threshold").isNull(), "threshold is required")
        .when(~F.coalesce("agg", F.lit("avg")).isin(AGGREGATES), "unknown aggregate")
        .when(F.coalesce("window_secs", F.lit(1)) < 1, "window_secs must be at least 1")
        .when(F.coalesce("for_secs", F.lit(1)) < 1, "for_secs must be at least 1")
    )
    return declared.select("name", problem.alias("problem")).where(F.col("problem").isNotNull())


def normalize_rules(declared: DataFrame) -> DataFrame:
    """Defaults filled in; raises :class:`InvalidRules` when any rule is bad."""
    bad = problems(declared).limit(5).collect()
    if bad:
        raise InvalidRules("; ".join(f"{row['name']!r}: {row['problem']}" for row in bad))
    return declared.select(
        "name",
        "metric",
        F.nullif("service", F.lit("")).alias("service"),
        "comparator",
        "threshold",
        F.coalesce("agg", F.lit("avg")).alias("agg"),
        F.coalesce("window_secs", F.lit(300)).alias("window_secs"),
        F.coalesce("enabled", F.lit(True)).alias("enabled"),
        _predicate(F.col("match")).alias("match_attrs"),
        _predicate(F.col("exclude")).alias("exclude_attrs"),
        "rate",
        "for_secs",
    )
