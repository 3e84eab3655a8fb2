"""Declared rules against stored rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.operators.scaling import with_running_sum

# Leading hash digits that split the numbering of new rules into chunks (4096 of them).
HASH_DIGITS = 3

# Columns a declaration sets; identity and creation time stay with the stored rule.
DECLARED = [
    "metric",
    "service",
    "comparator",
    "threshold",
    "agg",
    "window_secs",
    "enabled",
    "match_attrs",
    "exclude_attrs",
    "rate",
    "for_secs",
]


def reconcile_rules(declared: DataFrame, stored: DataFrame, created_at) -> DataFrame:
    """The new rule table: declared rules by name, known names keep their id.

    New ids follow the highest stored id, in the order of the names' hashes, so that they
    can be numbered in many tasks. Rules no longer declared are gone.
    """
    old = stored.select("name", F.col("rule_id").alias("_id"), F.col("created_at").alias("_at"))
    kept = declared.select("name", *DECLARED).join(old, "name", "left")
    known = kept.where(F.col("_id").isNotNull())
    fresh = kept.where(F.col("_id").isNull())
    highest = stored.agg(F.coalesce(F.max("rule_id"), F.lit(0)).alias("m")).first()["m"]
    hashed = fresh.withColumns({"_hash": F.md5("name"), "_one": F.lit(1).cast("bigint")})
    chunk = F.conv(F.substring("_hash", 1, HASH_DIGITS), 16, 10).cast("bigint")
    placed = with_running_sum(hashed, [], chunk, ["_hash", "name"], "_one", "_before")
    numbered = placed.select(
        "name", *DECLARED, (F.col("_before") + highest + 1).alias("_id"), created_at.alias("_at")
    )
    return known.unionByName(numbered).select(
        F.col("_id").alias("rule_id"), "name", *DECLARED, F.col("_at").alias("created_at")
    )


def removed_rules(declared: DataFrame, stored: DataFrame) -> DataFrame:
    return stored.join(declared.select("name"), "name", "left_anti")


def cascade_events(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Events whose rule still exists."""
    return events.join(rules.select("rule_id"), "rule_id", "left_semi")


def unique_by_name(rules: DataFrame) -> DataFrame:
    """The rule with the highest id per name."""
    newest = W.partitionBy("name").orderBy(F.desc("rule_id"))
    return rules.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")
