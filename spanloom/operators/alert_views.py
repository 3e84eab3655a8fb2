"""Read models of rules and events. A pending event (never activated) is not shown as firing."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom import params
from spanloom.functions.times import instant
from spanloom.operators.metric_facts import newest_meta
from spanloom.operators.scaling import small_side

HISTORY_DAYS = 7


def _meta(facts: DataFrame) -> DataFrame:
    return small_side(newest_meta(facts).select(F.col("name").alias("metric"), "kind", "unit"))


def list_alerts(rules: DataFrame, events: DataFrame, facts: DataFrame) -> DataFrame:
    """Rules with their firing state and the kind and unit of their metric, newest rule first.

    ``facts`` is the kept table of ``metric_facts``, here and below.
    """
    firing = (
        events.where(F.col("resolved_at").isNull() & F.col("active_at").isNotNull())
        .select("rule_id", F.lit(True).alias("_open"))
        .distinct()
    )
    return (
        rules.join(firing, "rule_id", "left")
        .join(_meta(facts), "metric", "left")
        .select(
            "rule_id", "name", "metric", "service", "comparator", "threshold", "agg", "window_secs", "enabled",
            "created_at", F.coalesce("_open", F.lit(False)).alias("firing"), "kind", "unit",
        )
        .orderBy(F.desc("created_at"), "rule_id")
    )


def rules_by_urgency(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy(F.desc("firing"), "name")


def firing_count(alerts: DataFrame) -> DataFrame:
    return alerts.agg(F.count_if(F.col("firing") & F.col("enabled")).alias("firing"))


def event_feed(events: DataFrame, rules: DataFrame, facts: DataFrame, limit: int | None = None) -> DataFrame:
    """Events that fired, newest first, with their rule."""
    names = small_side(rules.select("rule_id", F.col("name").alias("rule_name"), "metric"))
    feed = (
        events.where(F.col("active_at").isNotNull())
        .join(names, "rule_id")
        .join(_meta(facts), "metric", "left")
        .select("rule_id", "rule_name", "metric", "value", "fired_at", "resolved_at", "kind", "unit")
        .orderBy(F.desc("fired_at"), "rule_id")
    )
    return params.top(feed, limit)


def rule_history(events: DataFrame, now: datetime, days: int = HISTORY_DAYS) -> DataFrame:
    """Per rule: fires in the last days, and the start of the oldest fire still open."""
    recent = F.col("fired_at") >= instant(now - timedelta(days=days))
    return (
        events.where(F.col("active_at").isNotNull())
        .groupBy("rule_id")
        .agg(
            F.count_if(recent).alias("recent_fires"),
            F.min(F.when(F.col("resolved_at").isNull(), F.col("fired_at"))).alias("open_since"),
        )
    )
