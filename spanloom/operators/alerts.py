"""Threshold rules: evaluation of all rules in one job, and the event life cycle."""

from __future__ import annotations

from datetime import datetime, timedelta
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import attributes as at
from spanloom.functions.predicates import breached
from spanloom.functions.times import in_range, instant, seconds_between
from spanloom.operators.metric_facts import counters
from spanloom.operators.scaling import BROADCAST_ROWS, small_side, with_previous

# Limits of a rule.
AGGREGATES = ["avg", "max", "min", "sum", "last", "increase"]
COMPARATORS = ["gt", "lt"]

# Most metric names that are put into a filter as literals.
WATCHED_NAMES = 1000


def resolve_rates(rules: DataFrame, facts: DataFrame) -> DataFrame:
    """Add ``rated``: the rule's own flag, else whether its metric is a monotonic sum.

    The metric's newest valued raw point decides, as the kept facts know it.
    """
    known = counters(facts).select(F.col("name").alias("metric"), F.col("counter").alias("_counter"))
    return rules.join(known, "metric", "left").select(
        *rules.columns,
        (F.coalesce("rate", "_counter", F.lit(False)) & (F.col("agg") != "increase")).alias("rated"),
    )


def with_steps(points: DataFrame) -> DataFrame:
    """Valued points with the previous time and value of their series."""
    rows = points.where(F.col("value").isNotNull()).select(
        "name", "series_key", "service", "attributes", "attrs_json", "time", "value"
    )
    return with_previous(
        rows, ["name", "series_key"], "time", ["value"], {"time": "prev_time", "value": "prev_value"}
    )


class RuleFacts(NamedTuple):
    """What planning needs to know about a rule set."""

    names: list[str] | None
    longest_secs: int
    nested: bool


def rule_facts(rules: DataFrame) -> RuleFacts:
    """One small look at the rules; a set beyond the limit is aggregated instead of listed."""
    nested = _any_nested().alias("nested")
    rows = rules.select("metric", "window_secs", nested).limit(BROADCAST_ROWS + 1).collect()
    if len(rows) > BROADCAST_ROWS:
        whole = rules.agg(F.max("window_secs").alias("longest"), F.max(nested).alias("nested")).first()
        return RuleFacts(None, whole["longest"], whole["nested"])
    names = sorted({row["metric"] for row in rows})
    longest = max((row["window_secs"] for row in rows), default=0)
    return RuleFacts(names if len(names) <= WATCHED_NAMES else None, longest, any(row["nested"] for row in rows))


def only_watched(points: DataFrame, rules: DataFrame, facts: RuleFacts) -> DataFrame:
    """Points of the metrics the rules name; few names become a filter of the scan."""
    if facts.names is not None:
        return points.where(F.col("name").isin(facts.names))
    return points.join(rules.select(F.col("metric").alias("name")).distinct(), "name", "left_semi")


def active_rules(rules: DataFrame, facts: DataFrame) -> DataFrame:
    """Enabled rules with their resolved rate flag, ready to broadcast if few enough."""
    return small_side(resolve_rates(rules.where("enabled"), facts))


def join_rules(points: DataFrame, rules: DataFrame, nested_predicates: bool) -> DataFrame:
    """Each point beside every rule (see :func:`active_rules`) that watches its series."""
    watched = rules.select(
        "rule_id",
        F.col("metric").alias("name"),
        F.col("service").alias("_service"),
        "match_attrs",
        "exclude_attrs",
        "agg",
        "rated",
        "comparator",
        "window_secs",
    )
    nested = _any_nested()
    paired = points.join(watched, "name").where(
        F.col("_service").isNull() | (F.col("service") == F.col("_service"))
    )
    plain = paired.where(~nested).where(_passes(at.contains_scalars))
    # Nested predicates need a recursive comparison; only rules that have one pay for it.
    if not nested_predicates:
        return plain
    deep = paired.where(nested).where(
        _passes(lambda have, want: at.contains_nested(at.canonical_json(have), at.canonical_json(want)))
    )
    return plain.unionByName(deep)


def _any_nested() -> Column:
    return F.coalesce(at.has_nested(F.col("match_attrs")), F.lit(False)) | F.coalesce(
        at.has_nested(F.col("exclude_attrs")), F.lit(False)
    )


def _passes(contains) -> Column:
    have = F.col("attributes")
    wanted, unwanted = F.col("match_attrs"), F.col("exclude_attrs")
    empty = F.create_map().cast("map<string,string>")
    matched = wanted.isNull() | contains(have, F.coalesce(wanted, empty))
    excluded = unwanted.isNotNull() & contains(have, F.coalesce(unwanted, empty))
    return matched & ~excluded


def step_value(has_previous: Column) -> Column:
    """What a point contributes to its rule: level, per-second rate, or positive step.

    A rate needs a predecessor inside the window; an increase counts zero without one.
    """
    rise = F.col("value") - F.col("prev_value")
    secs = seconds_between(F.col("time"), F.col("prev_time"))
    steady = (secs > 0) & (rise >= 0)
    rate = F.when(has_previous, F.when(steady, F.try_divide(rise, secs)).otherwise(F.lit(0.0)))
    increase = F.when(has_previous, F.greatest(rise, F.lit(0.0))).otherwise(F.lit(0.0))
    return F.when(F.col("agg") == "increase", increase).when(F.col("rated"), rate).otherwise(F.col("value"))


def partial_aggregates() -> list[Column]:
    return [
        F.sum("v").alias("_sum"),
        F.count("v").alias("_n"),
        F.min("v").alias("_min"),
        F.max("v").alias("_max"),
        F.max(F.struct("time", "v")).alias("_last"),
    ]


def merged_aggregates() -> list[Column]:
    return [
        F.sum("_sum").alias("_sum"),
        F.sum("_n").alias("_n"),
        F.min("_min").alias("_min"),
        F.max("_max").alias("_max"),
        F.max("_last").alias("_last"),
    ]


def chosen_aggregate() -> Column:
    agg = F.col("agg")
    return (
        F.when(agg == "max", F.col("_max"))
        .when(agg == "min", F.col("_min"))
        .when(agg.isin("sum", "increase"), F.col("_sum"))
        .when(agg == "last", F.col("_last")["v"])
        .otherwise(F.try_divide("_sum", "_n"))
    )


def evaluate_series(rules: DataFrame, points: DataFrame, now: datetime, facts: DataFrame) -> DataFrame:
    """Aggregate of each (rule, series) over the rule's look-back ending now.

    ``facts`` is the kept table of ``metric_facts``; points are read from the longest look-back on.
    There is no upper time bound: points dated after now count as well.
    """
    enabled = rules.where("enabled")
    asked = rule_facts(enabled)
    recent = in_range(only_watched(points, enabled, asked), "time", now - timedelta(seconds=asked.longest_secs))
    paired = join_rules(with_steps(recent), active_rules(rules, facts), asked.nested)
    floor_us = F.unix_micros(instant(now)) - F.col("window_secs").cast("bigint") * 1_000_000
    paired = paired.where(F.unix_micros("time") >= floor_us)
    has_previous = F.coalesce(F.unix_micros("prev_time") >= floor_us, F.lit(False))
    valued = paired.withColumn("v", step_value(has_previous)).where(F.col("v").isNotNull())
    # prev_time is checked per rule: the nearest earlier point of the series is either
    # inside the rule's window or the series has none there.
    return (
        valued.groupBy("rule_id", "agg", "comparator", "series_key", "attrs_json")
        .agg(*partial_aggregates())
        .withColumn("series_value", chosen_aggregate())
    )


def evaluate_rules(rules: DataFrame, points: DataFrame, now: datetime, facts: DataFrame) -> DataFrame:
    """Value, breach and most responsible series of every enabled rule.

    The responsible series has the largest (gt) or smallest (lt) aggregate of its own; it
    comes from the same pass over the series as the rule's value.
    """
    series = evaluate_series(rules, points, now, facts)
    toward = F.when(F.col("comparator") == "lt", F.col("series_value")).otherwise(-F.col("series_value"))
    culprit = F.min_by("attrs_json", F.struct(toward.alias("x"), "series_key")).alias("attrs_json")
    totals = (
        series.groupBy("rule_id", "agg")
        .agg(*merged_aggregates(), culprit)
        .select("rule_id", chosen_aggregate().alias("value"), "attrs_json")
    )
    enabled = rules.where("enabled")
    hit = breached(F.col("value"), F.col("comparator"), F.col("threshold"))
    return enabled.join(totals, "rule_id", "left").select(
        *enabled.columns, "value", hit.alias("breached"), F.when(hit, F.col("attrs_json")).alias("attributes")
    )


def alert_step(evaluated: DataFrame, open_events: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """One pass of the life cycle: the open and just closed events, and the transitions.

    none -> pending (with a dwell time) or firing; pending -> firing once the breach has
    held long enough; pending -> gone on recovery; firing -> resolved on recovery. Events
    of rules that were not evaluated stay as they are.
    """
    at_now = instant(now)
    dwell = F.greatest(F.coalesce("for_secs", F.lit(0)), F.lit(0))
    opened = open_events.where(F.col("resolved_at").isNull()).select(
        "rule_id", F.col("value").alias("event_value"), "fired_at", "active_at"
    )
    both = evaluated.select(
        "rule_id", "name", "metric", "service", "comparator", "threshold", "for_secs", "value", "breached",
        "attributes", F.lit(True).alias("_evaluated"),
    ).join(opened, "rule_id", "full_outer")

    known = F.col("fired_at").isNotNull()
    active = F.col("active_at").isNotNull()
    matured = seconds_between(at_now, F.col("fired_at")) >= dwell
    action = (
        F.when(F.col("_evaluated").isNull(), "keep")
        .when(F.col("breached") & ~known & (dwell == 0), "fire")
        .when(F.col("breached") & ~known, "pend")
        .when(F.col("breached") & ~active & matured, "activate")
        .when(F.col("breached"), "keep")
        .when(known & active, "resolve")
        .when(known, "drop")
        .otherwise("none")
    )
    acted = both.withColumn("action", action)
    fires = F.col("action").isin("fire", "activate")
    events = acted.where(known | F.col("action").isin("fire", "pend")).where("action <> 'drop'").select(
        "rule_id",
        F.when(F.col("action").isin("fire", "pend", "activate"), F.col("value"))
        .otherwise(F.col("event_value"))
        .alias("value"),
        F.coalesce("fired_at", at_now).alias("fired_at"),
        F.when(fires, at_now).otherwise(F.col("active_at")).alias("active_at"),
        F.when(F.col("action") == "resolve", at_now).alias("resolved_at"),
    )
    transitions = acted.where(fires | (F.col("action") == "resolve")).select(
        "rule_id",
        F.col("name").alias("rule"),
        "metric",
        "service",
        F.when(fires, "firing").otherwise("resolved").alias("state"),
        "value",
        "threshold",
        "comparator",
        F.when(fires, F.col("attributes")).alias("attributes"),
    )
    return events, transitions


def notifications(transitions: DataFrame) -> DataFrame:
    """One JSON document per transition; ``attributes`` appears only when known."""
    fields = F.struct("rule", "metric", "service", "state", "value", "threshold", "comparator")
    plain = F.to_json(fields, {"ignoreNullFields": "false"})
    opened = F.substring(plain, F.lit(1), F.length(plain) - 1)
    named = F.concat(opened, F.lit(',"attributes":'), F.col("attributes"), F.lit("}"))
    return transitions.select("rule_id", F.coalesce(named, plain).alias("payload"))
