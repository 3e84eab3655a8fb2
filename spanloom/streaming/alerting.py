"""Alert evaluation over time: a timed loop over stored metrics, or keyed stream state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanloom.operators.alerts import alert_step, evaluate_rules, notifications
from spanloom.operators.backtest import TICK_SECS, checked_tick
from spanloom.operators.rule_admin import cascade_events
from spanloom.schemas import EVENTS

TRANSITIONS = (
    "rule_id bigint, state string, at timestamp, value double, fired_at timestamp, active_at timestamp"
)
_STATE = "last_us bigint, fired_us bigint, active_us bigint, value double"


def _folder(path: str, part: str, tick: int) -> str:
    return f"{path}/{part}/tick={tick}"


def run_tick(
    spark: SparkSession, rules: DataFrame, points: DataFrame, facts: DataFrame, path: str, tick: int, now: datetime
) -> None:
    """One evaluation of all rules. Reads the open events of the tick before, writes this tick's.

    Events of rules that are gone go with them, without a notification.
    Every output folder belongs to its tick and is replaced when the tick runs again.
    """
    if tick > 0:
        before = cascade_events(spark.read.schema(EVENTS).parquet(_folder(path, "open", tick - 1)), rules)
    else:
        before = spark.createDataFrame([], EVENTS)
    # Written once: points may arrive meanwhile, and all three outputs must agree.
    evaluate_rules(rules, points, now, facts).write.mode("overwrite").parquet(_folder(path, "evaluated", tick))
    evaluated = spark.read.parquet(_folder(path, "evaluated", tick))
    events, transitions = alert_step(evaluated, before, now)
    events.where("resolved_at IS NULL").write.mode("overwrite").parquet(_folder(path, "open", tick))
    events.where("resolved_at IS NOT NULL").write.mode("overwrite").parquet(_folder(path, "closed", tick))
    notifications(transitions).write.mode("overwrite").json(_folder(path, "notifications", tick))


def read_events(spark: SparkSession, path: str, tick: int) -> DataFrame:
    """All closed events, and those open after the given tick."""
    closed = spark.read.schema(EVENTS).parquet(f"{path}/closed").drop("tick")
    return closed.unionByName(spark.read.schema(EVENTS).parquet(_folder(path, "open", tick)))


def start_alert_loop(
    spark: SparkSession,
    load_rules: Callable[[], DataFrame],
    load_points: Callable[[], DataFrame],
    load_facts: Callable[[], DataFrame],
    path: str,
    checkpoint: str,
    tick_secs: int = TICK_SECS,
    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc).replace(tzinfo=None),
) -> StreamingQuery:
    """Evaluate on a timer. The rate source only paces the batches."""
    timer = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def tick(_: DataFrame, batch_id: int) -> None:
        run_tick(spark, load_rules(), load_points(), load_facts(), path, batch_id, clock())

    pace = {"processingTime": f"{checked_tick(tick_secs)} seconds"}
    return timer.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(**pace).start()


def _advance(ticks: list[tuple], state: tuple | None) -> tuple[list[tuple], tuple]:
    """Walk one rule's evaluations in time order through none, pending and firing."""
    last, fired, active, held = state or (None, None, None, None)
    out = []
    for at, value, hit, dwell in ticks:
        if last is not None and at <= last:
            continue
        last = at
        if hit and fired is None:
            fired, held = at, value
        if hit and active is None and at - fired >= dwell * 1_000_000:
            active, held = at, value
            out.append(("firing", at, held, fired, active))
        elif not hit and fired is not None:
            if active is not None:
                out.append(("resolved", at, value, fired, active))
            fired = active = held = None
    return out, (last, fired, active, held)


def _micros(column: pd.Series) -> list[int]:
    """Epoch microseconds; naive times are UTC."""
    times = pd.to_datetime(column, utc=True)
    return [int(t.value // 1000) for t in times]


def _time(us: int | None):
    return None if us is None else pd.Timestamp(us, unit="us")


def _follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    ticks = []
    for frame in batches:
        dwell = frame["for_secs"].fillna(0).clip(lower=0).astype("int64")
        value = [None if pd.isna(v) else float(v) for v in frame["value"]]
        ticks += list(zip(_micros(frame["at"]), value, frame["breached"].astype(bool), dwell))
    ticks.sort(key=lambda t: t[0])
    moves, after = _advance(ticks, state.get if state.exists else None)
    state.update(after)
    yield pd.DataFrame(
        [(key[0], s, _time(at), v, _time(f), _time(a)) for s, at, v, f, a in moves],
        columns=["rule_id", "state", "at", "value", "fired_at", "active_at"],
    )


def follow_rules(evaluations: DataFrame) -> DataFrame:
    """Transitions from a stream of (rule_id, at, value, breached, for_secs).

    The open event of each rule is keyed state, which outlives restarts through the
    query's checkpoint. Evaluations not newer than the last one seen are ignored. One
    rule has one evaluation per tick, so a group is small.
    """
    return evaluations.groupBy("rule_id").applyInPandasWithState(
        _follow, TRANSITIONS, _STATE, "append", GroupStateTimeout.NoTimeout
    )
