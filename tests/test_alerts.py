import json
from datetime import datetime, timedelta

import pytest
from builders import NOW, ago, points, rollups, rule, rules
from pyspark.sql import functions as F

from spanloom.operators import alert_views, alerts, backtest, rule_admin
from spanloom.operators.alerts import alert_step, notifications
from spanloom.operators.metric_facts import facts_of
from spanloom.schemas import EVENTS
from spanloom.sources.rules import InvalidRules, normalize_rules, read_rules


def evaluate_rules(declared, pts, now):
    return alerts.evaluate_rules(declared, pts, now, facts_of(pts))


def values(spark, pts, *overs):
    """Value and breach of one rule per set of options, all evaluated together."""
    declared = rules(spark, *[rule(i, **over) for i, over in enumerate(overs)])
    rows = evaluate_rules(declared, points(spark, pts), NOW).collect()
    return [(r["value"], r["breached"]) for r in sorted(rows, key=lambda r: r["rule_id"])]


def counter(*levels, step=10, **over):
    n = len(levels)
    return [
        dict(kind="sum", mono=True, value=v, time=ago(seconds=step * (n - i)), **over) for i, v in enumerate(levels)
    ]


def test_aggregates(spark):
    pts = [dict(value=10, time=ago(seconds=30)), dict(value=100, time=ago(seconds=20)), dict(value=40, time=ago(seconds=10))]
    pts += [
        dict(name="neg", value=-5),
        dict(name="old", value=90, time=ago(hours=1)),
        # Points dated after now count.
        dict(name="future", value=90, time=NOW + timedelta(hours=1)),
    ]
    found = values(
        spark,
        pts,
        dict(agg="avg"),
        dict(agg="max", threshold=80),
        dict(agg="min"),
        dict(agg="sum"),
        dict(agg="last"),
        dict(metric="neg", comparator="lt", threshold=0),
        dict(metric="old"),
        dict(metric="future"),
        dict(service="other"),
    )
    assert found == [
        (50.0, False), (100.0, True), (10.0, False), (150.0, True), (40.0, False), (-5.0, True), (None, False),
        (90.0, True), (None, False),
    ]


def test_scopes(spark):
    pts = [dict(value=90, attrs={"role": "replica"}), dict(value=10, attrs={"role": "primary"}), dict(name="t", value=90, attrs={"n": 5})]
    high = dict(agg="max", threshold=80)
    assert values(
        spark,
        pts,
        high,
        dict(high, match_attrs={"role": "primary"}),
        dict(high, exclude_attrs={"role": "replica"}),
        dict(metric="t", match_attrs={"n": "5"}),
        dict(metric="t", match_attrs={"n": 5}),
    ) == [(90.0, True), (10.0, False), (10.0, False), (None, False), (90.0, True)]


def test_nested_scopes(spark):
    pts = [dict(value=90, attrs={"o": {"x": 1, "y": [1, 2]}}), dict(value=70, attrs={"o": {"x": 2}})]
    found = values(spark, pts, dict(match_attrs={"o": {"y": [2]}}), dict(exclude_attrs={"o": {"y": [2]}}), dict())
    assert [v for v, _ in found] == [90.0, 70.0, 80.0]


def test_rates(spark):
    pts = counter(100, 400) + counter(1_000_000, 10, name="reset") + counter(400, name="lone")
    pts += counter(0, 100, name="two", attrs={"s": "a"}) + counter(1000, 1000, name="two", attrs={"s": "b"})
    found = values(
        spark, pts, dict(), dict(rate=False, agg="max"), dict(metric="reset"), dict(metric="lone"), dict(metric="two")
    )
    assert [v for v, _ in found] == [pytest.approx(30.0), 400.0, 0.0, None, pytest.approx(5.0)]


def test_increase(spark):
    pts = counter(5, 8, 2, 4) + counter(5, name="lone") + counter(5, 105, step=200, name="wide")
    found = values(
        spark,
        pts,
        dict(agg="increase"),
        dict(agg="increase", metric="lone"),
        dict(agg="increase", metric="absent"),
        # The point before the look-back gives no step.
        dict(agg="increase", metric="wide", window_secs=300),
    )
    assert [v for v, _ in found] == [5.0, 0.0, None, 0.0]


def test_many_rules_go_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr("spanloom.operators.alerts.BROADCAST_ROWS", 1)
    monkeypatch.setattr("spanloom.operators.alerts.small_side", lambda df: df)
    assert values(spark, counter(100, 400), dict(), dict(rate=False), dict(metric="none")) == [
        (pytest.approx(30.0), False), (250.0, True), (None, False),
    ]


def test_attribution(spark):
    pts = [dict(value=v, attrs={"pod": p}) for v, p in ((60, "a"), (90, "b"), (55, "c"))]
    high = evaluate_rules(rules(spark, rule()), points(spark, pts), NOW).first()
    assert high["attributes"] == '{"pod": "b"}'
    low = evaluate_rules(rules(spark, rule(comparator="lt", threshold=100)), points(spark, pts), NOW).first()
    assert low["attributes"] == '{"pod": "c"}'


def step(spark, level, events, now, **over):
    pts = points(spark, [dict(value=level, time=now)])
    after, moves = alert_step(evaluate_rules(rules(spark, rule(**over)), pts, now), events, now)
    return spark.createDataFrame(after.collect(), EVENTS), moves.collect()


def test_fire_and_resolve(spark):
    none = spark.createDataFrame([], EVENTS)
    events, moves = step(spark, 90, none, NOW)
    assert [m["state"] for m in moves] == ["firing"] and events.first()["active_at"] == NOW
    events, moves = step(spark, 95, events, NOW + timedelta(seconds=30))
    assert moves == [] and events.first()["value"] == 90.0
    later = NOW + timedelta(seconds=400)
    events, moves = step(spark, 5, events, later)
    assert [m["state"] for m in moves] == ["resolved"]
    assert [tuple(r) for r in events.collect()] == [(1, 90.0, NOW, NOW, later)]


def test_dwell(spark):
    events, moves = step(spark, 90, spark.createDataFrame([], EVENTS), NOW, for_secs=300)
    assert moves == [] and events.first()["active_at"] is None
    events, moves = step(spark, 91, events, NOW + timedelta(seconds=60), for_secs=300)
    assert moves == [] and events.first()["active_at"] is None
    dropped, moves = step(spark, 5, events, NOW + timedelta(seconds=90), for_secs=300)
    assert moves == [] and dropped.count() == 0
    matured = NOW + timedelta(seconds=301)
    events, moves = step(spark, 92, events, matured, for_secs=300)
    assert [m["value"] for m in moves] == [92.0]
    assert [tuple(r) for r in events.collect()] == [(1, 92.0, NOW, matured, None)]


def test_no_data_resolves_and_disabled_stays(spark):
    open_event = spark.createDataFrame([(1, 90.0, ago(minutes=9), ago(minutes=9), None)], EVENTS)
    pts = points(spark, [dict(name="other")])
    events, moves = alert_step(evaluate_rules(rules(spark, rule()), pts, NOW), open_event, NOW)
    assert [m["state"] for m in moves.collect()] == ["resolved"]
    events, moves = alert_step(evaluate_rules(rules(spark, rule(enabled=False)), pts, NOW), open_event, NOW)
    assert moves.count() == 0 and events.first()["resolved_at"] is None


def test_notifications(spark):
    _, moves = alert_step(
        evaluate_rules(rules(spark, rule()), points(spark, [dict(value=90, attrs={"pod": "a"})]), NOW),
        spark.createDataFrame([], EVENTS),
        NOW,
    )
    payload = json.loads(notifications(moves).first()["payload"])
    assert payload == {
        "rule": "r1", "metric": "m", "service": None, "state": "firing", "value": 90.0, "threshold": 50.0,
        "comparator": "gt", "attributes": {"pod": "a"},
    }
    assert "attributes" not in json.loads(notifications(moves.withColumn("attributes", F.lit(None).cast("string"))).first()["payload"])


def test_backtest_equals_repeated_steps(spark):
    start = datetime(2024, 5, 1)
    levels = [10, 60, None, None, 80, 90, 20, 99, 10, 70]
    pts = []
    for i, level in enumerate(levels):
        if level is not None:
            pts.append(dict(value=level, time=start + timedelta(seconds=60 * i + 7)))
            pts.append(dict(name="c", kind="sum", mono=True, value=(level * 7) % 100, time=start + timedelta(seconds=60 * i + 3)))
    declared = rules(
        spark,
        rule(1, window_secs=100),
        rule(2, window_secs=90, for_secs=120, agg="last"),
        rule(3, metric="c", window_secs=200, threshold=0.3),
        rule(4, metric="c", window_secs=130, agg="increase", threshold=1),
        rule(5, metric="c", window_secs=130, agg="increase", comparator="lt", threshold=1, for_secs=61),
    )
    df = points(spark, pts)
    ticks = len(levels)
    history = spark.createDataFrame([], EVENTS)
    for i in range(ticks + 1):
        now = start + timedelta(seconds=60 * i)
        # At its time a tick knew only the points so far.
        known = df.where(F.col("time") <= F.lit(now))
        closed = history.where("resolved_at is not null").collect()
        after, _ = alert_step(evaluate_rules(declared, known, now), history, now)
        history = spark.createDataFrame(closed + after.collect(), EVENTS)
    found = backtest.backtest(declared, df, start, start + timedelta(seconds=60 * ticks), facts_of(df), 60)
    assert sorted(map(str, found.collect())) == sorted(map(str, history.collect()))
    assert found.count() > 4


def test_views(spark):
    declared = rules(spark, rule(1, name="b"), rule(2, name="a", metric="h"), rule(3, name="c", enabled=False))
    rows = [
        (1, 9.0, ago(days=1), ago(days=1), None),
        (1, 8.0, ago(days=9), ago(days=9), ago(days=8)),
        (2, 7.0, ago(hours=1), None, None),
        (3, 7.0, ago(hours=2), ago(hours=2), None),
    ]
    events = spark.createDataFrame(rows, EVENTS)
    pts = points(spark, [dict(kind="gauge", unit="s")])
    rolled = rollups(spark, [dict(bucket=NOW, name="h", kind="histogram", unit="By", sum=1.0)])
    listed = alert_views.list_alerts(declared, events, facts_of(pts, rolled))
    assert {r["name"]: (r["firing"], r["kind"], r["unit"]) for r in listed.collect()} == {
        "a": (False, "histogram", "By"), "b": (True, "gauge", "s"), "c": (True, "gauge", "s"),
    }
    assert [r["name"] for r in alert_views.rules_by_urgency(listed).collect()] == ["b", "c", "a"]
    assert alert_views.firing_count(listed).first()["firing"] == 1
    feed = alert_views.event_feed(events, declared, facts_of(pts, rolled))
    assert [(r["rule_name"], r["value"]) for r in feed.collect()] == [("c", 7.0), ("b", 9.0), ("b", 8.0)]
    history = {r["rule_id"]: (r["recent_fires"], r["open_since"]) for r in alert_views.rule_history(events, NOW).collect()}
    assert history == {1: (1, ago(days=1)), 3: (1, ago(hours=2))}


def test_reconcile(spark):
    stored = rules(spark, rule(4, name="keep"), rule(7, name="drop"))
    declared = rules(spark, rule(name="keep", threshold=99), rule(name="new")).drop("rule_id", "created_at")
    after = rule_admin.reconcile_rules(declared, stored, F.lit(NOW))
    assert {r["name"]: (r["rule_id"], r["threshold"]) for r in after.collect()} == {"keep": (4, 99.0), "new": (8, 50.0)}
    assert [r["name"] for r in rule_admin.removed_rules(declared, stored).collect()] == ["drop"]
    events = spark.createDataFrame([(4, 1.0, NOW, NOW, None), (7, 1.0, NOW, NOW, None)], EVENTS)
    assert [r["rule_id"] for r in rule_admin.cascade_events(events, after).collect()] == [4]
    double = rules(spark, rule(1, name="x", threshold=1), rule(2, name="x", threshold=2))
    assert [r["rule_id"] for r in rule_admin.unique_by_name(double).collect()] == [2]


def test_rule_file(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(
        json.dumps(
            [
                {"name": "a", "metric": "m", "comparator": "gt", "threshold": 1},
                {"name": "b", "metric": "m", "comparator": "lt", "threshold": 2, "agg": "sum", "window_secs": 5,
                 "service": "", "match": {"k": "v", "n": 5}, "exclude": {}, "for_secs": 60, "enabled": False},
            ]
        )
    )
    a, b = read_rules(spark, str(path)).orderBy("name").collect()
    assert (a["agg"], a["window_secs"], a["enabled"], a["match_attrs"], a["for_secs"]) == ("avg", 300, True, None, None)
    assert (b["window_secs"], b["service"], b["match_attrs"], b["exclude_attrs"], b["enabled"]) == (
        5, None, {"k": '"v"', "n": "5"}, None, False,
    )


@pytest.mark.parametrize(
    "bad",
    [
        {"name": " "}, {"metric": ""}, {"comparator": "ge"}, {"agg": "p99"}, {"for_secs": 0}, {"window_secs": 0},
        {"threshold": None},
    ],
)
def test_bad_rule_rejects_all(spark, bad):
    good = {"name": "a", "metric": "m", "comparator": "gt", "threshold": 1.0, "agg": None, "for_secs": None}
    schema = (
        "name string, metric string, service string, comparator string, threshold double, agg string, window_secs int, "
        "enabled boolean, match string, exclude string, rate boolean, for_secs int"
    )
    rows = [[{**good, **over}.get(f.split()[0]) for f in schema.split(", ")] for over in ({}, bad)]
    with pytest.raises(InvalidRules):
        normalize_rules(spark.createDataFrame(rows, schema))


def test_runs_fall_into_few_blocks(spark):
    top = 300
    runs = [(lo, hi) for lo in range(0, top + 1, 7) for hi in range(lo, top + 1, 5)] + [(0, top), (top, top), (1, 2), (0, 0)]
    rows = spark.createDataFrame(runs, "lo bigint, hi bigint")
    for lo, hi, blocks in rows.select("lo", "hi", backtest.tick_blocks(F.col("lo"), F.col("hi"), top)).collect():
        covered = sorted(t for b in blocks for t in range(b["first"], b["last"] + 1))
        assert covered == list(range(lo, hi + 1))
        assert len(blocks) <= 2 * (hi - lo + 1).bit_length()
        for b in blocks:
            size = b["last"] - b["first"] + 1
            assert size & (size - 1) == 0 and b["first"] % size == 0
