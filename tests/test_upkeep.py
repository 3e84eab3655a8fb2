import json
from datetime import timedelta

import pytest
from builders import NOW, ago, points, rollups, span, spans
from pyspark.sql import functions as F

from spanloom import schemas
from spanloom.operators import health, retention
from spanloom.operators.rollups import rollup_points
from spanloom.sources import storage


def tables(spark):
    return {
        "spans": spans(spark, [span("t", "1", start=ago(hours=1)), span("t", "2", start=ago(days=3)), span("t", "3", start=ago(days=10))]),
        "logs": spark.createDataFrame([(ago(hours=1),), (ago(days=10),)], "time timestamp"),
        "metrics": points(spark, [dict(time=ago(hours=1)), dict(time=ago(hours=7))]),
        "metric_series_rollups": rollups(spark, [dict(bucket=ago(hours=1), sum=1.0), dict(bucket=ago(days=10), sum=1.0)]),
    }


def counts(kept):
    return {name: df.count() for name, df in kept.items()}


def test_prune(spark):
    kept = retention.prune(tables(spark), NOW, 7, 6)
    assert counts(kept) == {"spans": 2, "logs": 1, "metrics": 1, "metric_series_rollups": 1}
    own = retention.Windows(spans_days=1, logs_days=30)
    assert counts(retention.prune(tables(spark), NOW, 7, 6, own)) == {"spans": 1, "logs": 2, "metrics": 1, "metric_series_rollups": 1}
    assert counts(retention.prune(tables(spark), NOW, 0, 0)) == {"spans": 3, "logs": 2, "metrics": 2, "metric_series_rollups": 2}
    assert not retention.loop_enabled(0) and retention.loop_enabled(7)
    edge = spark.createDataFrame([(ago(days=7),)], "time timestamp")
    assert retention.split_expired(edge, "time", ago(days=7))[0].count() == 1


def test_sweep_on_storage(spark, tmp_path):
    path = str(tmp_path / "spans")
    rows = [span("t", str(i), start=ago(hours=6 * i)) for i in range(40)]
    storage.append(spans(spark, rows), "spans", path)
    cutoff = ago(days=3, hours=2)
    assert retention.sweep_table(spark, path, "start_time", cutoff) == 40 - 13
    left = storage.read_table(spark, path, schemas.SPANS)
    assert left.count() == 13 and left.where(F.col("start_time") < F.lit(cutoff)).count() == 0
    assert retention.sweep_table(spark, path, "start_time", cutoff) == 0
    # A sweep died after it moved the boundary day aside: the next one puts it back.
    day = cutoff.date().isoformat()
    (tmp_path / "spans" / f"date={day}").rename(tmp_path / "spans" / f"_retired_date={day}")
    assert retention.sweep_table(spark, path, "start_time", cutoff) == 0
    assert storage.read_table(spark, path, schemas.SPANS).count() == 13


def test_failing_table_does_not_stop_the_rest(spark, tmp_path):
    logs = str(tmp_path / "logs")
    rows = spark.createDataFrame([(ago(hours=1), "a"), (ago(days=10), "b")], "time timestamp, service string")
    storage.append(rows, "logs", logs)
    with pytest.raises(retention.SweepError) as caught:
        retention.sweep(spark, {"spans": str(tmp_path / "absent"), "logs": logs}, NOW, 7, 6)
    assert caught.value.failed == ["spans"] and caught.value.pruned == {"logs": 1}


def test_sweep_of_streamed_tables_and_rollups(spark, tmp_path):
    path, rolled = str(tmp_path / "s"), str(tmp_path / "r")
    for i in range(20):
        storage.append_batch(spans(spark, [span("t", str(i), start=ago(days=i))]), "spans", path, i)
    storage.append(spans(spark, [span("u", "1", start=ago(days=7, hours=1))]), "spans", path)
    for i in (1, 9):
        storage.write_partials(rollup_points(points(spark, [dict(time=ago(days=i))])), rolled, i)
    paths = {"spans": path, "metric_series_rollups": rolled}
    assert retention.sweep(spark, paths, NOW, 7, 0) == {"spans": 13, "metric_series_rollups": 1}
    left = storage.read_table(spark, path, schemas.SPANS)
    assert left.count() == 8 and left.where(F.col("start_time") < F.lit(ago(days=7))).count() == 0
    assert storage.read_rollups(spark, rolled).count() == 1
    assert retention.sweep(spark, paths, NOW, 7, 0) == {"spans": 0, "metric_series_rollups": 0}


def test_stall(spark):
    log = spark.createDataFrame([(ago(hours=3), True, 5), (ago(minutes=1), False, 0)], "finished_at timestamp, ok boolean, rows bigint")
    row = retention.stalled(log, ago(days=1), NOW).first()
    assert (row["age_secs"], row["last_rows"], row["stalled"]) == (3 * 3600, 5, True)
    assert not retention.stalled(log.where("false"), ago(minutes=5), NOW).first()["stalled"]
    assert retention.stalled(log.where("false"), NOW - timedelta(seconds=7201), NOW).first()["stalled"]


def test_rollup_storage(spark, tmp_path):
    path, packed = str(tmp_path / "r"), str(tmp_path / "packed")
    first, second = points(spark, [dict(value=10)]), points(spark, [dict(value=20)])
    storage.write_partials(rollup_points(first), path, 1)
    storage.write_partials(rollup_points(second), path, 2)
    storage.write_partials(rollup_points(second), path, 2)
    row = storage.read_rollups(spark, path).first()
    assert (row["count"], row["sum"], row["avg"]) == (2, 30.0, 15.0)
    storage.compact_rollups(spark, path, packed)
    storage.write_partials(rollup_points(second), packed, 3)
    assert storage.read_rollups(spark, packed).first()["sum"] == 50.0


def test_read_prunes_days(spark, tmp_path):
    from spanloom.operators.traces import search_traces

    path = str(tmp_path / "spans")
    storage.append(spans(spark, [span("t", str(i), start=ago(days=i)) for i in range(5)]), "spans", path)
    found = search_traces(storage.read_table(spark, path, schemas.SPANS), NOW, start=ago(hours=30))
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "PushedFilters: [IsNotNull(start_time)" in plan
    assert found.first()["span_count"] == 2


def test_health(spark, tmp_path):
    t = tables(spark)
    found = health.table_figures(t["spans"], t["logs"], t["metrics"], t["metric_series_rollups"], NOW)
    values = {(r["name"], r["table"]): r["value"] for r in found.collect()}
    assert values["table.rows", "spans"] == 3.0
    assert values["retention.oldest_raw_metric_age_seconds", "metrics"] == 7 * 3600.0
    assert values["rollup.lag_seconds", "metric_series_rollups"] == 3600.0
    empty = health.table_figures(t["spans"], t["logs"], t["metrics"].where("false"), t["metric_series_rollups"], NOW)
    assert empty.where("table = 'metrics'").count() == 1
    rolled = rollup_points(health.as_points(found, "table", NOW, "monitor"))
    assert {json.loads(r["attrs_json"])["table"] for r in rolled.collect()} == {"spans", "logs", "metrics", "metric_series_rollups"}
    rejected = spark.createDataFrame([("decode",), ("decode",)], "reason string")
    counted = health.ingest_counters(t["spans"], rejected, "spans")
    assert {(r["name"], r["reason"]): r["value"] for r in counted.collect()} == {
        ("ingest.spans_total", None): 3.0, ("ingest.dropped_total", "decode"): 2.0,
    }
    out = str(tmp_path / "json")
    storage.write_json(counted, out)
    assert spark.read.json(out).count() == 2
