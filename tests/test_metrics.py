from datetime import datetime, timedelta

import pytest
from builders import NOW, ago, points, rollups
from pyspark.sql import functions as F

from spanloom.operators import catalog, histogram_reads, labels, metrics
from spanloom.operators.metric_facts import facts_of
from spanloom.operators.rollups import as_rollup_rows, merge_rollups, rollup_points


def test_number_rollup(spark):
    rows = [dict(value=v, attrs={"s": s}) for s, v in (("a", 10), ("a", 20), ("b", 5))]
    found = {r["attrs_json"]: r for r in rollup_points(points(spark, rows)).collect()}
    a = found['{"s": "a"}']
    assert len(found) == 2
    assert (a["count"], a["sum"], a["min"], a["max"], a["avg"], a["bucket_counts"]) == (2, 30.0, 10.0, 20.0, 15.0, None)


def test_batches_merge(spark):
    first, second = (rollup_points(points(spark, [dict(value=v, unit=u)])) for v, u in ((10, "s"), (20, "ms")))
    both = first.withColumn("b", F.lit(1)).unionByName(second.withColumn("b", F.lit(2)))
    row = merge_rollups(both, "b").first()
    assert (row["count"], row["sum"], row["avg"], row["unit"]) == (2, 30.0, 15.0, "ms")


def test_histogram_rollup(spark):
    hist = dict(kind="histogram", bounds=[1.0, 2.0])
    rows = [dict(hist, value=3, count=3, counts=[1, 2, 0]), dict(hist, value=None, count=3, counts=[0, 1, 2])]
    row = rollup_points(points(spark, rows)).first()
    assert (row["bucket_counts"], row["count"], row["sum"], row["avg"]) == ([1, 3, 2], 6, 3.0, 0.5)
    assert row["bucket_bounds"] == [1.0, 2.0]
    # Shorter counts count as zero beyond their end; no counts at all stay NULL.
    rows = [dict(hist, value=1, count=1, counts=[1]), dict(hist, value=1, count=1, counts=[0, 4])]
    assert rollup_points(points(spark, rows)).first()["bucket_counts"] == [1, 4]
    assert rollup_points(points(spark, [dict(hist, value=1, count=1)])).first()["bucket_counts"] is None


def test_merge_equals_one_pass(spark):
    rows = [
        dict(time=ago(seconds=7 * i), value=i % 11, attrs={"s": str(i % 3)}, kind="histogram", count=i, bounds=[1.0],
             counts=[i, 1])
        for i in range(120)
    ]
    df = points(spark, rows)
    parts = [
        merge_rollups(as_rollup_rows(df.where(F.pmod(F.unix_seconds("time"), F.lit(3)) == i))).withColumn("b", F.lit(i))
        for i in range(3)
    ]
    merged = merge_rollups(parts[0].unionByName(parts[1]).unionByName(parts[2]), "b")
    assert sorted(map(str, merged.collect())) == sorted(map(str, rollup_points(df).collect()))


def test_series_weighted_mean(spark):
    top = datetime(2024, 5, 1, 11, 45)
    df = rollups(
        spark,
        [
            dict(bucket=top, count=3, sum=15.0),
            dict(bucket=top + timedelta(minutes=5), count=1, sum=2.0),
            dict(bucket=top - timedelta(minutes=15), count=10, sum=100.0),
        ],
    )
    wide = metrics.metric_series(df, NOW, name="m", base_secs=900.0, hours=6)
    assert [r["v"] for r in wide.collect()] == [10.0, 4.25]
    narrow = metrics.metric_series(df, NOW, name="m", hours=1)
    assert [r["v"] for r in narrow.collect()] == [10.0, 5.0, 2.0]


def test_series_ceiling(spark):
    df = rollups(spark, [dict(bucket=ago(days=d), sum=1.0) for d in (1, 3, 6, 8, 900)])
    assert metrics.metric_series(df, NOW, name="m", hours=24 * 1000).count() == 5
    assert metrics.metric_series(df, NOW, name="m", hours=2160).count() == 4
    assert metrics.metric_series(df, NOW, name="m", hours=2160, max_hours=168).count() == 3


def test_facet_rate(spark):
    top = datetime(2024, 5, 1, 11, 0)
    rows = []
    for attr, levels in (("a", (100, 160, None, 40)), ("b", (500, 500))):
        for i, level in enumerate(levels):
            rows.append(
                dict(bucket=top + timedelta(minutes=5 * i), kind="sum", mono=True, attrs={"s": attr},
                     sum=None if level is None else float(level))
            )
    empty = points(spark, [dict(name="other")])
    facet = metrics.metric_facet(facts_of(empty, rollups(spark, rows)), rollups(spark, rows), NOW, name="m")
    lines = {}
    for r in facet.points.orderBy("t").collect():
        lines.setdefault(r["attrs_json"], []).append(r["v"])
    assert lines['{"s": "a"}'] == [None, 0.2, None, 0.0]
    assert lines['{"s": "b"}'] == [None, 0.0]
    summary = facet.summary.first()
    assert (summary["rated"], summary["series_total"], summary["truncated"]) == (True, 2, 0)
    assert {r["attrs_json"]: r["series_rank"] for r in facet.series.collect()} == {'{"s": "a"}': 1, '{"s": "b"}': 2}


def test_facet_cap_and_null_kind(spark):
    rows = [dict(bucket=ago(minutes=5 * i), kind=None, attrs={"s": str(s)}, sum=1.0) for s in range(5) for i in range(s + 1)]
    empty = points(spark, [dict(name="other")])
    facet = metrics.metric_facet(facts_of(empty, rollups(spark, rows)), rollups(spark, rows), NOW, name="m", cap=2)
    assert facet.summary.first()["truncated"] == 3 and facet.summary.first()["rated"] is False
    assert {r["attrs_json"] for r in facet.points.collect()} == {'{"s": "4"}', '{"s": "3"}'}
    assert metrics.metric_facet(facts_of(empty, rollups(spark, rows)), rollups(spark, rows), NOW, name="absent").points.count() == 0


def test_histogram_series(spark):
    at = datetime(2024, 5, 1, 11, 40)
    hist = dict(kind="histogram", bounds=[10.0, 20.0])
    df = rollups(
        spark,
        [
            dict(hist, bucket=at, counts=[1, 2, 0], attrs={"s": "a"}, sum=1.0),
            dict(hist, bucket=at + timedelta(minutes=5), counts=[0, 3, 1], attrs={"s": "b"}, sum=1.0),
            dict(hist, bucket=at, bounds=[1.0], counts=[7, 7], attrs={"s": "c"}, sum=1.0),
            dict(hist, bucket=at, bounds=[1.0, 2.0], counts=[7], attrs={"s": "d"}, sum=1.0),
        ],
    )
    series = histogram_reads.histogram_series(df, NOW, name="m", base_secs=600.0)
    rows = series.collect()
    assert [(r["bucket_counts"], r["bucket_bounds"]) for r in rows] == [([1, 5, 1], [10.0, 20.0])]
    cells = histogram_reads.heatmap(series).orderBy("row").collect()
    assert cells[1]["intensity"] == pytest.approx(1.0) and 0 < cells[0]["intensity"] < 1
    assert histogram_reads.percentile_lines(series).count() == 3
    facet = histogram_reads.histogram_facet(df, NOW, name="m", base_secs=600.0)
    assert {r["attrs_json"]: r["dist"] for r in facet.series.collect()} == {
        '{"s": "a"}': [1, 2, 0], '{"s": "b"}': [0, 3, 1], '{"s": "c"}': [7, 7],
    }


def test_catalog(spark):
    rows = [dict(time=ago(seconds=i), value=None if i == 1 else i, attrs={"s": str(i % 2)}) for i in range(40)]
    rows += [
        dict(name="h", kind="histogram", time=ago(seconds=5), value=9, count=3, counts=[1, 2]),
        dict(name="h", kind="histogram", time=ago(seconds=9), value=4, count=1, counts=[0, 1]),
        dict(name="old", time=ago(days=90), value=None),
    ]
    found = {r["name"]: r for r in catalog.metric_catalog(points(spark, rows)).collect()}
    assert found["m"]["spark"][:3] == [0.0, 2.0, 3.0] and len(found["m"]["spark"]) == 29
    assert found["m"]["series_count"] == 2 and found["m"]["count_spark"] is None and found["m"]["dist"] is None
    assert (found["h"]["dist"], found["h"]["count_spark"]) == ([1, 2], [3.0, 1.0])
    assert found["old"]["spark"] is None
    listed = catalog.metric_catalog(points(spark, rows), start=ago(days=1))
    assert [r["name"] for r in listed.collect()] == ["h", "m"]
    steps = listed.select("name", catalog.counter_steps(F.col("spark")).alias("s"))
    assert {r["name"]: r["s"] for r in steps.collect()}["h"] == [5.0]


def test_dims_grouped_exemplars(spark):
    df = points(
        spark,
        [
            dict(attrs={"pod": "a", "cpu": 0}, value=1, trace="abc", span="d"),
            dict(attrs={"pod": "a"}, value=3),
            dict(attrs={"zone": "z"}, time=ago(days=3)),
        ],
    )
    assert [r["key"] for r in metrics.metric_dims(df, NOW, name="m", hours=48).collect()] == ["cpu", "pod"]
    assert [r["key"] for r in metrics.metric_dims(df, NOW, name="m").collect()] == ["cpu", "pod", "zone"]
    assert [(r["label"], r["v"]) for r in metrics.grouped_series(df, NOW, "pod", name="m").collect()] == [("a", 2.0)]
    assert [tuple(r)[2:] for r in metrics.metric_exemplars(df, NOW, name="m").collect()] == [(1.0, "abc", "d")]


def test_meta_takes_newest(spark):
    raw = points(spark, [dict(time=ago(hours=1), kind="gauge", unit="s")])
    newer = rollups(spark, [dict(bucket=ago(minutes=1), kind="sum", mono=True, unit="1", sum=1.0)])
    assert tuple(metrics.metric_meta(raw, newer).first()) == ("m", "sum", True, "1")
    assert metrics.metric_meta(raw, newer.where("false")).first()["kind"] == "gauge"


def labelled(spark, *attrs):
    import json

    rows = [("m", json.dumps(a)) for a in attrs]
    df = spark.createDataFrame(rows, "name string, attrs_json string")
    found = {r["attrs_json"]: r["label"] for r in labels.series_labels(df).collect()}
    return [found[r[1]] for r in rows]


def test_labels(spark):
    assert labelled(spark, {"k8s.node.name": "node-0"}) == ["all"]
    assert labelled(
        spark,
        {"otelcol.agent": "agent-a", "k8s.node.name": "node-0"},
        {"otelcol.agent": "agent-b", "k8s.node.name": "node-1"},
    ) == ["node.name=node-0 · otelcol.agent=agent-a", "node.name=node-1 · otelcol.agent=agent-b"]
    first = labelled(
        spark,
        {"k8s.node.name": "node-0", "k8s.container.name": "kube-proxy", "container.id": "aaaa", "k8s.pod.uid": "1"},
        {"k8s.node.name": "node-1", "k8s.container.name": "coredns", "container.id": "bbbb", "k8s.pod.uid": "2"},
    )[0]
    assert first == "node.name=node-0 · container.name=kube-proxy"
    assert labelled(spark, {"cpu": "0", "state": "idle"}, {"cpu": "1", "state": "idle"}) == ["cpu=0", "cpu=1"]
    assert labelled(spark, {"a": "1"}, {"b": "2"}) == ["a=1 · b=∅", "a=∅ · b=2"]
    assert labelled(spark, {"x.uid": "1"}, {"x.uid": "2"}) == ["x.uid=1", "x.uid=2"]
    assert labelled(spark, {"a": ""}, {}) == ["—", "—"]
