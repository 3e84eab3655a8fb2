from datetime import timedelta

import pytest
from builders import NOW, ago, span, spans

from spanloom.operators import services, traces
from spanloom.operators.ordering import sort_table


def ids(df, column="trace_id"):
    return sorted(r[column] for r in df.collect())


def test_summary_counts(spark):
    df = spans(spark, [span("t", "a", start=ago(seconds=2)), span("t", "b", "a", status=2, start=ago(seconds=1))])
    row = traces.summarize_traces(df, NOW).first()
    assert (row["span_count"], row["error_count"], row["root_name"]) == (2, 1, "op")
    assert row["duration_ms"] == 1010.0


def test_filters(spark):
    df = spans(
        spark,
        [
            span("tf", "1", name="GET list", ms=10, attrs={"http.method": "GET"}),
            span("ts", "2", name="POST checkout", ms=500, attrs={"http.method": "POST"}),
            span("te", "3", name="POST pay", ms=50, status=2, attrs={"http.method": "POST"}),
        ],
    )

    def search(**filters):
        return ids(traces.search_traces(df, NOW, **filters))

    assert search(name="checkout") == ["ts"]
    assert search(errors_only=True) == ["te"]
    assert search(min_duration_ms=100) == ["ts"]
    assert search(attr="http.method=GET") == ["tf"]
    assert search(attr="http.method=POST", min_duration_ms=100) == ["ts"]
    assert search(attr="broken") == ["te", "tf", "ts"]
    assert search(limit=1) and len(search(limit=1)) == 1


def test_attribute_keeps_whole_trace_and_filters_apply_before_grouping(spark):
    df = spans(
        spark,
        [
            span("t", "1", svc="web", start=ago(days=3), attrs={"k": "v"}),
            span("t", "2", "1", svc="api", start=ago(seconds=5)),
            span("t", "3", "1", svc="db", start=ago(seconds=4), status=2),
        ],
    )
    row = traces.summarize_traces(df, NOW, attr="k=v").first()
    assert (row["span_count"], row["error_count"]) == (2, 1)
    assert traces.summarize_traces(df, NOW, service="api").first()["error_count"] == 0


def test_windows(spark):
    df = spans(spark, [span("new", "1", start=ago(seconds=30)), span("old", "2", start=ago(days=3))])
    assert ids(traces.search_traces(df, NOW)) == ["new"]
    assert ids(traces.search_traces(df, NOW, start=ago(hours=1))) == ["new"]
    assert ids(traces.search_traces(df, NOW, start=ago(days=30), max_hours=48)) == ["new"]
    assert ids(traces.search_traces(df, NOW, start=ago(days=30))) == ["new", "old"]
    assert ids(traces.search_traces(df, NOW, start=ago(days=5), end=ago(days=1))) == ["old"]
    years = spans(spark, [span(str(i), "1", start=ago(days=100 * i)) for i in range(1, 12)])
    assert len(ids(traces.search_traces(years, NOW, start=ago(days=1100)))) == 11


def test_trace_spans_in_order(spark):
    df = spans(spark, [span("t", "b", start=ago(seconds=1)), span("t", "a", start=ago(seconds=10)), span("x", "c")])
    assert [r["span_id"] for r in traces.trace_spans(df, "t").collect()] == ["a", "b"]


def test_dedupe_keeps_first(spark):
    rows = [span("t", str(i), ms=i + 1, start=ago(seconds=200 - i)) for i in range(100)]
    df = spans(spark, rows + [span("t", "5", ms=999, start=ago(seconds=1))])
    kept = traces.dedupe_spans(df, ["start_time"])
    assert kept.count() == 100
    assert kept.where("span_id = '5'").first()["duration_ms"] == 6.0
    stored = df.where("span_id in ('1', '2')")
    assert traces.dedupe_spans(df, ["start_time"], stored).count() == 98


def test_red(spark):
    rows = [span("t", str(i), ms=ms, status=2 if i == 0 else 0) for i, ms in enumerate((10, 20, 30, 40))]
    df = spans(spark, rows + [span("t", "n", svc=None)])
    row = services.ranked_red(df, NOW).first()
    assert (row["service"], row["spans"], row["errors"], row["error_rate"], row["p50_ms"]) == ("api", 4, 1, 0.25, 25.0)
    assert row["p95_ms"] == pytest.approx(38.5)
    near = services.red_by_service(df, NOW, approx=True).first()
    assert near["p50_ms"] in (20.0, 30.0)


def test_service_map(spark):
    df = spans(
        spark,
        [
            span("t", "1", svc="web", start=ago(hours=5)),
            span("t", "2", "1", svc="api"),
            span("t", "3", "1", svc="api"),
            span("t", "4", "2", svc="api"),
            span("t", "5", "2", svc=None),
            span("u", "6", "1", svc="db"),
            span("v", "7", svc="edge", start=NOW - timedelta(hours=1)),
        ],
    )
    assert [tuple(r) for r in services.service_edges(df, NOW).collect()] == [("web", "api", 2)]
    # Strictly later than an hour ago.
    assert ids(services.service_nodes(df, NOW), "service") == ["api", "db"]
    assert ids(services.service_list(df, NOW), "service") == ["api", "db", "edge", "web"]


def test_table_sort(spark):
    df = spark.createDataFrame([(1,), (None,), (10,)], "n int")
    assert [r["n"] for r in sort_table(df, "n", descending=False).collect()] == [1, 10, None]
    assert [r["n"] for r in sort_table(df, "n").collect()] == [None, 10, 1]
