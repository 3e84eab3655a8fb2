from builders import NOW, ago, fragments

from spanloom.operators import correlate, logs


def table(spark):
    rows = [
        (ago(minutes=1), "t1", "s1", "api", 17, "disk FULL on node", fragments({"pod": "a"})),
        (ago(minutes=2), "t1", "s2", "api", 9, "all fine", fragments({"pod": 5})),
        (ago(minutes=3), None, None, "web", 9, None, fragments({"pod": "5"})),
        (ago(days=3), "t2", "s1", "web", 9, "old full", fragments({})),
    ]
    schema = (
        "time timestamp, trace_id string, span_id string, service string, severity_number int, body string, "
        "attributes map<string,string>"
    )
    return spark.createDataFrame(rows, schema)


def test_search(spark):
    df = table(spark)

    def bodies(**filters):
        return [r["body"] for r in logs.search_logs(df, NOW, **filters).collect()]

    assert bodies() == ["disk FULL on node", "all fine", None]
    assert bodies(text="full") == ["disk FULL on node"]
    assert bodies(text="full", start=ago(days=5)) == ["disk FULL on node", "old full"]
    assert bodies(text="full", start=ago(days=5), max_hours=24) == ["disk FULL on node"]
    assert bodies(trace_id="t1", span_id="s2") == ["all fine"]
    assert bodies(service="web") == [None]
    assert bodies(attr="pod=5") == [None]
    assert bodies(attr="pod") == ["disk FULL on node", "all fine", None]
    assert bodies(limit=1) == ["disk FULL on node"]


def test_correlation(spark):
    spans = spark.createDataFrame([("t1", "s1", "op", "api")], "trace_id string, span_id string, name string, service string")
    df = table(spark)
    assert [tuple(r)[2:] for r in correlate.log_counts(spans, df).collect()] == [("op", "api", 1, 1)]
    assert correlate.logs_of_spans(spans, df).first()["body"] == "disk FULL on node"
