import base64
import gzip
import json

import pytest
from pyspark.sql import functions as F

from spanloom.plans import queries
from spanloom.sources import otlp, sample_tables


def s(text):
    return {"stringValue": text}


def kv(**pairs):
    return [{"key": k.replace("__", "."), "value": v} for k, v in pairs.items()]


def traces(resource, spans):
    return {"resourceSpans": [{"resource": {"attributes": resource}, "scopeSpans": [{"spans": spans}]}]}


def parse(spark, signal, *requests):
    lines = [(r if isinstance(r, str) else json.dumps(r),) for r in requests]
    return otlp.parse_requests(spark.createDataFrame(lines, "value string"), signal)


NANOS = "1700000000123456789"


def received():
    return F.lit("2030-01-01 00:00:00").cast("timestamp")


def test_spans(spark):
    request = traces(
        kv(service__name=s("api"), zone=s("r"), both=s("r")),
        [
            {
                "traceId": "AB01", "spanId": "CD", "parentSpanId": "", "name": "op", "kind": 2,
                "startTimeUnixNano": NANOS, "endTimeUnixNano": "1700000000123457789",
                "status": {"code": 2, "message": "boom"},
                "attributes": kv(both=s("p"), n={"intValue": "5"}) + [{"key": "novalue"}],
            },
            {"traceId": "AB01", "spanId": "CE", "parentSpanId": "CD", "startTimeUnixNano": "18446744073709551615",
             "endTimeUnixNano": "1", "status": {}},
        ],
    )
    first, second = otlp.flatten_traces(parse(spark, "traces", request), received=received()).collect()
    assert (first["trace_id"], first["span_id"], first["parent_span_id"], first["service"]) == ("ab01", "cd", None, "api")
    assert (first["kind"], first["status_code"], first["status_message"], first["duration_ms"]) == (2, 2, "boom", 0.001)
    assert first["attributes"] == {"service.name": '"api"', "zone": '"r"', "both": '"p"', "n": "5"}
    assert first["attrs_json"] == '{"n": 5, "both": "p", "zone": "r", "service.name": "api"}'
    assert first["start_time"].microsecond == 123456
    assert (second["parent_span_id"], second["name"], second["kind"], second["status_code"]) == ("cd", "", 0, 0)
    assert second["start_time"].year == 2030 and second["duration_ms"] == 0.0


def test_value_kinds(spark):
    nested = {"kvlistValue": {"values": [{"key": "nested", "value": s("y")}, {"key": "a", "value": {"boolValue": False}}]}}
    values = kv(
        s=s('x"y'), b={"boolValue": True}, i={"intValue": "42"}, d={"doubleValue": 1.5},
        by={"bytesValue": base64.b64encode(b"\xde\xad").decode()},
        arr={"arrayValue": {"values": [s("a"), {"intValue": "7"}, {}]}}, kv=nested, none={},
    )
    row = otlp.flatten_traces(parse(spark, "traces", traces(values, [{"traceId": "1", "spanId": "2"}]))).first()
    assert {k: json.loads(v) for k, v in row["attributes"].items()} == {
        "s": 'x"y', "b": True, "i": 42, "d": 1.5, "by": "dead", "arr": ["a", 7, None], "kv": {"a": False, "nested": "y"},
        "none": None,
    }
    assert json.loads(row["attrs_json"])["kv"] == {"a": False, "nested": "y"}
    assert row["attributes"]["kv"] == '{"a": false, "nested": "y"}'


def test_deep_nesting_is_cut(spark):
    value = s("leaf")
    for _ in range(60):
        value = {"arrayValue": {"values": [value]}}
    row = otlp.flatten_traces(parse(spark, "traces", traces(kv(deep=value), [{"traceId": "1", "spanId": "2"}]))).first()
    found, depth = json.loads(row["attributes"]["deep"]), 0
    while isinstance(found, list):
        found, depth = found[0], depth + 1
    assert found is None and depth == otlp.MAX_DEPTH


def test_repeated_keys(spark):
    request = traces(kv(k=s("1")) + kv(k=s("2")), [{"traceId": "1", "spanId": "2", "attributes": kv(k=s("3")) + kv(k={"intValue": "4"})}])
    assert otlp.flatten_traces(parse(spark, "traces", request)).first()["attributes"] == {"k": "4"}


def test_logs(spark):
    records = [
        {"timeUnixNano": "0", "observedTimeUnixNano": NANOS, "severityNumber": 17, "severityText": "ERROR", "body": s("plain"), "traceId": ""},
        {"timeUnixNano": NANOS, "body": {"intValue": "5"}, "traceId": "AA", "spanId": "BB"},
        {"timeUnixNano": NANOS, "body": {"kvlistValue": {"values": kv(k=s("v"))}}},
        {"timeUnixNano": NANOS},
    ]
    request = {"resourceLogs": [{"resource": {"attributes": kv(k8s__pod__name=s("pod-1"))}, "scopeLogs": [{"logRecords": records}]}]}
    rows = otlp.flatten_logs(parse(spark, "logs", request)).collect()
    assert [r["body"] for r in rows] == ["plain", "5", '{"k": "v"}', None]
    assert (rows[0]["time"], rows[0]["trace_id"], rows[0]["service"]) == (rows[1]["time"], None, "pod-1")
    assert (rows[1]["trace_id"], rows[1]["span_id"], rows[1]["severity_number"]) == ("aa", "bb", 0)


def test_metrics(spark):
    point = {"timeUnixNano": NANOS, "attributes": kv(p=s("x"))}
    metrics = [
        {"name": "g", "unit": "", "gauge": {"dataPoints": [
            {**point, "asDouble": 1.5, "exemplars": [{"spanId": "11"}, {"traceId": "AB", "spanId": ""}]}, {**point, "asInt": "7"}, point]}},
        {"name": "c", "unit": "1", "sum": {"isMonotonic": True, "dataPoints": [{**point, "asInt": "3"}]}},
        {"name": "u", "sum": {"dataPoints": [{**point, "asInt": "4"}]}},
        {"name": "h", "histogram": {"dataPoints": [
            {**point, "count": "3", "sum": 9.5, "explicitBounds": [1, 2], "bucketCounts": ["1", "2", "0"]}, {**point, "count": "0"}]}},
        {"name": "x", "exponentialHistogram": {"dataPoints": [point]}},
        {"name": "s", "summary": {"dataPoints": [point]}},
    ]
    request = {"resourceMetrics": [{"resource": {"attributes": kv(service__name=s("api"))}, "scopeMetrics": [{"metrics": metrics}]}]}
    rows = otlp.flatten_metrics(parse(spark, "metrics", request)).collect()
    found = [(r["name"], r["kind"], r["value"], r["count"], r["is_monotonic"], r["bucket_counts"]) for r in rows]
    assert found == [
        ("g", "gauge", 1.5, None, None, None),
        ("g", "gauge", 7.0, None, None, None),
        ("c", "sum", 3.0, None, True, None),
        ("u", "sum", 4.0, None, False, None),
        ("h", "histogram", 9.5, 3, None, [1, 2, 0]),
        ("h", "histogram", None, 0, None, None),
    ]
    assert (rows[0]["exemplar_trace_id"], rows[0]["exemplar_span_id"], rows[0]["unit"]) == ("ab", None, None)
    assert rows[0]["attrs_json"] == '{"p": "x", "service.name": "api"}'
    assert len({r["series_key"] for r in rows}) == 1


def test_bad_lines_and_gzip(spark, tmp_path):
    good = json.dumps(traces(kv(service__name=s("api")), [{"traceId": "1", "spanId": "2"}]))
    (tmp_path / "plain.jsonl").write_text(good + "\n{broken\n")
    (tmp_path / "packed.jsonl.gz").write_bytes(gzip.compress(good.encode()))
    requests = otlp.read_requests(spark, str(tmp_path), "traces")
    assert otlp.flatten_traces(requests).count() == 2
    assert [tuple(r) for r in otlp.rejected_requests(requests).collect()] == [("{broken", "decode")]
    bare = tmp_path / "bare"
    bare.mkdir()
    (bare / "a.bin").write_bytes(gzip.compress((good + "\n" + good).encode()))
    (bare / "b.bin").write_bytes(good.encode())
    assert otlp.flatten_traces(otlp.read_sniffed_requests(spark, str(bare), "traces")).count() == 3


def test_split_valid(spark):
    rows = spark.createDataFrame([("m", "gauge", None), ("m", "gauge", 5)], "name string, kind string, t int")
    valid, rejected = otlp.split_valid(rows.withColumn("time", F.timestamp_seconds("t")), "metrics")
    assert valid.count() == 1
    assert [(r["missing"], r["reason"]) for r in rejected.collect()] == [("time", "insert")]


@pytest.mark.parametrize("signal", ["traces", "logs", "metrics"])
def test_empty_requests(spark, signal):
    flatten = {"traces": otlp.flatten_traces, "logs": otlp.flatten_logs, "metrics": otlp.flatten_metrics}[signal]
    assert flatten(parse(spark, signal, "{}", {"resourceSpans": [], "resourceLogs": [{}], "resourceMetrics": [{}]})).count() == 0


def test_sniffed_files_come_in_pieces(spark, tmp_path, monkeypatch):
    """Lines, members and line ends across pieces; the JVM cuts at ``PIECE`` bytes, the inflater at ``INFLATED``."""
    rows = [json.dumps(traces(kv(k=s("x" * (i % 900))), [{"traceId": str(i), "spanId": "1"}]), ensure_ascii=False) for i in range(300)]
    text = "\r\n".join(rows[:150]) + "\n\n" + "\n".join(rows[150:])
    data = text.encode()
    members = gzip.compress(data[:30_001]) + b"\0" * 9_000 + gzip.compress(data[30_001:]) + b"\0\0"
    for name, content in (("plain", data), ("packed", members), ("empty", b""), ("bare", gzip.compress(b""))):
        (tmp_path / name).write_bytes(content)
    monkeypatch.setattr(otlp, "PIECE", 1_000)
    found = otlp.read_sniffed_requests(spark, str(tmp_path), "traces")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
    assert sorted(r["raw"] for r in found.collect()) == sorted(rows * 2)


def test_sniffed_pieces_are_inflated_in_bounds():
    packed = gzip.compress(b"a" * 20_000_000 + b"\n\xff")
    body = otlp._Body()
    parts = list(body._plain(packed, True))
    assert max(map(len, parts)) <= otlp.INFLATED and sum(map(len, parts)) == 20_000_002
    with pytest.raises(EOFError):
        list(otlp._Body().lines(packed[:-9], True))


def test_spans_of_the_tables_are_narrow_in_the_shuffle(spark, tmp_path):
    row = (1, 1, 3, 4, 5.0, 6.0, 0.1, 0.02, "A", "O", "2024-01-02")
    names = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_extendedprice double"
    kinds = f"{names}, l_discount double, l_tax double, l_returnflag string, l_linestatus string, day string"
    other = (1, 1, 2, 4, 5.0, 6.0, 0.1, 0.02, "A", "O", "2024-01-02")
    items = spark.createDataFrame([row, other], kinds).withColumn("l_shipdate", F.to_timestamp_ntz("day")).drop("day")
    items.write.parquet(str(tmp_path / "lineitem.parquet"))
    kept = sample_tables.spans(spark, str(tmp_path))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    shuffled = plan.split("Exchange hashpartitioning")[1]
    assert "GET /items" not in shuffled and "GET /items" in plan  # made above the shuffle
    found = kept.first()
    assert (found["trace_id"], found["span_id"], found["attrs_json"]) == ("1", "1", '{"part": 2, "http.method": "GET"}')


def test_requests_of_the_tables_are_stored_compressed_in_files_of_bounded_length(spark, monkeypatch):
    monkeypatch.setattr(queries, "FILE_LINES", 40)
    lines = spark.range(100).coalesce(1).select(F.lit(json.dumps({"resourceSpans": []})).alias("value"))
    requests = queries._received(lines, "traces")
    assert requests.count() == 100
    assert len(requests.inputFiles()) == 3 and all(name.endswith(".gz") for name in requests.inputFiles())
