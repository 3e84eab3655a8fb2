"""Small telemetry tables for the unit tests."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from spanloom.functions.attributes import canonical_json, series_key

NOW = datetime(2024, 5, 1, 12, 0, 0)


def ago(**delta):
    return NOW - timedelta(**delta)


def fragments(attrs):
    return {k: json.dumps(v) for k, v in (attrs or {}).items()}


def spans(spark, rows):
    """Rows of (trace, span, parent, service, name, start, duration_ms, status, attrs)."""
    data = [
        (t, s, p, svc, name, start, start + timedelta(milliseconds=ms), float(ms), status, fragments(attrs))
        for t, s, p, svc, name, start, ms, status, attrs in rows
    ]
    schema = (
        "trace_id string, span_id string, parent_span_id string, service string, name string, start_time timestamp, "
        "end_time timestamp, duration_ms double, status_code int, attributes map<string,string>"
    )
    return spark.createDataFrame(data, schema).withColumn("attrs_json", canonical_json(F.col("attributes")))


def span(t, s, p=None, svc="api", name="op", start=None, ms=10, status=0, attrs=None):
    return (t, s, p, svc, name, start or ago(minutes=1), ms, status, attrs)


def points(spark, rows):
    """Rows of dicts; missing columns take defaults."""
    data = [
        (
            r.get("time", ago(seconds=10)),
            r.get("service", "api"),
            r.get("name", "m"),
            r.get("kind", "gauge"),
            None if r.get("value", 1.0) is None else float(r.get("value", 1.0)),
            r.get("count"),
            r.get("unit"),
            r.get("mono"),
            r.get("bounds"),
            r.get("counts"),
            r.get("trace"),
            r.get("span"),
            fragments(r.get("attrs")),
        )
        for r in rows
    ]
    schema = (
        "time timestamp, service string, name string, kind string, value double, count bigint, unit string, "
        "is_monotonic boolean, bucket_bounds array<double>, bucket_counts array<bigint>, exemplar_trace_id string, "
        "exemplar_span_id string, attributes map<string,string>"
    )
    df = spark.createDataFrame(data, schema).withColumn("attrs_json", canonical_json(F.col("attributes")))
    return df.withColumn("series_key", series_key(F.col("service"), F.col("attrs_json")))


def rollups(spark, rows):
    data = [
        (
            r["bucket"], r.get("name", "m"), r.get("key", json.dumps(r.get("attrs") or {})),
            json.dumps(r.get("attrs") or {}), r.get("service", "api"), r.get("kind", "gauge"), r.get("unit"),
            r.get("mono"), r.get("count", 1), r.get("sum"), r.get("min", r.get("sum")), r.get("max", r.get("sum")),
            None, r.get("bounds"), r.get("counts"),
        )
        for r in rows
    ]
    schema = (
        "bucket timestamp, name string, series_key string, attrs_json string, service string, kind string, "
        "unit string, is_monotonic boolean, count bigint, sum double, min double, max double, avg double, "
        "bucket_bounds array<double>, bucket_counts array<bigint>"
    )
    return spark.createDataFrame(data, schema)


RULE_COLUMNS = (
    "rule_id bigint, name string, metric string, service string, comparator string, threshold double, agg string, "
    "window_secs int, enabled boolean, match_attrs map<string,string>, exclude_attrs map<string,string>, "
    "rate boolean, for_secs int, created_at timestamp"
)


def rule(rule_id=1, **over):
    base = dict(
        rule_id=rule_id, name=f"r{rule_id}", metric="m", service=None, comparator="gt", threshold=50.0, agg="avg",
        window_secs=300, enabled=True, match_attrs=None, exclude_attrs=None, rate=None, for_secs=None, created_at=NOW,
    )
    base.update(over)
    for key in ("match_attrs", "exclude_attrs"):
        base[key] = fragments(base[key]) if base[key] else None
    base["threshold"] = float(base["threshold"])
    return tuple(base.values())


def rules(spark, *rows):
    return spark.createDataFrame(list(rows), RULE_COLUMNS)
