"""OTLP/JSON export requests (one per line) to flat spans, logs and metric points."""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from spanloom.functions import attributes as at
from spanloom.functions.times import nanos_duration_ms, nanos_to_time

MAX_DEPTH = 32
CORRUPT = "_corrupt"

# 64-bit numbers arrive as strings. Nested values keep their JSON text.
ANY_VALUE = (
    "struct<stringValue:string,boolValue:boolean,intValue:string,doubleValue:string,"
    "bytesValue:string,arrayValue:string,kvlistValue:string>"
)
KEY_VALUES = f"array<struct<key:string,value:{ANY_VALUE}>>"
RESOURCE = f"struct<attributes:{KEY_VALUES}>"
EXEMPLARS = "array<struct<traceId:string,spanId:string>>"
NUMBER_POINTS = (
    f"array<struct<timeUnixNano:string,asDouble:string,asInt:string,attributes:{KEY_VALUES},exemplars:{EXEMPLARS}>>"
)
HISTOGRAM_POINTS = (
    f"array<struct<timeUnixNano:string,count:string,sum:double,explicitBounds:array<double>,"
    f"bucketCounts:array<string>,attributes:{KEY_VALUES},exemplars:{EXEMPLARS}>>"
)
SPAN = (
    "struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:int,startTimeUnixNano:string,"
    f"endTimeUnixNano:string,status:struct<code:int,message:string>,attributes:{KEY_VALUES}>"
)
LOG_RECORD = (
    "struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:int,severityText:string,"
    f"body:{ANY_VALUE},traceId:string,spanId:string,attributes:{KEY_VALUES}>"
)
METRIC = (
    f"struct<name:string,unit:string,gauge:struct<dataPoints:{NUMBER_POINTS}>,"
    f"sum:struct<isMonotonic:boolean,dataPoints:{NUMBER_POINTS}>,"
    f"histogram:struct<dataPoints:{HISTOGRAM_POINTS}>>"
)
REQUESTS = {
    "traces": f"resourceSpans array<struct<resource:{RESOURCE},scopeSpans:array<struct<spans:array<{SPAN}>>>>>",
    "logs": f"resourceLogs array<struct<resource:{RESOURCE},scopeLogs:array<struct<logRecords:array<{LOG_RECORD}>>>>>",
    "metrics": f"resourceMetrics array<struct<resource:{RESOURCE},scopeMetrics:array<struct<metrics:array<{METRIC}>>>>>",
}


def parse_requests(lines: DataFrame, signal: str, column: str = "value") -> DataFrame:
    """Text lines to a request struct; a bad line keeps its text in the corrupt column."""
    schema = f"{REQUESTS[signal]}, {CORRUPT} string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return lines.select(F.col(column).alias("raw"), F.from_json(column, schema, options).alias("request"))


def read_requests(spark: SparkSession, path: str, signal: str, spread: int | None = None) -> DataFrame:
    """Files of request lines; ``.gz`` files are inflated by the file source.

    A gzip file is one task whatever its size. ``spread`` deals the lines out to that many
    tasks before the costly parsing, which pays off for few large files.
    """
    return parse_requests(spread_lines(spark.read.text(path), spread), signal)


def spread_lines(lines: DataFrame, tasks: int | None) -> DataFrame:
    return lines.repartition(tasks) if tasks else lines


def stream_requests(spark: SparkSession, path: str, signal: str) -> DataFrame:
    return parse_requests(spark.readStream.text(path), signal)


# Bytes of a file in one row (Python gets up to 10,000 rows at a time), bytes inflated at
# once, and bytes of lines that are passed on together.
PIECE = 8 << 10
INFLATED = 256 << 10
LINES = 4 << 20


class _Body:
    """Bytes of one file, piece by piece, to complete lines; gzip is told by the first two bytes."""

    def __init__(self):
        self.rest, self.packed, self.inflate = [], None, None

    def _plain(self, piece: bytes, last: bool) -> Iterator[bytes]:
        """The piece inflated, at most ``INFLATED`` bytes at once."""
        if self.packed is None:
            self.packed = piece[:2] == b"\x1f\x8b"
        if not self.packed:
            yield piece
            return
        while piece or (last and self.inflate is not None):
            if self.inflate is None:
                # Members follow each other; zeros may lie between them.
                piece = piece.lstrip(b"\0")
                if not piece:
                    return
                self.inflate = zlib.decompressobj(16 + zlib.MAX_WBITS)
            out = self.inflate.decompress(piece, INFLATED)
            if out:
                yield out
            if self.inflate.eof:
                piece, self.inflate = self.inflate.unused_data, None
            else:
                piece = self.inflate.unconsumed_tail
                if not piece and not out:
                    if last:
                        raise EOFError("a compressed file ends before its end marker")
                    return

    def lines(self, piece: bytes, last: bool) -> Iterator[bytes]:
        for data in self._plain(piece, last):
            first, *others = data.split(b"\n")
            self.rest.append(first)
            for line in others:
                yield b"".join(self.rest).removesuffix(b"\r")
                self.rest = [line]
        if last:
            yield b"".join(self.rest)


def _lines_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(last, piece) rows in file order -> lines; one file's piece and its unfinished line are in memory."""
    body, ready, size = _Body(), [], 0
    for batch in batches:
        for last, piece in zip(batch.column("last").to_pylist(), batch.column("piece"), strict=True):
            for line in body.lines(piece.as_py(), last):
                if line:
                    ready.append(line.decode("utf-8", "replace"))
                    size += len(line)
                if size >= LINES:
                    yield pa.RecordBatch.from_arrays([pa.array(ready, pa.string())], ["value"])
                    ready, size = [], 0
            if last:
                body = _Body()
    yield pa.RecordBatch.from_arrays([pa.array(ready, pa.string())], ["value"])


def read_sniffed_requests(spark: SparkSession, path: str, signal: str) -> DataFrame:
    """Like :func:`read_requests` for files whose compression shows only in their first bytes.

    Each file is one request body, or several lines of them. Python gets a file in pieces,
    inflates them as they come and holds a piece and a line at a time; a task's JVM
    holds the file as it is stored, which Spark limits to 2 GB.
    """
    files = spark.read.format("binaryFile").load(path)
    size = F.length("content")
    at = F.explode(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(PIECE))).alias("at")
    pieces = files.select("content", at).select(
        (F.col("at") + PIECE >= size).alias("last"), F.substring("content", F.col("at") + 1, F.lit(PIECE)).alias("piece")
    )
    return parse_requests(pieces.mapInArrow(_lines_of, "value string"), signal)


def rejected_requests(requests: DataFrame) -> DataFrame:
    """Lines that did not decode, for a dead-letter table."""
    return requests.where(F.col("request")[CORRUPT].isNotNull()).select("raw", F.lit("decode").alias("reason"))


def _decoded(groups: str) -> Column:
    """The resource groups of a request that decoded.

    The check and the read happen on one lambda variable. As a filter the check would be
    pushed below the parsing and every line would be parsed several times.
    """
    kept = F.transform(
        F.array("request"), lambda r: F.when(r[CORRUPT].isNull(), r[groups])
    )
    return F.get(kept, F.lit(0))


def _plain(value, depth: int):
    """An AnyValue as plain JSON data; containers nested too deep become null."""
    for kind, content in (value or {}).items():
        if kind == "intValue":
            return int(content)
        if kind == "doubleValue":
            return float(content)
        if kind == "bytesValue":
            return base64.b64decode(content).hex()
        if kind in ("stringValue", "boolValue"):
            return content
        if kind in ("arrayValue", "kvlistValue"):
            if depth >= MAX_DEPTH:
                return None
            items = (content or {}).get("values", [])
            if kind == "arrayValue":
                return [_plain(item, depth + 1) for item in items]
            pairs = {p["key"]: _plain(p["value"], depth + 1) for p in items if p.get("value") is not None}
            return dict(sorted(pairs.items(), key=lambda p: (len(p[0].encode()), p[0].encode())))
    return None


def _nested_fragment(raw: str) -> str:
    kind, _, text = raw.partition(":")
    try:
        content = json.loads(text)
    except RecursionError:
        return "null"
    return json.dumps(_plain({kind: content}, 0), ensure_ascii=False)


@F.pandas_udf(ArrayType(StringType()))
def _nested_fragments(raws: pd.Series) -> pd.Series:
    """JSON fragments of nested values, which need recursion."""
    return raws.map(lambda items: [_nested_fragment(raw) for raw in items])


def _is_nested(value: Column) -> Column:
    return value["arrayValue"].isNotNull() | value["kvlistValue"].isNotNull()


def _scalar_fragment(value: Column) -> Column:
    number = value["doubleValue"].try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    return F.coalesce(
        at.json_string(value["stringValue"]),
        value["boolValue"].cast("string"),
        value["intValue"].try_cast("bigint").cast("string"),
        F.when(finite, number.cast("string")),
        at.json_string(F.lower(F.hex(F.unbase64(value["bytesValue"])))),
        F.lit("null"),
    )


def _nested_raw(value: Column) -> Column:
    return F.coalesce(
        F.concat(F.lit("arrayValue:"), value["arrayValue"]),
        F.concat(F.lit("kvlistValue:"), value["kvlistValue"]),
    )


def _last_of_each_key(pairs: Column) -> Column:
    """Key-values without those that a later one of the same key replaces."""
    keys = F.transform(pairs, lambda p: p["key"])
    places = F.map_from_entries(
        F.transform(F.array_distinct(keys), lambda k: F.struct(k, F.size(keys) - F.array_position(F.reverse(keys), k)))
    )
    last = F.filter(pairs, lambda p, i: places[p["key"]] == i)
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), pairs).otherwise(last)


def with_attributes(df: DataFrame, key_values: str, out: str, nested_values: bool) -> DataFrame:
    """A map of JSON fragments from a list of key-values.

    Pairs without a value are skipped and the last of equal keys wins. The texts of nested
    values, where rows may hold any, go through Python.
    """
    pairs = F.coalesce(F.col(key_values), F.array().cast(KEY_VALUES))
    valued = F.filter(pairs, lambda p: p["key"].isNotNull() & p["value"].isNotNull())
    df = df.withColumn("_pairs", valued)
    df = df.withColumn("_pairs", _last_of_each_key(F.col("_pairs")))
    if not nested_values:
        scalars = F.transform("_pairs", lambda p: F.struct(p["key"].alias("key"), _scalar_fragment(p["value"]).alias("value")))
        return df.withColumn(out, F.map_from_entries(scalars)).drop("_pairs")
    nested = F.filter("_pairs", lambda p: _is_nested(p["value"]))
    df = df.withColumn("_nested", _nested_fragments(F.transform(nested, lambda p: _nested_raw(p["value"]))))
    flat = F.filter("_pairs", lambda p: ~_is_nested(p["value"]))
    scalars = F.map_from_entries(
        F.transform(flat, lambda p: F.struct(p["key"].alias("key"), _scalar_fragment(p["value"]).alias("value")))
    )
    others = F.map_from_arrays(F.transform(nested, lambda p: p["key"]), F.col("_nested"))
    return df.withColumn(out, F.map_concat(scalars, others)).drop("_pairs", "_nested")


def _per_line(requests: DataFrame, flatten) -> DataFrame:
    """``flatten(requests, nested_values)`` for lines that may hold nested values and for the others.

    The line's text tells, before it is parsed: only lines that name an array or a list of
    key-values meet Python, the rest stays in the JVM.
    """
    nested = F.col("raw").contains("arrayValue") | F.col("raw").contains("kvlistValue")
    return flatten(requests.where(~nested), False).unionByName(flatten(requests.where(nested), True))


def _with_resource(requests: DataFrame, groups: str, default_service: str | None, nested_values: bool) -> DataFrame:
    """One row per resource group, with its attribute map and service."""
    per_group = requests.select(F.explode(_decoded(groups)).alias("g"))
    per_group = per_group.select("g", F.col("g.resource.attributes").alias("_resource_kv"))
    per_group = with_attributes(per_group, "_resource_kv", "_resource", nested_values).drop("_resource_kv")
    return per_group.withColumn("service", at.resolve_service(F.col("_resource"), default_service))


def _with_merged(df: DataFrame, key_values: str, nested_values: bool) -> DataFrame:
    df = with_attributes(df, key_values, "_own", nested_values)
    df = df.withColumn("attributes", at.merge(F.col("_resource"), F.col("_own")))
    return df.withColumn("attrs_json", at.canonical_json(F.col("attributes"))).drop("_own")


def _id(column: str) -> Column:
    return F.lower(F.coalesce(F.col(column), F.lit("")))


def _optional_id(column: str) -> Column:
    return F.nullif(_id(column), F.lit(""))


def flatten_traces(requests: DataFrame, default_service: str | None = None, received: Column | None = None) -> DataFrame:
    received = F.current_timestamp() if received is None else received
    return _per_line(requests, lambda lines, nested: _flatten_traces(lines, default_service, received, nested))


def _flatten_traces(requests: DataFrame, default_service: str | None, received: Column, nested_values: bool) -> DataFrame:
    groups = _with_resource(requests, "resourceSpans", default_service, nested_values)
    spans = groups.select("_resource", "service", F.explode("g.scopeSpans").alias("sc")).select(
        "_resource", "service", F.explode("sc.spans").alias("s")
    )
    spans = _with_merged(spans.withColumn("_kv", F.col("s.attributes")), "_kv", nested_values)
    has_status = F.col("s.status").isNotNull()
    return spans.select(
        _id("s.traceId").alias("trace_id"),
        _id("s.spanId").alias("span_id"),
        _optional_id("s.parentSpanId").alias("parent_span_id"),
        "service",
        F.coalesce("s.name", F.lit("")).alias("name"),
        F.coalesce("s.kind", F.lit(0)).alias("kind"),
        nanos_to_time(F.col("s.startTimeUnixNano"), received).alias("start_time"),
        nanos_to_time(F.col("s.endTimeUnixNano"), received).alias("end_time"),
        nanos_duration_ms(F.col("s.startTimeUnixNano"), F.col("s.endTimeUnixNano")).alias("duration_ms"),
        F.when(has_status, F.coalesce("s.status.code", F.lit(0))).alias("status_code"),
        F.nullif("s.status.message", F.lit("")).alias("status_message"),
        "attributes",
        "attrs_json",
        received.alias("ingested_at"),
    )


def flatten_logs(requests: DataFrame, default_service: str | None = None, received: Column | None = None) -> DataFrame:
    received = F.current_timestamp() if received is None else received
    return _per_line(requests, lambda lines, nested: _flatten_logs(lines, default_service, received, nested))


def _flatten_logs(requests: DataFrame, default_service: str | None, received: Column, nested_values: bool) -> DataFrame:
    groups = _with_resource(requests, "resourceLogs", default_service, nested_values)
    records = groups.select("_resource", "service", F.explode("g.scopeLogs").alias("sc")).select(
        "_resource", "service", F.explode("sc.logRecords").alias("r")
    )
    records = _with_merged(records.withColumn("_kv", F.col("r.attributes")), "_kv", nested_values)
    body = F.col("r.body")
    text = F.coalesce(body["stringValue"], _scalar_fragment(body))
    if nested_values:
        texts = F.when(_is_nested(body), F.array(_nested_raw(body))).otherwise(F.array().cast("array<string>"))
        records = records.withColumn("_body", _nested_fragments(texts))
        text = F.coalesce(body["stringValue"], F.get("_body", F.lit(0)), _scalar_fragment(body))
    own_time = F.col("r.timeUnixNano")
    nanos = F.when(F.coalesce(own_time, F.lit("0")) != "0", own_time).otherwise(F.col("r.observedTimeUnixNano"))
    return records.select(
        nanos_to_time(nanos, received).alias("time"),
        _optional_id("r.traceId").alias("trace_id"),
        _optional_id("r.spanId").alias("span_id"),
        "service",
        F.coalesce("r.severityNumber", F.lit(0)).alias("severity_number"),
        F.coalesce("r.severityText", F.lit("")).alias("severity_text"),
        F.when(body.isNotNull(), text).alias("body"),
        "attributes",
        "attrs_json",
        received.alias("ingested_at"),
    )


def flatten_metrics(requests: DataFrame, default_service: str | None = None, received: Column | None = None) -> DataFrame:
    """Gauges, sums and explicit histograms; other kinds and points without value drop out.

    All three kinds become one list of points per metric, so the input is read once.
    """
    received = F.current_timestamp() if received is None else received
    return _per_line(requests, lambda lines, nested: _flatten_metrics(lines, default_service, received, nested))


def _flatten_metrics(requests: DataFrame, default_service: str | None, received: Column, nested_values: bool) -> DataFrame:
    groups = _with_resource(requests, "resourceMetrics", default_service, nested_values)
    metrics = groups.select("_resource", "service", F.explode("g.scopeMetrics").alias("sc")).select(
        "_resource", "service", F.explode("sc.metrics").alias("m")
    )

    def number(kind: str, monotonic: Column, points: str) -> Column:
        return F.transform(
            F.col(points),
            lambda p: F.struct(
                F.lit(kind).alias("kind"),
                monotonic.cast("boolean").alias("is_monotonic"),
                p["timeUnixNano"].alias("nanos"),
                F.coalesce(p["asDouble"].try_cast("double"), p["asInt"].try_cast("bigint").cast("double")).alias("value"),
                F.lit(None).cast("bigint").alias("count"),
                F.lit(None).cast("array<double>").alias("bounds"),
                F.lit(None).cast("array<bigint>").alias("counts"),
                p["attributes"].alias("kv"),
                p["exemplars"].alias("exemplars"),
            ),
        )

    histogram = F.transform(
        F.col("m.histogram.dataPoints"),
        lambda p: F.struct(
            F.lit("histogram").alias("kind"),
            F.lit(None).cast("boolean").alias("is_monotonic"),
            p["timeUnixNano"].alias("nanos"),
            p["sum"].alias("value"),
            F.coalesce(p["count"].try_cast("bigint"), F.lit(0).cast("bigint")).alias("count"),
            p["explicitBounds"].alias("bounds"),
            F.transform(p["bucketCounts"], lambda c: c.try_cast("bigint")).alias("counts"),
            p["attributes"].alias("kv"),
            p["exemplars"].alias("exemplars"),
        ),
    )
    lists = [
        number("gauge", F.lit(None), "m.gauge.dataPoints"),
        number("sum", F.coalesce("m.sum.isMonotonic", F.lit(False)), "m.sum.dataPoints"),
        histogram,
    ]
    present = F.filter(F.array(*lists), lambda x: x.isNotNull())
    points = metrics.select(
        "_resource",
        "service",
        F.coalesce("m.name", F.lit("")).alias("name"),
        F.nullif("m.unit", F.lit("")).alias("unit"),
        F.explode(F.flatten(present)).alias("p"),
    ).where((F.col("p.kind") == "histogram") | F.col("p.value").isNotNull())
    points = _with_merged(points.withColumn("_kv", F.col("p.kv")), "_kv", nested_values)
    exemplar = F.get(F.filter("p.exemplars", lambda e: F.coalesce(e["traceId"], F.lit("")) != ""), F.lit(0))
    points = points.withColumn("_ex", exemplar)
    return points.select(
        nanos_to_time(F.col("p.nanos"), received).alias("time"),
        "service",
        "name",
        F.col("p.kind").alias("kind"),
        F.col("p.value").alias("value"),
        F.col("p.count").alias("count"),
        "unit",
        F.col("p.is_monotonic").alias("is_monotonic"),
        _non_empty("p.bounds").alias("bucket_bounds"),
        _non_empty("p.counts").alias("bucket_counts"),
        F.lower("_ex.traceId").alias("exemplar_trace_id"),
        F.nullif(F.lower("_ex.spanId"), F.lit("")).alias("exemplar_span_id"),
        "attributes",
        "attrs_json",
        at.series_key(F.col("service"), F.col("attrs_json")).alias("series_key"),
    )


def _non_empty(column: str) -> Column:
    return F.when(F.size(F.col(column)) > 0, F.col(column))


# Columns that must hold a value for a row to be stored.
REQUIRED = {
    "spans": ["trace_id", "span_id", "name", "start_time", "end_time", "duration_ms"],
    "logs": ["time"],
    "metrics": ["time", "name", "kind"],
}


def split_valid(rows: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """Rows that can be stored, and the others with a reason; one bad row costs only itself."""
    missing = F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED[table]])
    checked = rows.withColumn("_missing", missing)
    valid = checked.where(F.col("_missing") == "").drop("_missing")
    rejected = checked.where(F.col("_missing") != "")
    return valid, rejected.withColumnRenamed("_missing", "missing").withColumn("reason", F.lit("insert"))
