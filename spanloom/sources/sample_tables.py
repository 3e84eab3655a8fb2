"""Telemetry tables derived from the driver's benchmark tables.

Row-wise projections (and one grouping for histograms), so their work grows with the
tables and no adapter sorts or ranks a whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.attributes import series_key
from spanloom.operators.traces import dedupe_spans

EPOCH_US = 1_704_067_200_000_000  # 2024-01-01 UTC
HISTOGRAM_BOUNDS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0]
ARRIVAL = [
    "ingested_at",
    "l_partkey",
    "l_suppkey",
    "l_extendedprice",
    "l_quantity",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), text, F.lit('"'))


def _object(*pairs: tuple[str, Column]) -> list[Column]:
    """The attribute map and its canonical text; pairs come in canonical order."""
    flat = [x for key, value in pairs for x in (F.lit(key), value)]
    parts = [F.concat(F.lit(f'"{key}": '), value) for key, value in pairs]
    text = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    return [F.create_map(*flat).alias("attributes"), text.alias("attrs_json")]


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items under the names of span keys and of arrival: orders are traces; keys repeat."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("trace_id"),
        F.col("l_linenumber").alias("span_id"),
        F.col("l_shipdate").cast("timestamp").alias("ingested_at"),
        *ARRIVAL[1:],
    )


def _start_us() -> Column:
    return (
        F.lit(EPOCH_US)
        + F.col("trace_id") * 60_000_000
        + (F.col("span_id") - 1).cast("bigint") * 20_000
        + F.pmod(F.col("l_partkey"), F.lit(1000)) * 10
    )


def _service() -> Column:
    area = F.when(F.col("l_returnflag") == "A", "auth").when(F.col("l_returnflag") == "N", "orders").otherwise("billing")
    tier = F.when(F.col("l_linestatus") == "O", "-api").otherwise("-db")
    return F.when(F.col("l_quantity") > 1, F.concat(area, tier))


def _as_spans(arrivals: DataFrame) -> DataFrame:
    """One span per row, derived row by row; some parents are missing. A service and start time that rows have stay."""
    n = F.col("span_id")
    parent = n - 1 - F.pmod(F.col("l_suppkey"), F.lit(2))
    start_us = _start_us()
    start = F.col("start_time") if "start_time" in arrivals.columns else F.timestamp_micros(start_us)
    duration_us = F.floor("l_extendedprice").cast("bigint")
    service = F.col("service") if "service" in arrivals.columns else _service()
    name = F.when(F.col("l_tax") < 0.03, "GET /items").when(F.col("l_tax") < 0.06, "POST /cart").otherwise("GET /checkout")
    status = F.when(F.col("l_discount") >= 0.1, 2).when(F.col("l_tax") >= 0.05, 1).otherwise(0)
    method = F.when(F.col("l_quantity") > 25, '"POST"').otherwise('"GET"')
    return arrivals.select(
        F.col("trace_id").cast("string").alias("trace_id"),
        n.cast("string").alias("span_id"),
        F.when(parent >= 1, parent.cast("string")).alias("parent_span_id"),
        service.alias("service"),
        name.alias("name"),
        (n - 1).alias("kind"),
        start.alias("start_time"),
        F.timestamp_micros(start_us + duration_us).alias("end_time"),
        (duration_us / 1000.0).alias("duration_ms"),
        status.alias("status_code"),
        F.lit(None).cast("string").alias("status_message"),
        *_object(("part", F.col("l_partkey").cast("string")), ("http.method", method)),
        "ingested_at",
        *ARRIVAL[1:],
    )


def arriving_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One span per line item."""
    return _as_spans(_arrivals(spark, sf_dir))


def span_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as they come to an ingest stream: with what tells copies and places, before the other columns are made."""
    return _arrivals(spark, sf_dir).withColumns({"service": _service(), "start_time": F.timestamp_micros(_start_us())})


def arrived(arrivals: DataFrame) -> DataFrame:
    """The spans of :func:`span_arrivals`, as they are stored."""
    return _as_spans(arrivals).drop(*ARRIVAL[1:])


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first span of each key. The texts of a span are made after its shuffle, from the narrower line item."""
    return _as_spans(dedupe_spans(_arrivals(spark, sf_dir), ARRIVAL)).drop(*ARRIVAL[1:])


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns (tied to spans) and documents, with their whole texts."""
    turn = F.col("turn")
    chat = table(spark, sf_dir, "conversations").select(
        F.timestamp_micros(F.lit(EPOCH_US) + F.col("conv_id") * 60_000_000 + turn * 1_000_000).alias("time"),
        F.col("conv_id").cast("string").alias("trace_id"),
        turn.cast("string").alias("span_id"),
        F.col("role").alias("service"),
        F.when(turn % 5 == 4, 17).otherwise(9).alias("severity_number"),
        F.lit("").alias("severity_text"),
        F.col("text").alias("body"),
        *_object(("turn", turn.cast("string")), ("origin", F.lit('"chat"'))),
    )
    written = table(spark, sf_dir, "documents").select(
        F.timestamp_micros(F.lit(EPOCH_US) + F.col("doc_id") * 30_000_000).alias("time"),
        F.lit(None).cast("string").alias("trace_id"),
        F.lit(None).cast("string").alias("span_id"),
        F.col("source").alias("service"),
        F.when(F.col("lang") == "en", 9).otherwise(13).alias("severity_number"),
        F.lit("").alias("severity_text"),
        F.col("text").alias("body"),
        *_object(("lang", _quoted(F.col("lang"))), ("n_chars", F.col("n_chars").cast("string"))),
    )
    return chat.unionByName(written)


def _point(events: DataFrame, name: str, kind: str, unit: str, **columns: Column) -> DataFrame:
    no_text, no_long = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    filled = {
        "count": no_long,
        "is_monotonic": F.lit(None).cast("boolean"),
        "bucket_bounds": F.lit(None).cast("array<double>"),
        "bucket_counts": F.lit(None).cast("array<bigint>"),
        "exemplar_trace_id": no_text,
        "exemplar_span_id": no_text,
        **columns,
    }
    attributes = filled.pop("attributes")
    points = events.select(
        F.col("ts").cast("timestamp").alias("time"),
        F.col("event_type").alias("service"),
        F.lit(name).alias("name"),
        F.lit(kind).alias("kind"),
        F.lit(unit).alias("unit"),
        *[column.alias(alias) for alias, column in filled.items()],
        *attributes,
    )
    return points.withColumn("series_key", series_key(F.col("service"), F.col("attrs_json")))


def gauge_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One gauge point per event, 500 attribute sets; errors and purchases carry an exemplar."""
    sampled = F.col("event_type").isin("error", "purchase")
    return _point(
        table(spark, sf_dir, "events"),
        "event.value",
        "gauge",
        "ms",
        value=F.col("value"),
        exemplar_trace_id=F.when(sampled, F.col("event_id").cast("string")),
        exemplar_span_id=F.when(sampled, F.lit("1")),
        attributes=_object(("k", F.get_json_object("props", "$.k")), ("type", _quoted(F.col("event_type")))),
    )


def counter_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running total seen at each event, starting over every thousand events."""
    return _point(
        table(spark, sf_dir, "events"),
        "event.total",
        "sum",
        "1",
        value=(F.col("event_id") % 1000).cast("double"),
        is_monotonic=F.lit(True),
        attributes=_object(("type", _quoted(F.col("event_type")))),
    )


def histogram_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One histogram point per event type and hour."""
    edges = [float("-inf"), *HISTOGRAM_BOUNDS, float("inf")]
    counts = [
        F.count_if((F.col("value") > lo) & (F.col("value") <= hi)).alias(f"c{i}")
        for i, (lo, hi) in enumerate(zip(edges, edges[1:]))
    ]
    hourly = (
        table(spark, sf_dir, "events")
        .groupBy("event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts"))
        .agg(F.sum("value").alias("total"), F.count("*").alias("n"), *counts)
    )
    return _point(
        hourly,
        "event.size",
        "histogram",
        "By",
        value=F.col("total"),
        count=F.col("n"),
        bucket_bounds=F.array(*[F.lit(b) for b in HISTOGRAM_BOUNDS]),
        bucket_counts=F.array(*[F.col(f"c{i}") for i in range(len(edges) - 1)]),
        attributes=_object(("type", _quoted(F.col("event_type")))),
    )


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = gauge_points(spark, sf_dir).unionByName(counter_points(spark, sf_dir))
    return numbers.unionByName(histogram_points(spark, sf_dir), allowMissingColumns=True)


# Watch rules over the derived metrics: every aggregate, both comparators, every option.
RULES = [
    (1, "mean value high", "event.value", None, "gt", 24.0, "avg", 21600, True, None, None, None, None),
    (2, "error peak", "event.value", None, "gt", 60.0, "max", 86400, True, {"type": '"error"'}, None, None, 7200),
    (3, "floor low", "event.value", None, "lt", 0.05, "min", 21600, True, None, {"type": '"view"'}, None, None),
    (4, "clicks quiet", "event.value", "click", "lt", 300.0, "sum", 21600, True, None, None, None, 3600),
    (5, "newest value", "event.value", None, "gt", 20.0, "last", 3600, True, None, None, None, None),
    (6, "event rate", "event.total", None, "gt", 0.004, "avg", 86400, True, None, None, None, None),
    (7, "purchases rising", "event.total", "purchase", "gt", 80.0, "increase", 21600, True, None, None, None, None),
    (8, "total level", "event.total", None, "gt", 900.0, "max", 21600, True, None, None, False, 3600),
    (9, "switched off", "event.value", None, "gt", 0.0, "max", 3600, False, None, None, None, None),
]
RULE_SCHEMA = (
    "rule_id bigint, name string, metric string, service string, comparator string, threshold double, agg string, "
    "window_secs int, enabled boolean, match_attrs map<string,string>, exclude_attrs map<string,string>, "
    "rate boolean, for_secs int"
)


def rules(spark: SparkSession) -> DataFrame:
    declared = spark.createDataFrame(RULES, RULE_SCHEMA)
    return declared.withColumn("created_at", F.timestamp_micros(F.lit(EPOCH_US) + F.col("rule_id") * 1_000_000))
