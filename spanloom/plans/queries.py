"""One callable per operator: (spark, sf_dir) -> DataFrame over the whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, TimestampType

from spanloom import params, schemas
from spanloom.functions import predicates, sqlfunctions
from spanloom.functions.times import newest
from spanloom.operators import (
    alert_views,
    alerts,
    backtest,
    catalog,
    correlate,
    health,
    histogram_reads,
    labels,
    logs,
    metric_facts,
    metrics,
    retention,
    rollups,
    rule_admin,
    services,
    trace_tree,
    traces,
)
from spanloom.session import configure, ensure_checkpoint_dir
from spanloom.sources import fact_store, otlp, storage
from spanloom.sources import rules as rules_source
from spanloom.sources import sample_tables as sample
from spanloom.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

EPOCH = datetime(2024, 1, 1)
TICK_SECS = 3600
ALL_TIME = {"start": EPOCH}
# Requests in a file; a gzip file is read by one task.
FILE_LINES = 250_000
# Requests in a file of whole texts that is read as one body.
BODY_LINES = 10_000


def _plain(df: DataFrame) -> DataFrame:
    """Result columns in forms that compare across engines: zone-free times, rounded
    doubles, arrays as text."""
    out = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, TimestampType):
            column = column.cast("timestamp_ntz")
        elif isinstance(field.dataType, DoubleType):
            column = F.round(column, 9)
        elif isinstance(field.dataType, ArrayType):
            column = F.array_join(F.transform(column, lambda x: x.cast("string")), ",")
        out.append(column.alias(field.name))
    return df.select(*out)


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return _plain(fn(spark, sf_dir))

    REGISTRY[fn.__name__] = run
    return fn


def _span_now(spark, sf_dir) -> datetime:
    return newest(sample.arriving_spans(spark, sf_dir), "start_time")


def _event_now(spark, sf_dir) -> datetime:
    return newest(sample.table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("t")), "t")


def _log_now(spark, sf_dir) -> datetime:
    return newest(sample.logs(spark, sf_dir), "time")


def _rollups(spark, sf_dir) -> DataFrame:
    return rollups.rollup_points(sample.metrics(spark, sf_dir))


_facts_paths: dict[tuple[str, str], str] = {}


def _facts(spark, sf_dir) -> DataFrame:
    """The kept facts of the metric points, folded once per session as an ingest would."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _facts_paths:
        path = f"{_folder(spark)}/facts"
        fact_store.keep(metric_facts.facts_of(sample.metrics(spark, sf_dir)), path)
        _facts_paths[key] = path
    return fact_store.read(spark, _facts_paths[key])


# --- traces and services ---------------------------------------------------


@query
def red_by_service(spark, sf_dir):
    return services.ranked_red(sample.spans(spark, sf_dir), _span_now(spark, sf_dir), **ALL_TIME)


def _summary(spark, sf_dir, **filters):
    now = _span_now(spark, sf_dir)
    return traces.summarize_traces(sample.spans(spark, sf_dir), now, **ALL_TIME, **filters)


@query
def trace_summary(spark, sf_dir):
    return _summary(spark, sf_dir)


@query
def trace_summary_errors(spark, sf_dir):
    return _summary(spark, sf_dir, errors_only=True)


@query
def trace_summary_slow(spark, sf_dir):
    return _summary(spark, sf_dir, min_duration_ms=120.0)


@query
def trace_summary_attr(spark, sf_dir):
    return _summary(spark, sf_dir, attr="http.method=POST")


@query
def trace_summary_name(spark, sf_dir):
    return _summary(spark, sf_dir, name="CART")


@query
def trace_summary_service(spark, sf_dir):
    return _summary(spark, sf_dir, service="orders-api")


@query
def trace_search(spark, sf_dir):
    now = _span_now(spark, sf_dir)
    return traces.search_traces(sample.spans(spark, sf_dir), now, **ALL_TIME, limit=100)


@query
def trace_spans(spark, sf_dir):
    newest_trace = sample.arriving_spans(spark, sf_dir).agg(F.max_by("trace_id", F.struct("start_time", "trace_id")))
    found = traces.trace_spans(sample.spans(spark, sf_dir), newest_trace.first()[0])
    return found.drop("attributes", "status_message")


@query
def span_dedupe(spark, sf_dir):
    return sample.spans(spark, sf_dir).drop("attributes", "status_message")


@query
def service_nodes(spark, sf_dir):
    return services.service_nodes(sample.spans(spark, sf_dir), _span_now(spark, sf_dir), start=EPOCH)


@query
def service_list(spark, sf_dir):
    return services.service_list(sample.spans(spark, sf_dir), _span_now(spark, sf_dir), **ALL_TIME)


@query
def service_edges(spark, sf_dir):
    return services.service_edges(sample.spans(spark, sf_dir), _span_now(spark, sf_dir), start=EPOCH)


@query
def span_labels(spark, sf_dir):
    return sample.spans(spark, sf_dir).groupBy(
        predicates.span_kind_label(F.col("kind")).alias("kind"),
        predicates.status_label(F.col("status_code")).alias("status"),
    ).agg(F.count("*").alias("spans"))


# --- trace trees -----------------------------------------------------------


@query
def trace_links(spark, sf_dir):
    return trace_tree.link_tree(sample.spans(spark, sf_dir)).select("trace_id", "span_id", "parent")


@query
def trace_tree_order(spark, sf_dir):
    return trace_tree.waterfall_order(trace_tree.analyze_trees(sample.spans(spark, sf_dir)))


@query
def trace_critical_path(spark, sf_dir):
    return trace_tree.critical_paths(trace_tree.analyze_trees(sample.spans(spark, sf_dir)))


@query
def trace_error_spans(spark, sf_dir):
    spans = sample.spans(spark, sf_dir)
    return trace_tree.error_spans(trace_tree.analyze_trees(spans), spans)


@query
def trace_ancestors(spark, sf_dir):
    return trace_tree.filter_with_ancestors(sample.spans(spark, sf_dir), "checkout", errors_only=True)


@query
def trace_geometry(spark, sf_dir):
    return trace_tree.bar_geometry(sample.spans(spark, sf_dir))


# --- logs ------------------------------------------------------------------


@query
def log_search(spark, sf_dir):
    now = _log_now(spark, sf_dir)
    found = logs.search_logs(sample.logs(spark, sf_dir), now, **ALL_TIME, text="tion_", limit=200)
    return found.drop("attributes", "severity_text")


@query
def log_text_filter(spark, sf_dir):
    now = _log_now(spark, sf_dir)
    found = logs.filter_logs(sample.logs(spark, sf_dir), now, **ALL_TIME, text="the")
    return found.select("time", "service", "severity_number", "body", "attrs_json")


@query
def log_attr_filter(spark, sf_dir):
    now = _log_now(spark, sf_dir)
    found = logs.filter_logs(sample.logs(spark, sf_dir), now, **ALL_TIME, service="assistant", attr="origin=chat")
    return found.select("time", "trace_id", "span_id", "body")


@query
def log_severity(spark, sf_dir):
    rows = sample.logs(spark, sf_dir)
    severity = predicates.severity_class(F.col("severity_number")).alias("severity")
    return rows.groupBy("service", severity).agg(F.count("*").alias("records"))


@query
def log_span_correlation(spark, sf_dir):
    return correlate.log_counts(sample.spans(spark, sf_dir), sample.logs(spark, sf_dir))


@query
def log_rows_of_spans(spark, sf_dir):
    rows = correlate.logs_of_spans(sample.spans(spark, sf_dir), sample.logs(spark, sf_dir))
    return rows.select("time", "trace_id", "span_id", "body", "span_name", "span_service")


# --- rollups and metric reads ----------------------------------------------


def _rollup_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "bucket", "name", "series_key", "attrs_json", "service", "kind", "unit", "is_monotonic",
        "count", "sum", "min", "max", "avg", "bucket_bounds", "bucket_counts",
    )


@query
def metric_rollup_numbers(spark, sf_dir):
    points = sample.gauge_points(spark, sf_dir).unionByName(sample.counter_points(spark, sf_dir))
    return _rollup_columns(rollups.rollup_points(points)).drop("bucket_bounds", "bucket_counts")


@query
def metric_rollup_hist(spark, sf_dir):
    return _rollup_columns(rollups.rollup_points(sample.histogram_points(spark, sf_dir), 86400.0))


@query
def rollup_merge(spark, sf_dir):
    """Three interleaved batches folded apart and merged: equal to one pass."""
    points = sample.metrics(spark, sf_dir)
    batch = F.pmod(F.unix_seconds("time"), F.lit(3))
    parts = [
        rollups.merge_rollups(rows_of).withColumn("batch_id", F.lit(i))
        for i, rows_of in enumerate(
            rollups.as_rollup_rows(points.where(batch == i), 86400.0) for i in range(3)
        )
    ]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return _rollup_columns(rollups.merge_rollups(merged, version="batch_id"))


@query
def metric_series(spark, sf_dir):
    return metrics.metric_series(_rollups(spark, sf_dir), _event_now(spark, sf_dir), **ALL_TIME)


@query
def metric_series_service(spark, sf_dir):
    now = _event_now(spark, sf_dir)
    return metrics.metric_series(_rollups(spark, sf_dir), now, name="event.value", service="click", **ALL_TIME)


@query
def metric_grouped(spark, sf_dir):
    now = _event_now(spark, sf_dir)
    return metrics.grouped_series(sample.metrics(spark, sf_dir), now, "k", name="event.value", **ALL_TIME)


@query
def metric_dims(spark, sf_dir):
    return metrics.metric_dims(sample.metrics(spark, sf_dir), _event_now(spark, sf_dir))


@query
def metric_exemplars(spark, sf_dir):
    now = _event_now(spark, sf_dir)
    return metrics.metric_exemplars(
        sample.metrics(spark, sf_dir), now, name="event.value", start=EPOCH
    )


@query
def exemplar_spans(spark, sf_dir):
    now = _event_now(spark, sf_dir)
    points = metrics.metric_exemplars(
        sample.metrics(spark, sf_dir), now, name="event.value", start=EPOCH
    )
    return correlate.exemplar_spans(points, sample.spans(spark, sf_dir))


@query
def metric_meta(spark, sf_dir):
    return metrics.metric_meta(sample.metrics(spark, sf_dir), _rollups(spark, sf_dir))


@query
def sql_functions(spark, sf_dir):
    """The registered SQL functions inside a plain SQL aggregation."""
    sqlfunctions.register(spark)
    sample.histogram_points(spark, sf_dir).createOrReplaceTempView("size_points")
    return spark.sql(
        """
        SELECT metric_bucket(time, 86400.0D) AS day, metric_series_key(service, attrs_json) AS series_key,
               min(array_add(bucket_counts, array(1L))[0]) AS least_first, count(*) AS hours
        FROM size_points GROUP BY 1, 2
        """
    )


@query
def spans_in_window(spark, sf_dir):
    """Spans started inside a chart's window, per service."""
    window = params.Window(EPOCH, _event_now(spark, sf_dir))
    found = correlate.spans_in_window(sample.spans(spark, sf_dir), window)
    return found.groupBy("service").agg(F.count("*").alias("spans"), F.max("end_time").alias("last_end"))


def _facet(spark, sf_dir, name=None, **options):
    now = _event_now(spark, sf_dir)
    return metrics.metric_facet(
        _facts(spark, sf_dir), _rollups(spark, sf_dir), now, name=name, **ALL_TIME, **options
    )


@query
def metric_facet_gauge(spark, sf_dir):
    return _facet(spark, sf_dir, "event.value").points


@query
def metric_facet_rate(spark, sf_dir):
    return _facet(spark, sf_dir, "event.total").points


@query
def metric_facet_chart(spark, sf_dir):
    return _facet(spark, sf_dir, "event.value", cap=params.CHART_CAP).points


@query
def metric_facet_summary(spark, sf_dir):
    return _facet(spark, sf_dir, cap=params.CHART_CAP).summary


@query
def metric_latest(spark, sf_dir):
    return metrics.latest_values(_facet(spark, sf_dir).points, ["v"])


@query
def series_labels(spark, sf_dir):
    return labels.series_labels(_rollups(spark, sf_dir))


def _distribution(spark, sf_dir):
    return histogram_reads.histogram_series(_rollups(spark, sf_dir), _event_now(spark, sf_dir), **ALL_TIME)


@query
def metric_histogram(spark, sf_dir):
    return _distribution(spark, sf_dir)


@query
def hist_heatmap(spark, sf_dir):
    return histogram_reads.heatmap(_distribution(spark, sf_dir))


@query
def hist_percentile_lines(spark, sf_dir):
    return histogram_reads.percentile_lines(_distribution(spark, sf_dir))


def _hist_facet(spark, sf_dir):
    return histogram_reads.histogram_facet(_rollups(spark, sf_dir), _event_now(spark, sf_dir), **ALL_TIME)


@query
def metric_hist_facet(spark, sf_dir):
    return _hist_facet(spark, sf_dir).points


@query
def metric_hist_dist(spark, sf_dir):
    return _hist_facet(spark, sf_dir).series.select("name", "attrs_json", "n_points", "dist")


@query
def metric_catalog(spark, sf_dir):
    return catalog.metric_catalog(sample.metrics(spark, sf_dir)).withColumns(
        {c: F.transform(c, lambda x: F.round(x, 6)) for c in ("spark", "count_spark")}
    )


@query
def catalog_counter_glyph(spark, sf_dir):
    listed = catalog.metric_catalog(sample.metrics(spark, sf_dir))
    steps = F.transform(catalog.counter_steps(F.col("spark")), lambda x: F.round(x, 6))
    return listed.select("name", steps.alias("steps"))


# --- alerts ----------------------------------------------------------------


@query
def alert_eval(spark, sf_dir):
    now = _event_now(spark, sf_dir)
    found = alerts.evaluate_rules(sample.rules(spark), sample.metrics(spark, sf_dir), now, _facts(spark, sf_dir))
    return found.select("rule_id", "value", "breached", "attributes")


@query
def alert_series(spark, sf_dir):
    now = _event_now(spark, sf_dir)
    found = alerts.evaluate_series(sample.rules(spark), sample.metrics(spark, sf_dir), now, _facts(spark, sf_dir))
    return found.select("rule_id", "series_key", "attrs_json", "series_value")


@query
def alert_ticks(spark, sf_dir):
    now = _event_now(spark, sf_dir)
    points, facts = sample.metrics(spark, sf_dir), _facts(spark, sf_dir)
    return backtest.tick_values(sample.rules(spark), points, EPOCH, now, facts, TICK_SECS)


@query
def alert_ticks_fine(spark, sf_dir):
    """Every 30 seconds of the last two days; the rules look back for up to a day."""
    now = _event_now(spark, sf_dir)
    points, facts = sample.metrics(spark, sf_dir), _facts(spark, sf_dir)
    return backtest.tick_values(sample.rules(spark), points, now - timedelta(days=2), now, facts)


def _events(spark, sf_dir):
    now = _event_now(spark, sf_dir)
    points, facts = sample.metrics(spark, sf_dir), _facts(spark, sf_dir)
    return backtest.backtest(sample.rules(spark), points, EPOCH, now, facts, TICK_SECS)


@query
def alert_backtest(spark, sf_dir):
    return _events(spark, sf_dir)


@query
def alert_list(spark, sf_dir):
    return alert_views.list_alerts(sample.rules(spark), _events(spark, sf_dir), _facts(spark, sf_dir))


@query
def alert_events_feed(spark, sf_dir):
    return alert_views.event_feed(_events(spark, sf_dir), sample.rules(spark), _facts(spark, sf_dir))


@query
def alert_history(spark, sf_dir):
    return alert_views.rule_history(_events(spark, sf_dir), _event_now(spark, sf_dir))


@query
def alert_firing_count(spark, sf_dir):
    listed = alert_views.list_alerts(sample.rules(spark), _events(spark, sf_dir), _facts(spark, sf_dir))
    return alert_views.firing_count(listed)


def _step(spark, sf_dir):
    """Events open at the last grid tick, advanced by one evaluation at the newest event."""
    now = _event_now(spark, sf_dir)
    evaluated = alerts.evaluate_rules(sample.rules(spark), sample.metrics(spark, sf_dir), now, _facts(spark, sf_dir))
    return alerts.alert_step(evaluated, _events(spark, sf_dir), now)


@query
def alert_step_events(spark, sf_dir):
    return _step(spark, sf_dir)[0]


@query
def alert_step_transitions(spark, sf_dir):
    return _step(spark, sf_dir)[1]


def _stored_rules(spark, sf_dir):
    supplier = sample.table(spark, sf_dir, "supplier")
    return supplier.select(
        F.col("s_suppkey").alias("rule_id"),
        F.concat(F.lit("balance-"), (F.col("s_suppkey") * 20).cast("string")).alias("name"),
        F.col("s_acctbal").alias("threshold"),
        F.lit(EPOCH).cast("timestamp").alias("created_at"),
    )


def _declared_rules(spark, sf_dir):
    customer = sample.table(spark, sf_dir, "customer")
    empty_map = F.lit(None).cast("map<string,string>")
    return customer.select(
        F.concat(F.lit("balance-"), F.col("c_custkey").cast("string")).alias("name"),
        F.lit("account.balance").alias("metric"),
        F.col("c_mktsegment").alias("service"),
        F.lit("lt").alias("comparator"),
        F.col("c_acctbal").alias("threshold"),
        F.lit("last").alias("agg"),
        F.lit(300).alias("window_secs"),
        F.lit(True).alias("enabled"),
        empty_map.alias("match_attrs"),
        empty_map.alias("exclude_attrs"),
        F.lit(None).cast("boolean").alias("rate"),
        F.lit(None).cast("int").alias("for_secs"),
    )


@query
def rules_reconcile(spark, sf_dir):
    created = F.lit(EPOCH + timedelta(days=1)).cast("timestamp")
    merged = rule_admin.reconcile_rules(_declared_rules(spark, sf_dir), _stored_rules(spark, sf_dir), created)
    return merged.select("rule_id", "name", "service", "threshold", "created_at")


@query
def rules_removed(spark, sf_dir):
    return rule_admin.removed_rules(_declared_rules(spark, sf_dir), _stored_rules(spark, sf_dir))


# --- upkeep ----------------------------------------------------------------


@query
def retention_prune(spark, sf_dir):
    tables = {
        "spans": sample.spans(spark, sf_dir),
        "logs": sample.logs(spark, sf_dir),
        "metrics": sample.metrics(spark, sf_dir),
        "metric_series_rollups": _rollups(spark, sf_dir),
    }
    now = _event_now(spark, sf_dir)
    kept = retention.prune(tables, now, days=7, raw_hours=6, windows=retention.Windows(spans_days=23, logs_days=0))
    counts = [df.agg(F.count("*").alias("kept")).select(F.lit(t).alias("table_name"), "kept") for t, df in kept.items()]
    out = counts[0]
    for part in counts[1:]:
        out = out.unionByName(part)
    return out


@query
def table_health(spark, sf_dir):
    return health.table_figures(
        sample.spans(spark, sf_dir),
        sample.logs(spark, sf_dir),
        sample.metrics(spark, sf_dir),
        _rollups(spark, sf_dir),
        _event_now(spark, sf_dir),
    )


# --- streams and sweeps over stored tables ----------------------------------

ONCE = {"availableNow": True}


def _folder(spark) -> str:
    """A new folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"


def _as_stream(df: DataFrame, folder: str) -> DataFrame:
    """The rows as files, read again as a stream of several batches. A batch has few files, and a task reads a row group."""
    df.write.option("parquet.block.size", storage.ASIDE_GROUP).parquet(f"{folder}/in")
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")


@query
def span_ingest_stream(spark, sf_dir):
    """All spans, copies included, through the ingest stream: each key is stored once."""
    folder = _folder(spark)
    rows = _as_stream(sample.span_arrivals(spark, sf_dir), folder)
    paths = (f"{folder}/out", f"{folder}/c")
    ingest.start_span_ingest(rows, *paths, sample.ARRIVAL, ONCE, sample.arrived).awaitTermination()
    stored = storage.read_table(spark, f"{folder}/out", schemas.SPANS)
    return stored.select("trace_id", "span_id").groupBy("trace_id").agg(
        F.count("*").alias("spans"), F.count_distinct("span_id").alias("distinct_spans")
    )


@query
def span_copies_stream(spark, sf_dir):
    """All spans, then all of them again with other start days, by another stream: nothing is stored twice."""
    folder = _folder(spark)
    rows = sample.span_arrivals(spark, sf_dir)
    later = F.col("start_time") + F.expr("INTERVAL 3 DAYS")
    for k, part in enumerate((rows, rows.withColumn("start_time", later))):
        source = _as_stream(part, f"{folder}/{k}")
        paths = (f"{folder}/out", f"{folder}/c{k}")
        ingest.start_span_ingest(source, *paths, sample.ARRIVAL, ONCE, sample.arrived).awaitTermination()
    stored = storage.read_table(spark, f"{folder}/out", schemas.SPANS)
    return stored.groupBy("trace_id").agg(F.count("*").alias("spans"), F.count_distinct("span_id").alias("distinct_spans"))


@query
def log_ingest_stream(spark, sf_dir):
    folder = _folder(spark)
    rows = _as_stream(sample.logs(spark, sf_dir).withColumn("ingested_at", F.col("time")), folder)
    ingest.start_log_ingest(rows, f"{folder}/out", f"{folder}/c", ONCE).awaitTermination()
    stored = storage.read_table(spark, f"{folder}/out", schemas.LOGS)
    return stored.groupBy("service", "severity_number").agg(
        F.count("*").alias("records"), F.min("time").alias("oldest"), F.max("time").alias("newest")
    )


@query
def metric_ingest_stream(spark, sf_dir):
    """The rollups that the metric stream keeps, merged: equal to those of one pass."""
    folder = _folder(spark)
    rows = _as_stream(sample.metrics(spark, sf_dir), folder)
    ingest.start_metric_ingest(rows, f"{folder}/raw", f"{folder}/out", f"{folder}/c", ONCE, 86400.0).awaitTermination()
    return _rollup_columns(storage.read_rollups(spark, f"{folder}/out"))


@query
def metric_facts_stream(spark, sf_dir):
    """The facts that the metric stream keeps, batch after batch, and what reads take from them."""
    folder = _folder(spark)
    rows = _as_stream(sample.metrics(spark, sf_dir), folder)
    paths = (f"{folder}/raw", f"{folder}/out", f"{folder}/c")
    ingest.start_metric_ingest(rows, *paths, ONCE, 86400.0, facts_path=f"{folder}/facts").awaitTermination()
    kept = fact_store.read(spark, f"{folder}/facts")
    times = kept.groupBy("name").agg(F.max("last_time").alias("last_time"), F.max("last_valued").alias("last_valued"))
    return metric_facts.newest_meta(kept).join(metric_facts.counters(kept), "name").join(times, "name")


@query
def retention_sweep(spark, sf_dir):
    """The four tables written, swept and read back; figures as in ``retention_prune``."""
    folder = _folder(spark)
    tables = {
        "spans": sample.spans(spark, sf_dir),
        "logs": sample.logs(spark, sf_dir),
        "metrics": sample.metrics(spark, sf_dir),
        "metric_series_rollups": _rollups(spark, sf_dir),
    }
    paths = {name: f"{folder}/{name}" for name in tables}
    for name, rows in tables.items():
        storage.append_batch(rows, name, paths[name], 0)
    now = _event_now(spark, sf_dir)
    retention.sweep(spark, paths, now, 7, 6, retention.Windows(spans_days=23, logs_days=0))
    kinds = (schemas.SPANS, schemas.LOGS, schemas.METRICS, schemas.ROLLUPS)
    counts = [
        storage.read_table(spark, path, kind).agg(F.count("*").alias("kept")).select(F.lit(name).alias("table_name"), "kept")
        for (name, path), kind in zip(paths.items(), kinds, strict=True)
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


# --- ingest: the tables as OTLP/JSON requests, flattened again --------------


def _kv(key: str, field: str, value):
    fields = [
        (value if f == field else F.lit(None).cast("string")).alias(f) for f in ("stringValue", "intValue")
    ]
    return F.struct(F.lit(key).alias("key"), F.struct(*fields).alias("value"))


def _request(df: DataFrame, top: str, scope: str, resource, item: str, record) -> DataFrame:
    scoped = F.array(F.struct(F.array(record).alias(item)))
    group = F.struct(F.struct(F.array(resource).alias("attributes")).alias("resource"), scoped.alias(scope))
    return df.select(F.to_json(F.struct(F.array(group).alias(top))).alias("value"))


def _received(lines: DataFrame, signal: str) -> DataFrame:
    """The requests as an exporter leaves them, in compressed text files of bounded length, read and parsed."""
    folder = f"{_folder(lines.sparkSession)}/requests"
    lines.write.option("compression", "gzip").option("maxRecordsPerFile", FILE_LINES).text(folder)
    return otlp.read_requests(lines.sparkSession, folder, signal)


def _nanos(time: str, extra=0):
    return ((F.unix_micros(time) + extra) * 1000).cast("string")


@query
def otlp_metrics(spark, sf_dir):
    """Every event as a request with a gauge point."""
    events = sample.table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    attributes = F.array(
        _kv("k", "intValue", F.get_json_object("props", "$.k")), _kv("user", "stringValue", F.col("user_id").cast("string"))
    )
    exemplar = F.array(F.struct(F.lpad(F.hex("event_id"), 32, "0").alias("traceId")))
    gauge = F.struct(
        F.array(
            F.struct(
                _nanos("t").alias("timeUnixNano"),
                F.col("value").alias("asDouble"),
                attributes.alias("attributes"),
                exemplar.alias("exemplars"),
            )
        ).alias("dataPoints")
    )
    metric = F.struct(F.lit("event.value").alias("name"), F.lit("ms").alias("unit"), gauge.alias("gauge"))
    resource = _kv("service.name", "stringValue", F.col("event_type"))
    lines = _request(events, "resourceMetrics", "scopeMetrics", resource, "metrics", metric)
    flat = otlp.flatten_metrics(_received(lines, "metrics"))
    return flat.select("time", "service", "name", "kind", "value", "unit", "exemplar_trace_id", "attrs_json", "series_key")


@query
def otlp_traces(spark, sf_dir):
    rows = sample.arriving_spans(spark, sf_dir)
    span = F.struct(
        F.lpad(F.hex(F.col("trace_id").cast("bigint")), 32, "0").alias("traceId"),
        F.lpad("span_id", 16, "0").alias("spanId"),
        F.col("parent_span_id").alias("parentSpanId"),
        "name",
        "kind",
        _nanos("start_time").alias("startTimeUnixNano"),
        _nanos("end_time").alias("endTimeUnixNano"),
        F.struct(F.col("status_code").alias("code")).alias("status"),
        F.array(_kv("part", "intValue", F.col("l_partkey").cast("string"))).alias("attributes"),
    )
    resource = _kv("k8s.deployment.name", "stringValue", F.coalesce("service", F.lit("")))
    lines = _request(rows, "resourceSpans", "scopeSpans", resource, "spans", span)
    flat = otlp.flatten_traces(_received(lines, "traces"), default_service="fallback")
    return flat.select(
        "trace_id", "span_id", "parent_span_id", "service", "name", "kind", "start_time", "end_time", "duration_ms",
        "status_code", "attrs_json",
    )


@query
def otlp_logs(spark, sf_dir):
    rows = sample.logs(spark, sf_dir)
    record = F.struct(
        F.lit("0").alias("timeUnixNano"),
        _nanos("time").alias("observedTimeUnixNano"),
        F.col("severity_number").alias("severityNumber"),
        F.struct(F.col("body").alias("stringValue")).alias("body"),
        F.coalesce("trace_id", F.lit("")).alias("traceId"),
    )
    resource = _kv("service.name", "stringValue", F.col("service"))
    lines = _request(rows, "resourceLogs", "scopeLogs", resource, "logRecords", record)
    flat = otlp.flatten_logs(_received(lines, "logs"))
    return flat.select("time", "trace_id", "service", "severity_number", "body", "attrs_json")


@query
def otlp_nested(spark, sf_dir):
    """Log records whose attributes hold lists, nested lists, booleans, bytes and doubles, two scopes a resource."""
    rows = sample.table(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce("n_chars", F.lit(0)).alias("n"))
    number = F.col("n").cast("string")
    item = lambda field, value: F.struct(value.alias(field))
    values = F.transform(
        F.sequence(F.lit(1), (F.col("doc_id") % 3 + 1).cast("int")), lambda i: item("intValue", (F.col("n") + i).cast("string"))
    )
    listed = item("values", values)
    inner = F.struct(F.lit("tags").alias("key"), item("arrayValue", listed).alias("value"))
    plain = F.struct(F.lit("lang").alias("key"), item("stringValue", F.coalesce("lang", F.lit(""))).alias("value"))
    # The nested lists are put into the line as text, for a column has one type for all of them.
    deep = F.concat(
        F.lit('{"kvlistValue":{"values":['), F.to_json(inner), F.lit(","), F.to_json(plain), F.lit("]}}")
    )
    kinds = [
        ("deep", deep),
        ("list", F.to_json(item("arrayValue", listed))),
        ("even", F.to_json(item("boolValue", F.col("doc_id") % 2 == 0))),
        ("half", F.to_json(item("doubleValue", F.col("n") / 2 + 0.25))),
        ("raw", F.to_json(item("bytesValue", F.base64(F.encode(number, "UTF-8"))))),
    ]
    pairs = [F.concat(F.lit(f'{{"key":"{key}","value":'), text, F.lit("}")) for key, text in kinds]
    # Every second record has no nested value, so both ways of flattening are taken.
    attributes = F.concat_ws(",", *[F.when((F.col("doc_id") % 2 == 0) | (i > 1), pair) for i, pair in enumerate(pairs)])
    record = F.concat(
        F.lit('{"timeUnixNano":"'), (F.col("doc_id") * 1_000_000_000 + sample.EPOCH_US * 1000).cast("string"),
        F.lit('","body":{"intValue":"'), number, F.lit('"},"attributes":['), attributes, F.lit("]}"),
    )
    scope = F.concat(F.lit('{"logRecords":['), record, F.lit("]}"))
    line = F.concat(F.lit('{"resourceLogs":[{"scopeLogs":['), scope, F.lit(","), scope, F.lit("]}]}"))
    flat = otlp.flatten_logs(_received(rows.select(line.alias("value")), "logs"), default_service="none")
    return flat.select("time", "service", "body", "attrs_json").groupBy("time", "service", "body", "attrs_json").agg(
        F.count("*").alias("records")
    )


@query
def otlp_metrics_all(spark, sf_dir):
    """Sums, gauges without a value and histograms as requests, all three kinds in one metric list."""
    hourly = sample.histogram_points(spark, sf_dir).select(
        "time", "service", "value", "count", "bucket_bounds", "bucket_counts", F.get_json_object("attrs_json", "$.type").alias("type")
    )
    attributes = F.array(_kv("type", "stringValue", F.col("type")))
    time = _nanos("time").alias("timeUnixNano")
    total = F.struct(
        F.lit(True).alias("isMonotonic"),
        F.array(F.struct(time, F.col("count").cast("string").alias("asInt"), attributes.alias("attributes"))).alias("dataPoints"),
    )
    shape = F.struct(
        F.array(
            F.struct(
                time,
                F.col("count").cast("string").alias("count"),
                F.col("value").alias("sum"),
                F.col("bucket_bounds").alias("explicitBounds"),
                F.transform("bucket_counts", lambda c: c.cast("string")).alias("bucketCounts"),
                attributes.alias("attributes"),
            )
        ).alias("dataPoints")
    )
    empty = F.struct(F.array(F.struct(time, attributes.alias("attributes"))).alias("dataPoints"))
    none = F.lit(None)
    metric = lambda name, gauge, total, shape: F.struct(
        F.lit(name).alias("name"), F.lit("1").alias("unit"), gauge.alias("gauge"), total.alias("sum"), shape.alias("histogram")
    )
    nothing = [F.when(F.lit(False), x) for x in (empty, total, shape)]
    metrics_of = F.array(
        metric("level", empty, nothing[1], nothing[2]),
        metric("seen", nothing[0], total, nothing[2]),
        metric("sizes", nothing[0], nothing[1], shape),
    )
    group = F.struct(
        F.struct(F.array(_kv("service.name", "stringValue", F.col("service"))).alias("attributes")).alias("resource"),
        F.array(F.struct(metrics_of.alias("metrics"))).alias("scopeMetrics"),
    )
    lines = hourly.select(F.to_json(F.struct(F.array(group).alias("resourceMetrics"))).alias("value"))
    flat = otlp.flatten_metrics(_received(lines, "metrics"))
    return flat.select(
        "time", "service", "name", "kind", "value", "count", "unit", "is_monotonic", "bucket_bounds", "bucket_counts", "attrs_json"
    )


@query
def otlp_rejects(spark, sf_dir):
    """Trace lines of which some do not decode and some rows lack what a stored row needs."""
    rows = sample.arriving_spans(spark, sf_dir)
    span = F.struct(
        F.col("trace_id").alias("traceId"),
        F.col("span_id").alias("spanId"),
        "name",
        _nanos("start_time").alias("startTimeUnixNano"),
        _nanos("end_time").alias("endTimeUnixNano"),
    )
    service = _kv("service.name", "stringValue", F.lit("s"))
    broken = F.col("l_partkey") % 11 == 0
    whole, cut = (
        _request(rows.where(part), "resourceSpans", "scopeSpans", service, "spans", span) for part in (~broken, broken)
    )
    cut = cut.select(F.left("value", F.length("value") - 3).alias("value"))
    requests = _received(whole.unionByName(cut), "traces")
    flat = otlp.flatten_traces(requests).withColumn("name", F.nullif("name", F.lit("GET /checkout")))
    valid, rejected = otlp.split_valid(flat, "spans")
    parts = [
        otlp.rejected_requests(requests).select("reason", F.lit("").alias("missing")),
        rejected.select("reason", "missing"),
        valid.select(F.lit("stored").alias("reason"), F.lit("").alias("missing")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("reason", "missing").agg(F.count("*").alias("records"))


@query
def otlp_sniffed(spark, sf_dir):
    """Log requests in files that only their first bytes tell to be compressed, read beside plain ones."""
    rows = sample.logs(spark, sf_dir)
    record = F.struct(
        _nanos("time").alias("timeUnixNano"),
        F.col("severity_number").alias("severityNumber"),
        F.struct(F.col("body").alias("stringValue")).alias("body"),
    )
    resource = _kv("service.name", "stringValue", F.col("service"))
    folder = _folder(spark)
    for packed, compression in ((True, "gzip"), (False, "none")):
        part = rows.where((F.crc32("service") % 2 == 0) == packed).repartition(8)
        lines = _request(part, "resourceLogs", "scopeLogs", resource, "logRecords", record)
        writer = lines.write.option("compression", compression).option("maxRecordsPerFile", BODY_LINES)
        writer.text(f"{folder}/packed={packed}")
    flat = otlp.flatten_logs(otlp.read_sniffed_requests(spark, f"{folder}/packed=*", "logs"))
    return flat.groupBy("service", "severity_number").agg(
        F.count("*").alias("records"), F.sum(F.char_length("body")).alias("chars"), F.max("time").alias("newest")
    )


# --- rules, notifications and results as files -------------------------------


@query
def rule_problems(spark, sf_dir):
    """What is wrong with declared rules, one of them per customer."""
    declared = sample.table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"),
        F.when(F.col("c_custkey") % 5 == 0, "  ").otherwise("account.balance").alias("metric"),
        F.when(F.col("c_custkey") % 7 == 0, "ge").otherwise("lt").alias("comparator"),
        F.when(F.col("c_custkey") % 11 != 0, F.col("c_acctbal")).alias("threshold"),
        F.when(F.col("c_custkey") % 13 == 0, "median").alias("agg"),
        F.when(F.col("c_custkey") % 17 == 0, 0).alias("window_secs"),
        F.when(F.col("c_custkey") % 19 == 0, -5).alias("for_secs"),
    )
    return rules_source.problems(declared)


@query
def rules_normal(spark, sf_dir):
    """Declared rules with their defaults and predicates filled in."""
    key = F.col("c_custkey")
    match = F.concat(F.lit('{"segment":"'), F.col("c_mktsegment"), F.lit('","n":'), key.cast("string"), F.lit("}"))
    declared = sample.table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"),
        F.lit("account.balance").alias("metric"),
        F.when(key % 2 == 0, "").otherwise(F.col("c_mktsegment")).alias("service"),
        F.lit("lt").alias("comparator"),
        F.col("c_acctbal").alias("threshold"),
        F.when(key % 3 == 0, "max").alias("agg"),
        F.when(key % 4 == 0, 60).alias("window_secs"),
        F.when(key % 5 == 0, False).alias("enabled"),
        F.when(key % 2 == 0, match).when(key % 3 == 0, "{}").alias("match"),
        F.lit(None).cast("string").alias("exclude"),
        F.lit(None).cast("boolean").alias("rate"),
        F.lit(None).cast("int").alias("for_secs"),
    )
    normal = rules_source.normalize_rules(declared)
    wanted = F.col("match_attrs")
    return normal.select(
        "name", "service", "threshold", "agg", "window_secs", "enabled",
        wanted["segment"].alias("segment"), wanted["n"].alias("n"), wanted.isNotNull().alias("has_match"),
    )


@query
def rule_names(spark, sf_dir):
    """One rule per name: the one with the highest id."""
    rows = _stored_rules(spark, sf_dir).withColumn("name", F.concat(F.lit("r"), (F.col("rule_id") % 7).cast("string")))
    return rule_admin.unique_by_name(rows).select("rule_id", "name", "threshold")


@query
def alert_urgency(spark, sf_dir):
    listed = alert_views.list_alerts(sample.rules(spark), _events(spark, sf_dir), _facts(spark, sf_dir))
    return alert_views.rules_by_urgency(listed).select("rule_id", "name", "firing")


@query
def alert_notifications(spark, sf_dir):
    """The documents sent for the transitions of one evaluation, read again field by field."""
    sent = alerts.notifications(_step(spark, sf_dir)[1])
    field = lambda name: F.get_json_object("payload", f"$.{name}")
    return sent.select(
        "rule_id",
        *[field(name).alias(name) for name in ("rule", "metric", "service", "state", "comparator")],
        *[field(name).cast("double").alias(name) for name in ("value", "threshold")],
        F.col("payload").contains('"attributes":').alias("has_attributes"),
    )


@query
def results_json(spark, sf_dir):
    """A result table written as JSON lines and read again."""
    result = services.service_edges(sample.spans(spark, sf_dir), _span_now(spark, sf_dir), start=EPOCH)
    folder = f"{_folder(spark)}/results"
    storage.write_json(result, folder)
    return spark.read.schema(result.schema).json(folder)


@query
def sweep_stall(spark, sf_dir):
    """Orders as a log of sweeps, of which those marked F failed: is the last success too old?"""
    log = sample.table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").cast("timestamp").alias("finished_at"),
        (F.col("o_orderstatus") != "F").alias("ok"),
        F.col("o_orderkey").alias("rows"),
    )
    log = log.groupBy("finished_at").agg(F.bool_or("ok").alias("ok"), F.max("rows").alias("rows"))
    return retention.stalled(log, EPOCH, EPOCH, 86400)
