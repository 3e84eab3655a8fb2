import json
from datetime import timedelta
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from builders import NOW, ago, points, rule, rules, span, spans
from pyspark.sql import functions as F

from spanloom import schemas
from spanloom.functions.predicates import breached
from spanloom.operators import traces
from spanloom.operators.alerts import alert_step, evaluate_rules
from spanloom.operators.metric_facts import counters, facts_of, newest_meta
from spanloom.operators.rollups import rollup_points
from spanloom.plans import queries
from spanloom.schemas import EVENTS
from spanloom.sources import fact_store, key_index, otlp, storage
from spanloom.streaming import alerting, ingest

ONCE = {"availableNow": True}


def files(df, path, n):
    """The rows as n files, in order, for a stream that reads one file per batch."""
    for i, part in enumerate(df.randomSplit([1.0] * n, seed=1)):
        part.coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_metric_ingest_equals_batch(spark, tmp_path):
    rows = [dict(time=ago(seconds=20 * i), value=i, attrs={"s": str(i % 3)}) for i in range(60)]
    rows += [dict(name="h", kind="histogram", time=ago(days=2), value=1, count=1, bounds=[1.0], counts=[1, i]) for i in range(9)]
    df = points(spark, rows)
    source, raw, rolled, check = (str(tmp_path / n) for n in ("in", "raw", "rolled", "check"))
    files(df, source, 3)
    points_stream = stream(spark, source, df.schema)
    ingest.start_metric_ingest(points_stream, raw, rolled, check, ONCE).awaitTermination()
    assert sorted(map(str, storage.read_rollups(spark, rolled).collect())) == sorted(map(str, rollup_points(df).collect()))
    assert storage.read_table(spark, raw, schemas.METRICS).count() == df.count()
    # Nothing new: the stream ends without adding anything.
    ingest.start_metric_ingest(points_stream, raw, rolled, check, ONCE).awaitTermination()
    assert storage.read_table(spark, raw, schemas.METRICS).count() == df.count()


def test_windowed_rollups(spark, tmp_path):
    df = points(spark, [dict(time=ago(seconds=200 * i), value=i) for i in range(6)])
    source = str(tmp_path / "in")
    files(df, source, 1)
    out = ingest.windowed_rollups(stream(spark, source, df.schema))
    out.writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(**ONCE).start().awaitTermination()
    found = {(r["bucket"], r["count"], r["sum"]) for r in spark.table("windowed").collect()}
    assert found == {(r["bucket"], r["count"], r["sum"]) for r in rollup_points(df).collect()}


def test_span_dedupe(spark, tmp_path):
    df = spans(spark, [span("t", str(i % 10), start=ago(seconds=i)) for i in range(40)])
    df = df.withColumns({"status_message": F.lit(None).cast("string"), "ingested_at": F.lit(NOW), "kind": F.lit(1)})
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    files(df, source, 4)
    ingest.start_span_ingest(stream(spark, source, df.schema), out, str(tmp_path / "c"), trigger=ONCE).awaitTermination()
    assert storage.read_table(spark, out, schemas.SPANS).select("span_id").distinct().count() == 10
    assert storage.read_table(spark, out, schemas.SPANS).count() == 10


def test_late_and_repeated_spans_are_kept_once(spark, tmp_path):
    """Copies days apart in arrival, spans far older than any delay, and a batch run again."""
    extra = {"status_message": F.lit(None).cast("string"), "ingested_at": F.lit(NOW), "kind": F.lit(1)}
    batches = [
        [span("t", "1", start=ago(days=1)), span("t", "2", start=ago(days=40))],
        [span("t", "3", start=ago(seconds=1))],
        [span("t", "1", start=ago(days=1)), span("t", "2", start=ago(days=40)), span("t", "4", start=ago(days=900))],
    ]
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "c"))
    for rows in batches:
        df = spans(spark, rows).withColumns(extra)
        df.coalesce(1).write.mode("append").parquet(source)
        ingest.start_span_ingest(stream(spark, source, df.schema), out, check, trigger=ONCE).awaitTermination()
    stored = storage.read_table(spark, out, schemas.SPANS)
    assert sorted(r["span_id"] for r in stored.collect()) == ["1", "2", "3", "4"]


def test_log_ingest_keeps_late_rows(spark, tmp_path):
    names = [f.name for f in schemas.LOGS.fields]
    rows = [(ago(days=d), str(d)) for d in (0, 1, 700)]
    df = spark.createDataFrame(rows, "time timestamp, body string")
    df = df.select(*[F.col(n) if n in df.columns else F.lit(None).cast(schemas.LOGS[n].dataType).alias(n) for n in names])
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    files(df, source, 2)
    ingest.start_log_ingest(stream(spark, source, df.schema), out, str(tmp_path / "c"), ONCE).awaitTermination()
    assert {r["body"] for r in storage.read_table(spark, out, schemas.LOGS).collect()} == {"0", "1", "700"}


def test_otlp_stream(spark, tmp_path):
    request = {"resourceSpans": [{"scopeSpans": [{"spans": [{"traceId": "1", "spanId": str(i)} for i in range(3)]}]}]}
    (tmp_path / "a.jsonl").write_text(json.dumps(request))
    flat = otlp.flatten_traces(otlp.stream_requests(spark, str(tmp_path), "traces"), received=F.lit(NOW))
    flat.writeStream.format("memory").queryName("flat").trigger(**ONCE).start().awaitTermination()
    assert spark.table("flat").count() == 3


def test_rule_state_equals_steps(spark, tmp_path):
    levels = [10, 60, 70, None, 80, 90, 95, 20]
    declared = rules(spark, rule(1), rule(2, for_secs=60))
    history, rows, moves = spark.createDataFrame([], EVENTS), [], []
    for i, level in enumerate(levels):
        now = NOW + timedelta(seconds=30 * i)
        value = F.lit(level).cast("double")
        evaluated = declared.withColumns(
            {
                "value": value,
                "breached": breached(value, F.col("comparator"), F.col("threshold")),
                "attributes": F.lit(None).cast("string"),
            }
        )
        rows += [(r["rule_id"], now, r["value"], r["breached"], r["for_secs"]) for r in evaluated.collect()]
        history, transitions = alert_step(evaluated, history, now)
        history = spark.createDataFrame(history.collect(), EVENTS)
        moves += [(r["rule_id"], r["state"], now, r["value"]) for r in transitions.collect()]
    df = spark.createDataFrame(rows, "rule_id bigint, at timestamp, value double, breached boolean, for_secs int")
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    found = []
    # Two runs over one checkpoint: the state outlives the restart.
    for half in (df.where(F.col("at") < NOW + timedelta(seconds=100)), df.where(F.col("at") >= NOW + timedelta(seconds=100))):
        half.coalesce(1).write.mode("append").parquet(source)
        query = (
            alerting.follow_rules(stream(spark, source, df.schema))
            .writeStream.foreachBatch(lambda b, _: found.extend(b.collect()))
            .option("checkpointLocation", check)
            .trigger(**ONCE)
            .start()
        )
        query.awaitTermination()
    assert sorted((r["rule_id"], r["state"], r["at"], r["value"]) for r in found) == sorted(moves)
    assert len(moves) > 3


def test_tick_replay(spark, tmp_path):
    declared, path = rules(spark, rule()), str(tmp_path / "alerts")
    for i, level in enumerate((90, 95, 5)):
        now = NOW + timedelta(seconds=400 * i)
        for _ in range(2):
            seen = points(spark, [dict(value=level, time=now)])
            alerting.run_tick(spark, declared, seen, facts_of(seen), path, i, now)
    events = alerting.read_events(spark, path, 2).collect()
    assert [tuple(e) for e in events] == [(1, 90.0, NOW, NOW, NOW + timedelta(seconds=800))]
    sent = spark.read.json(f"{path}/notifications").collect()
    assert sorted(json.loads(r["payload"])["state"] for r in sent) == ["firing", "resolved"]


def test_events_of_removed_rules_go(spark, tmp_path):
    path, high = str(tmp_path / "alerts"), points(spark, [dict(value=90)])
    both = rules(spark, rule(1), rule(2))
    alerting.run_tick(spark, both, high, facts_of(high), path, 0, NOW)
    assert alerting.read_events(spark, path, 0).count() == 2
    later = NOW + timedelta(seconds=30)
    alerting.run_tick(spark, both.where("rule_id = 2"), high, facts_of(high), path, 1, later)
    assert [(r["rule_id"], r["resolved_at"]) for r in alerting.read_events(spark, path, 1).collect()] == [(2, None)]
    sent = spark.read.json(f"{path}/notifications/tick=1").collect()
    assert sent == []


def test_metric_facts_are_kept_batch_by_batch(spark, tmp_path):
    batches = [
        [dict(time=ago(minutes=9), kind="gauge", unit="s"), dict(name="c", time=ago(minutes=9), kind="sum", mono=True)],
        [dict(time=ago(minutes=2), kind="sum", mono=True, unit="1", value=None), dict(name="c", time=ago(days=9), kind="gauge")],
        [dict(name="new", time=ago(minutes=1), kind="histogram", unit="By")],
    ]
    source, path, check = (str(tmp_path / n) for n in ("in", "facts", "c"))
    for rows in batches:
        points(spark, rows).coalesce(1).write.mode("append").parquet(source)
        rows_in = stream(spark, source, points(spark, rows).schema)
        ingest.start_metric_ingest(
            rows_in, str(tmp_path / "raw"), str(tmp_path / "out"), check, ONCE, facts_path=path
        ).awaitTermination()
    kept = fact_store.read(spark, path)
    everything = points(spark, [r for rows in batches for r in rows])
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(map(tuple, facts_of(everything).collect()), key=str)
    meta = {r["name"]: (r["kind"], r["unit"]) for r in newest_meta(kept).collect()}
    assert meta == {"m": ("sum", "1"), "c": ("sum", None), "new": ("histogram", "By")}
    # The newest point of m has no value, so its newest valued one decides.
    assert {r["name"]: r["counter"] for r in counters(kept).collect()} == {"m": False, "c": True, "new": False}
    # The same batch again, and a version that was never finished, change nothing.
    fact_store.keep(facts_of(points(spark, batches[0])), path)
    assert {tuple(r) for r in fact_store.read(spark, path).collect()} == {tuple(r) for r in facts_of(everything).collect()}
    (tmp_path / "facts" / "version=99").mkdir()
    assert fact_store.read(spark, path).count() == facts_of(everything).count()
    finished = [p for p in (tmp_path / "facts").iterdir() if (p / "_SUCCESS").exists()]
    assert len(finished) == fact_store.KEEP_VERSIONS
    assert fact_store.read(spark, str(tmp_path / "none")).count() == 0


def test_alert_scans_have_a_time_bound(spark, tmp_path):
    """Neither kinds nor rates of metrics are looked up in the points."""
    points(spark, [dict(value=90)]).write.parquet(str(tmp_path / "points"))
    stored = spark.read.parquet(str(tmp_path / "points"))
    fact_store.keep(facts_of(stored), str(tmp_path / "facts"))
    found = evaluate_rules(rules(spark, rule()), stored, NOW, fact_store.read(spark, str(tmp_path / "facts")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "value" in line]
    assert scans and all("GreaterThanOrEqual(time" in line for line in scans)


def complete(df):
    return df.withColumns({"status_message": F.lit(None).cast("string"), "ingested_at": F.lit(NOW), "kind": F.lit(1)})


def ingested(spark, source, out, check, rows):
    df = complete(spans(spark, rows))
    df.coalesce(1).write.mode("append").parquet(source)
    ingest.start_span_ingest(stream(spark, source, df.schema), out, check, trigger=ONCE).awaitTermination()
    return sorted((r["span_id"], r["start_time"]) for r in storage.read_table(spark, out, schemas.SPANS).collect())


def test_a_copy_on_another_day_is_stored_once(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "c"))
    first = [span("t", "1", start=ago(days=1)), span("t", "2", start=ago(days=40))]
    assert len(ingested(spark, source, out, check, first)) == 2
    moved = [span("t", "1", start=ago(days=3)), span("t", "2", start=ago(hours=1)), span("t", "3", start=ago(days=3))]
    found = ingested(spark, source, out, check, moved)
    assert found == [("1", ago(days=1)), ("2", ago(days=40)), ("3", ago(days=3))]
    # A new checkpoint starts from batch zero again: nothing is replaced, nothing stored twice.
    again = [span("t", "3", start=ago(days=1)), span("t", "4", start=ago(days=1))]
    found = ingested(spark, str(tmp_path / "in2"), out, str(tmp_path / "c2"), again)
    assert [s for s, _ in found] == ["1", "2", "3", "4"]
    assert storage.run_base(spark, out, check) == 0 and storage.run_base(spark, out, str(tmp_path / "c2")) == storage.RUN_BATCHES


def test_a_table_without_an_index_gets_one(spark, tmp_path):
    out = str(tmp_path / "out")
    storage.append(complete(spans(spark, [span("t", "1", start=ago(days=9))])), "spans", out)
    found = ingested(spark, str(tmp_path / "in"), out, str(tmp_path / "c"), [span("t", "1"), span("t", "2")])
    assert [s for s, _ in found] == ["1", "2"]
    with pytest.raises(ValueError):
        storage.append(complete(spans(spark, [span("t", "5")])), "spans", out)


def test_only_hit_buckets_of_the_key_index_are_read(spark, tmp_path):
    path, keys = str(tmp_path / "t"), ["trace_id", "span_id"]
    rows = spark.range(5000).select(F.lit("t").alias("trace_id"), F.col("id").cast("string").alias("span_id"))
    key_index.add(rows.where("id < 2000"), path, keys, 0)
    key_index.add(rows.where("id >= 2000 and id < 3000"), path, keys, 1)
    new = rows.where("id >= 3000 and id < 3400")
    # Twelve bits a key let few new keys through; without the filters every bucket would be hit.
    assert len(key_index.hit_buckets(new, path, keys, 2)) < key_index.BUCKETS / 3
    two = rows.where("id in (5, 2500)")
    buckets = key_index.hit_buckets(two, path, keys, 2)
    assert 1 <= len(buckets) <= 2
    known = key_index.stored(two, path, keys, 2)
    assert two.join(known, keys, "left_semi").count() == 2
    assert known.count() < 3000 / 8
    # Entries of the asking batch and of later ones do not count.
    assert two.join(key_index.stored(two, path, keys, 1), keys, "left_semi").count() == 1
    assert key_index.stored(rows.where("id = 4000"), path, keys, 0) is None
    for n in (1, 64, 777):
        every = rows.where(F.col("id") < n)
        key_index.add(every, f"{path}{n}", keys, 0)
        assert every.join(key_index.stored(every, f"{path}{n}", keys, 1), keys, "left_anti").count() == 0


def scanned_rows(df):
    """Rows that the file scans of an executed plan gave."""
    df.collect()
    plan, found = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            plan.append(node.executedPlan())
        if name == "FileSourceScanExec":
            found += node.metrics().apply("numOutputRows").value()
        children = node.children()
        plan += [children.apply(i) for i in range(children.size())]
    return found


def test_a_trace_look_up_skips_files_without_the_trace(spark, tmp_path):
    """Ids lie apart in every file's range, so only the Bloom filters can tell the files apart."""
    out = str(tmp_path / "spans")
    rows = complete(spans(spark, [span(f"{i * 7919 % 1000:03d}", "1", start=ago(seconds=i)) for i in range(400)]))
    for k in range(8):
        mine = F.pmod(F.xxhash64("trace_id"), F.lit(8)) == k
        storage.append_batch(rows.where(mine).coalesce(1), "spans", out, k)
    table = storage.read_table(spark, out, schemas.SPANS)
    found = traces.trace_spans(table, "919")
    assert found.count() == 1
    assert table.count() == 400
    assert scanned_rows(found) < 400 / 3
    assert scanned_rows(traces.trace_spans(table, "no such trace")) < 400 / 3


def test_files_of_a_batch_grow_with_days_and_not_with_tasks(spark, tmp_path):
    rows = [span("t", str(i), start=ago(days=i % 40)) for i in range(400)]
    df = complete(spans(spark, rows)).repartition(16)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df.coalesce(1).write.parquet(source)
    ingest.start_span_ingest(stream(spark, source, df.schema), out, str(tmp_path / "c"), trigger=ONCE).awaitTermination()
    storage.append_batch(df, "spans", str(tmp_path / "plain"), 0)
    for path in (out, str(tmp_path / "plain")):
        stored = storage.read_table(spark, path, schemas.SPANS)
        assert stored.count() == 400 and len(stored.inputFiles()) <= 40 + 4
        # A file of ten rows has a small Bloom filter.
        assert max(f.stat().st_size for f in Path(path).glob("date=*/*/*.parquet")) < 20_000


def shuffles_left(spark):
    """Numbers of the shuffles that have files."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {int(name.split("_")[1]) for name in names if name.startswith("shuffle_")}


def test_span_ingest_leaves_no_shuffles_and_no_rows_aside(spark, tmp_path):
    """A long stream's disk is that of its table and of one batch."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = complete(spans(spark, [span("t", str(i % 30), start=ago(days=i % 7)) for i in range(60)]))
    files(df, source, 3)
    rows = stream(spark, source, df.schema)
    before = shuffles_left(spark)
    ingest.start_span_ingest(rows, out, str(tmp_path / "c"), trigger=ONCE).awaitTermination()
    assert not shuffles_left(spark) - before
    assert not list(Path(out).glob("_aside/*"))
    assert storage.read_table(spark, out, schemas.SPANS).count() == 30


def test_stored_keys_are_compared_once_a_batch(spark, tmp_path, monkeypatch):
    """Writes to the table's folder don't make Spark look for the stored keys again."""
    seen, real = spark.sparkContext.accumulator(0), key_index.stored

    def counting(*args):
        known = real(*args)

        def pass_on(batches):
            for batch in batches:
                seen.add(len(batch))
                yield batch

        return None if known is None else known.mapInPandas(pass_on, known.schema)

    monkeypatch.setattr(key_index, "stored", counting)
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "c"))
    ingested(spark, source, out, check, [span("t", str(i)) for i in range(5)])
    found = ingested(spark, source, out, check, [span("t", str(i)) for i in range(3, 9)])
    assert [s for s, _ in found] == [str(i) for i in range(9)]
    assert 2 <= seen.value <= 5


def test_narrow_rows_are_made_spans_when_they_are_stored(spark, tmp_path):
    """Keys may be numbers; they are those of the texts that are stored."""
    out = str(tmp_path / "out")
    wide = complete(spans(spark, [span("1", str(i), start=ago(days=i)) for i in range(4)]))
    narrow = wide.select(F.col("trace_id").cast("long"), F.col("span_id").cast("int"), "service", "start_time", "ingested_at")
    others = wide.drop(*narrow.columns).limit(1).collect()[0].asDict()
    kinds = {f.name: f.dataType for f in wide.schema.fields}

    def made(rows):
        filled = {k: F.create_map().cast(kinds[k]) if k == "attributes" else F.lit(v).cast(kinds[k]) for k, v in others.items()}
        return rows.withColumns({"trace_id": F.col("trace_id").cast("string"), "span_id": F.col("span_id").cast("string"), **filled})

    for name, rows, make in (
        ("texts", wide.where("span_id < 2"), None),
        ("numbers", narrow.union(narrow.withColumn("start_time", F.lit(NOW))).withColumn("ingested_at", F.col("start_time")), made),
        ("again", narrow, made),
    ):
        source = str(tmp_path / name)
        rows.coalesce(1).write.parquet(source)
        paths = (out, str(tmp_path / f"c-{name}"))
        ingest.start_span_ingest(stream(spark, source, rows.schema), *paths, trigger=ONCE, made=make).awaitTermination()
    stored = storage.read_table(spark, out, schemas.SPANS)
    found = sorted((r["trace_id"], r["span_id"], r["start_time"], r["service"]) for r in stored.collect())
    assert found == sorted((r["trace_id"], r["span_id"], r["start_time"], r["service"]) for r in wide.collect())
    with_days = stored.select("date", F.to_date("start_time").alias("day")).collect()
    assert all(r["date"] == r["day"] for r in with_days)


def test_stream_input_comes_in_row_groups(spark, tmp_path, monkeypatch):
    """A batch of few files is many tasks' load."""
    monkeypatch.setattr(storage, "ASIDE_GROUP", 1 << 16, raising=False)
    df = spark.range(60_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text")).coalesce(1)
    queries._as_stream(df, str(tmp_path))
    [file] = (tmp_path / "in").glob("*.parquet")
    assert pq.ParquetFile(file).num_row_groups > 4
