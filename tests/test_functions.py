import pytest
from pyspark.sql import functions as F

from spanloom.functions import attributes as at
from spanloom.functions import predicates, sqlfunctions
from spanloom.functions.histograms import array_add, with_quantiles
from spanloom.functions.times import bucket, nanos_duration_ms, nanos_to_time


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def fragments(**pairs):
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def test_json_string_and_text(spark):
    for text in ('plain', 'a"b', "back\\slash", "line\nbreak", "", "é·x"):
        literal = at.json_string(F.lit(text))
        assert one(spark, at.fragment_text(literal)) == text
    assert one(spark, at.fragment_text(F.lit("null"))) is None
    assert one(spark, at.fragment_text(F.lit("1.50"))) == "1.50"


def test_canonical_order_is_length_then_bytes(spark):
    attrs = F.create_map(*[F.lit(x) for x in ("bb", "1", "a", '"x"', "aa", "true")])
    assert one(spark, at.canonical_json(attrs)) == '{"a": "x", "aa": true, "bb": 1}'
    assert one(spark, at.canonical_json(F.create_map().cast("map<string,string>"))) == "{}"


def test_merge_overlay_wins(spark):
    merged = at.merge(fragments(a="1", b="2"), fragments(b="3", c="4"))
    assert one(spark, merged) == {"a": "1", "b": "3", "c": "4"}


@pytest.mark.parametrize(
    "attrs, service",
    [
        ({"service.name": '"api"', "k8s.pod.name": '"p"'}, "api"),
        ({"service.name": '"unknown_service:java"', "k8s.pod.name": '"p"'}, "p"),
        ({"service.name": '""', "k8s.deployment.name": '"d"', "k8s.pod.name": '"p"'}, "d"),
        ({"service.name": "5", "k8s.cronjob.name": '"c"'}, "c"),
        ({"service.name": '"unknown_service"'}, "fallback"),
    ],
)
def test_service_resolution(spark, attrs, service):
    column = F.create_map(*[F.lit(x) for pair in attrs.items() for x in pair])
    assert one(spark, at.resolve_service(column, "fallback")) == service


def test_equality_filter(spark):
    attrs = fragments(n="5", s='"5"')
    assert one(spark, at.equals_filter(attrs, "s=5"))
    assert not one(spark, at.equals_filter(attrs, "n=5"))
    assert not one(spark, at.equals_filter(attrs, "absent=5"))
    assert at.equals_filter(attrs, "novalue") is None
    assert at.equals_filter(attrs, "=x") is None
    assert one(spark, at.equals_filter(fragments(k='"a=b"'), "k=a=b"))


@pytest.mark.parametrize(
    "text, body, hit",
    [
        ("ERR", "an error", True),
        ("a_c", "xabcx", True),
        ("a%c", "a123c", True),
        ("50\\%", "50% off", True),
        ("50\\%", "50 off", False),
        ("c:\\temp", "C:temp", True),
        ("end\\", "the end%", True),
        ("end\\", "the end", False),
    ],
)
def test_ilike_pattern(spark, text, body, hit):
    assert one(spark, F.lit(body).ilike(at.ilike_pattern(text))) is hit


def test_times(spark):
    received = F.lit("2030-01-01 00:00:00").cast("timestamp")
    assert one(spark, F.unix_micros(nanos_to_time(F.lit("1700000000123456789"), received))) == 1700000000123456
    assert one(spark, nanos_to_time(F.lit("18446744073709551615"), received)).year == 2030
    assert one(spark, nanos_duration_ms(F.lit("1000"), F.lit("2500"))) == 0.0015
    assert one(spark, nanos_duration_ms(F.lit("5000"), F.lit("1"))) == 0.0
    edge = F.timestamp_micros(F.lit(1_700_000_100_000_000 - 1))
    assert one(spark, F.unix_micros(bucket(edge, 300.0))) == 1_699_999_800_000_000
    assert one(spark, F.unix_micros(bucket(F.timestamp_micros(F.lit(-1)), 300.0))) == -300_000_000


def test_array_add(spark):
    long_array = "array<bigint>"
    a, b = F.array(F.lit(1), F.lit(2)).cast(long_array), F.array(F.lit(10)).cast(long_array)
    assert one(spark, array_add(a, b)) == [11, 2]
    assert one(spark, array_add(F.lit(None).cast(long_array), b)) == [10]
    assert one(spark, array_add(F.lit(None).cast(long_array), F.lit(None).cast(long_array))) is None


@pytest.mark.parametrize(
    "bounds, counts, p50, p95",
    [
        ([10.0, 20.0, 30.0], [0, 100, 0, 0], 15.0, 19.5),
        ([10.0], [0, 5], 10.0, 10.0),
        ([10.0], [4, 0], 5.0, 9.5),
        ([10.0], [0, 0], None, None),
        ([], [3], None, None),
    ],
)
def test_histogram_quantile(spark, bounds, counts, p50, p95):
    df = spark.createDataFrame([(bounds, counts)], "b array<double>, c array<bigint>")
    row = with_quantiles(df, "b", "c").first()
    assert row["p50"] == (pytest.approx(p50) if p50 is not None else None)
    assert row["p95"] == (pytest.approx(p95) if p95 is not None else None)


def test_breached(spark):
    def hit(value, cmp):
        return one(spark, predicates.breached(F.lit(value).cast("double"), F.lit(cmp), F.lit(5.0)))

    assert hit(6.0, "gt") and not hit(5.0, "gt") and hit(4.0, "lt") and not hit(5.0, "lt")
    assert not hit(None, "gt") and not hit(float("nan"), "gt") and not hit(6.0, "eq")


def test_labels(spark):
    assert [one(spark, predicates.severity_class(F.lit(n).cast("int"))) for n in (None, 5, 9, 13, 17)] == [
        "", "debug", "info", "warn", "error",
    ]
    assert [one(spark, predicates.span_kind_label(F.lit(n).cast("int"))) for n in (2, 9, None)] == ["server", "9", None]
    assert one(spark, at.short_key(F.lit("k8s.pod.name"))) == "pod.name"


def test_nested_containment(spark):
    df = spark.createDataFrame(
        [('{"a": {"x": 1, "y": [1, 2]}}', '{"a": {"y": [2]}}'), ('{"a": {"x": 1}}', '{"a": {"x": true}}')], "h string, w string"
    )
    assert [r[0] for r in df.select(at.contains_nested("h", "w")).collect()] == [True, False]


def test_sql_functions(spark):
    sqlfunctions.register(spark)
    row = spark.sql(
        "SELECT array_add(array(1L, 2L), array(5L)) a, array_add(NULL, NULL) n, "
        "metric_bucket(TIMESTAMP '2024-01-01 00:07:00', 300.0D) b, metric_series_key(NULL, '{}') k, md5('|{}') m"
    ).first()
    assert row["a"] == [6, 2] and row["n"] is None and row["b"].minute == 5 and row["k"] == row["m"]
