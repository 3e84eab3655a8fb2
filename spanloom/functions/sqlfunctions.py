"""The shared scalar functions, registered for SQL users as plain SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Bodies are SQL expressions, so calls are inlined and stay inside generated code.
DEFINITIONS = {
    "array_add": (
        "a ARRAY<BIGINT>, b ARRAY<BIGINT>",
        "ARRAY<BIGINT>",
        "nullif(zip_with(coalesce(a, CAST(array() AS ARRAY<BIGINT>)), coalesce(b, CAST(array() AS ARRAY<BIGINT>)),"
        " (x, y) -> coalesce(x, 0L) + coalesce(y, 0L)), CAST(array() AS ARRAY<BIGINT>))",
    ),
    "metric_bucket": (
        "t TIMESTAMP, width DOUBLE",
        "TIMESTAMP",
        "timestamp_micros(unix_micros(t) - pmod(unix_micros(t), CAST(round(width * 1000000) AS BIGINT)))",
    ),
    "metric_series_key": (
        "service STRING, attrs_json STRING",
        "STRING",
        "md5(concat(coalesce(service, ''), '|', attrs_json))",
    ),
}


def register(spark: SparkSession) -> None:
    for name, (arguments, result, body) in DEFINITIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
