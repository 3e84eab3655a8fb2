import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.operators.scaling import exact_percentiles, small_side, with_previous, with_running_sum

QUANTILES = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}


@pytest.mark.parametrize("n", [1, 2, 7, 400])
def test_exact_percentiles_match_interpolation(spark, n):
    rng = random.Random(n)
    pools = {
        "mixed": [rng.choice([0.0, -3.5, 1e-9, 12.0, rng.lognormvariate(3, 2)]) for _ in range(n)],
        "flat": [7.25] * n,
        "wide": [rng.uniform(-1e6, 1e6) for _ in range(n)],
    }
    rows = [(k, v) for k, values in pools.items() for v in values]
    found = exact_percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", QUANTILES)
    for row in found.collect():
        for name, q in QUANTILES.items():
            assert row[name] == pytest.approx(np.quantile(pools[row["k"]], q), rel=1e-12, abs=1e-12)


def test_percentiles_beyond_broadcast_limit(spark, monkeypatch):
    monkeypatch.setattr("spanloom.operators.scaling.small_side", lambda df: small_side(df, 0))
    rows = [(f"k{i % 5}", float(i)) for i in range(500)]
    found = exact_percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"p50": 0.5})
    assert {r["k"]: r["p50"] for r in found.collect()} == {f"k{i}": 247.5 + i - 0.0 for i in range(5)}


def test_previous_across_chunks(spark):
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    # One key holds most rows; some chunks are empty, some times are equal.
    rows = [
        ("hot" if rng.random() < 0.8 else f"k{rng.randrange(4)}", start + timedelta(minutes=rng.randrange(0, 600, 7)), float(i))
        for i in range(400)
    ]
    df = spark.createDataFrame(rows, "k string, t timestamp, v double")
    found = with_previous(df, ["k"], "t", ["v"], {"t": "pt", "v": "pv"}, chunk_secs=1800)
    order = W.partitionBy("k").orderBy("t", "v")
    plain = df.select("k", "t", "v", F.lag("t").over(order).alias("pt"), F.lag("v").over(order).alias("pv"))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def test_running_sum_across_chunks(spark):
    rng = random.Random(4)
    rows = [("b" if i % 3 else "a", i, rng.randrange(9)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint")
    found = with_running_sum(df, ["k"], F.floor(F.col("i") / 16).cast("bigint"), ["i"], "v", "before")
    expected, sums = {}, {}
    for k, i, v in rows:
        expected[i] = sums.get(k, 0)
        sums[k] = sums.get(k, 0) + v
    assert {r["i"]: r["before"] for r in found.collect()} == expected


def test_small_side(spark):
    df = spark.range(10)
    assert small_side(df, 10).count() == 10
    assert small_side(df, 9) is df
