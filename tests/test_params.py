from datetime import datetime, timedelta

import pytest

from spanloom import params

NOW = datetime(2024, 5, 1, 12)


def test_output_bucket():
    assert params.output_bucket_secs(3600, 300) == 300
    assert params.output_bucket_secs(90 * 86400, 300) == 7800
    assert params.output_bucket_secs(1001 * 300, 300) == 600
    assert params.output_bucket_secs(1000 * 300, 300) == 300
    assert params.output_bucket_secs(0, 300) == 300
    assert params.output_bucket_secs(100, 0) == 0


def test_metric_window():
    assert params.metric_window(NOW, None, 6) == (NOW - timedelta(hours=6), NOW)
    assert params.metric_window(NOW, 10_000, 6).lo == NOW - timedelta(hours=10_000)
    assert params.metric_window(NOW, 10_000, 6, 168).lo == NOW - timedelta(hours=168)
    end = NOW - timedelta(days=1)
    assert params.metric_window(NOW, None, 6, end=end) == (end - timedelta(hours=6), end)
    wide = params.metric_window(NOW, None, 6, start=NOW - timedelta(days=1000))
    assert wide.lo == NOW - timedelta(days=1000)


def test_nothing_is_cut_unasked(spark):
    old = NOW - timedelta(days=3000)
    assert params.list_floor(NOW, old) == old
    assert params.list_floor(NOW, old, 48) == NOW - timedelta(hours=48)
    assert params.list_floor(NOW, None) == NOW - timedelta(hours=24)
    rows = spark.range(5000)
    assert params.top(rows, None).count() == 5000
    assert params.top(rows, 4000).count() == 4000
    with pytest.raises(ValueError):
        params.top(rows, 0)
