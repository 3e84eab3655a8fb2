"""Windows and limits of the read operators (driver-side arithmetic only).

A read without a start covers a default window. What a caller asks for is never cut: a
ceiling or a limit holds only where the caller states one.
"""

from __future__ import annotations

import math
from datetime import datetime, timedelta
from typing import NamedTuple

from pyspark.sql import DataFrame

# Default windows of the read surface.
BUCKET_SECS = 300.0
TARGET_POINTS = 1000
DEFAULT_LIST_HOURS = 24
SERIES_HOURS = 24
FACET_HOURS = 6
SERVICE_MAP_HOURS = 1
CHART_CAP = 12
SPARK_POINTS = 30


class Window(NamedTuple):
    lo: datetime
    hi: datetime


def top(df: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` rows in the order of ``df``; all of them for None."""
    if limit is None:
        return df
    if limit < 1:
        raise ValueError(f"a limit of {limit} rows")
    return df.limit(limit)


def list_floor(now: datetime, start: datetime | None, max_hours: float | None = None) -> datetime:
    """Lower bound of span and log lists: the asked start, or a day back; not below
    ``max_hours`` before now where that is given."""
    asked = start if start is not None else now - timedelta(hours=DEFAULT_LIST_HOURS)
    return asked if max_hours is None else max(asked, now - timedelta(hours=max_hours))


def metric_window(
    now: datetime,
    hours: float | None,
    default_hours: float,
    max_hours: float | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
) -> Window:
    """From ``start``, or ``hours`` back, to ``end`` or now; at most ``max_hours`` if given."""
    hi = end if end is not None else now
    if start is None:
        start = hi - timedelta(hours=default_hours if hours is None else hours)
    return Window(start if max_hours is None else max(start, hi - timedelta(hours=max_hours)), hi)


def output_bucket_secs(span_secs: float, base: float = BUCKET_SECS) -> float:
    """Width that keeps a chart near TARGET_POINTS, in whole multiples of the base."""
    if base <= 0 or span_secs <= 0:
        return base
    return base * max(1, math.ceil(span_secs / base / TARGET_POINTS))


def window_bucket_secs(window: Window, base: float = BUCKET_SECS) -> float:
    return output_bucket_secs(float(int((window.hi - window.lo).total_seconds())), base)
