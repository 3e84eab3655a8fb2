"""Time columns: nanosecond inputs, buckets, literals."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(value: datetime) -> Column:
    """A timestamp literal; naive values are UTC."""
    if value.tzinfo is None:
        value = value.replace(tzinfo=timezone.utc)
    return F.timestamp_micros(F.lit(to_micros(value)))


def to_micros(value: datetime) -> int:
    if value.tzinfo is None:
        value = value.replace(tzinfo=timezone.utc)
    whole = int(value.replace(microsecond=0).timestamp())
    return whole * 1_000_000 + value.microsecond


def newest(df, column: str) -> datetime | None:
    """Greatest time of a table as naive UTC: one aggregated row comes back."""
    micros = df.agg(F.max(F.unix_micros(F.col(column)))).first()[0]
    return None if micros is None else datetime.fromtimestamp(micros // 1_000_000, timezone.utc).replace(
        tzinfo=None, microsecond=micros % 1_000_000
    )


def nanos_to_time(nanos: Column, received: Column) -> Column:
    """Unsigned nanoseconds as text to a timestamp; past the signed range, the receive time."""
    whole = F.coalesce(nanos, F.lit("0")).try_cast("bigint")
    return F.coalesce(F.timestamp_micros(F.floor(whole / F.lit(1000).cast("decimal(4,0)")).cast("bigint")), received)


def nanos_duration_ms(start: Column, end: Column) -> Column:
    """Nanosecond difference in milliseconds, never negative."""
    zero = F.lit("0")
    begin = F.coalesce(start, zero).try_cast("decimal(20,0)")
    finish = F.coalesce(end, zero).try_cast("decimal(20,0)")
    return F.greatest(finish - begin, F.lit(0).cast("decimal(20,0)")).cast("double") / 1e6


def bucket(time: Column, width_secs: float) -> Column:
    """Start of the bucket of the given width that holds the time (integer microseconds, so exact)."""
    width = F.lit(int(round(width_secs * 1_000_000))).cast("bigint")
    micros = F.unix_micros(time)
    return F.timestamp_micros(micros - F.pmod(micros, width))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def in_range(df, time: str, lo: datetime | None = None, hi: datetime | None = None, strict: bool = False):
    """Rows with ``lo <= time <= hi`` (``lo < time`` when strict).

    Bounds are literals, so they reach the parquet scan. On a table stored by day the
    same bounds prune day folders.
    """
    by_day = "date" in df.columns
    if lo is not None:
        df = df.where(F.col(time) > instant(lo) if strict else F.col(time) >= instant(lo))
        df = df.where(F.col("date") >= F.lit(lo.date())) if by_day else df
    if hi is not None:
        df = df.where(F.col(time) <= instant(hi))
        df = df.where(F.col("date") <= F.lit(hi.date())) if by_day else df
    return df
