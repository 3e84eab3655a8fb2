"""Retention windows, as row filters and as sweeps over partitioned tables."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.times import instant

MAX_SWEEP_AGE_SECS = 7200
RETIRED = "_retired_"


@dataclass(frozen=True)
class Windows:
    """Days per history table; None falls back to the default, zero or less keeps all."""

    spans_days: int | None = None
    logs_days: int | None = None
    rollups_days: int | None = None


class Target(NamedTuple):
    table: str
    column: str
    cutoff: datetime


class SweepError(RuntimeError):
    """Some table failed; the others were swept."""

    def __init__(self, causes: dict[str, Exception], pruned: dict[str, int]):
        super().__init__("retention incomplete; failed tables: " + "; ".join(f"{t} ({e})" for t, e in causes.items()))
        self.failed, self.causes, self.pruned = list(causes), causes, pruned


def loop_enabled(days: int) -> bool:
    """The timed sweep does not run at all without a default window."""
    return days > 0


def targets(now: datetime, days: int, raw_hours: int, windows: Windows = Windows()) -> list[Target]:
    out = []
    for table, column, override in (
        ("spans", "start_time", windows.spans_days),
        ("logs", "time", windows.logs_days),
        ("metric_series_rollups", "bucket", windows.rollups_days),
    ):
        span = days if override is None else override
        if span > 0:
            out.append(Target(table, column, now - timedelta(days=span)))
    if raw_hours > 0:
        out.append(Target("metrics", "time", now - timedelta(hours=raw_hours)))
    return out


def split_expired(df: DataFrame, column: str, cutoff: datetime) -> tuple[DataFrame, DataFrame]:
    """Rows to keep and rows strictly older than the cutoff."""
    expired = F.col(column) < instant(cutoff)
    return df.where(~expired), df.where(expired)


def prune(tables: dict[str, DataFrame], now: datetime, days: int, raw_hours: int, windows: Windows = Windows()):
    """Kept rows of every table (tables without a window pass through)."""
    kept = dict(tables)
    for target in targets(now, days, raw_hours, windows):
        if target.table in kept:
            kept[target.table] = split_expired(kept[target.table], target.column, target.cutoff)[0]
    return kept


def _move(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise OSError(f"could not rename {source} to {target}")


def _remove(fs, path) -> None:
    if not fs.delete(path, True):
        raise OSError(f"could not delete {path}")


def _recover(fs, path_of, names: list[str]) -> None:
    """Finish or undo the replacement of a day that an earlier sweep left half done."""
    for name in names:
        if name.startswith(RETIRED):
            day = name.removeprefix(RETIRED)
            if day in names:
                _remove(fs, path_of(name))
            else:
                _move(fs, path_of(name), path_of(day))


def sweep_table(spark: SparkSession, path: str, column: str, cutoff: datetime, date_column: str = "date") -> int:
    """Prune a table stored by date: whole days are dropped, the boundary day is rewritten.

    Only the boundary day's data is written, with the folders it has below the day. The
    new day lands beside the table first; the old day steps aside by rename and goes last,
    and a rename or delete that does not succeed ends the sweep, so a sweep that dies on
    the way loses nothing: the next one restores or removes what is left over.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path_of(name: str):
        return hadoop.Path(root, name)

    def names(of=root) -> list[str]:
        return [status.getPath().getName() for status in fs.listStatus(of)]

    _recover(fs, path_of, names())
    if not any(name.startswith(f"{date_column}=") for name in names()):
        return 0
    old_days = spark.read.parquet(path).where(F.col(date_column) <= F.lit(cutoff.date()))
    kept, expired = split_expired(old_days, column, cutoff)
    pruned = expired.count()
    if not pruned:
        return 0
    day = f"{date_column}={cutoff.date().isoformat()}"
    if day in names():
        staged, retired = path_of(f"_staged_{day}"), path_of(f"{RETIRED}{day}")
        below = {name.partition("=")[0] for name in names(path_of(day)) if "=" in name}
        boundary = kept.where(F.col(date_column) == F.lit(cutoff.date())).drop(date_column)
        if boundary.isEmpty():
            _remove(fs, path_of(day))
        else:
            boundary.write.mode("overwrite").partitionBy(*below).parquet(staged.toString())
            _move(fs, path_of(day), retired)
            _move(fs, staged, path_of(day))
            _remove(fs, retired)
    for name in names():
        if name.startswith(f"{date_column}=") and name < day:
            _remove(fs, path_of(name))
    return pruned


def sweep(
    spark: SparkSession,
    paths: dict[str, str],
    now: datetime,
    days: int,
    raw_hours: int,
    windows: Windows = Windows(),
) -> dict[str, int]:
    """Sweep every table; one failing table does not stop the others, but fails the sweep."""
    pruned, causes = {}, {}
    for target in targets(now, days, raw_hours, windows):
        if target.table not in paths:
            continue
        try:
            pruned[target.table] = sweep_table(spark, paths[target.table], target.column, target.cutoff)
        except Exception as error:  # noqa: BLE001 - reported below, after the other tables
            causes[target.table] = error
    if causes:
        raise SweepError(causes, pruned) from next(iter(causes.values()))
    return pruned


def stalled(sweeps: DataFrame, started_at: datetime, now: datetime, max_age_secs: int = MAX_SWEEP_AGE_SECS) -> DataFrame:
    """Whether the last successful sweep (else the start) is too long ago.

    ``sweeps`` is a log of (finished_at, ok, rows).
    """
    last = sweeps.agg(
        F.max(F.when(F.col("ok"), F.col("finished_at"))).alias("last_success"),
        F.max_by("rows", F.when(F.col("ok"), F.col("finished_at"))).alias("last_rows"),
    )
    since = F.coalesce("last_success", instant(started_at))
    age = F.unix_seconds(instant(now)) - F.unix_seconds(since)
    return last.select("last_success", "last_rows", age.alias("age_secs"), (age > max_age_secs).alias("stalled"))
