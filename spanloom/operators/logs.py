"""Log search."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom import params
from spanloom.functions import attributes as at
from spanloom.functions.times import in_range


def filter_logs(
    logs: DataFrame,
    now: datetime,
    *,
    service: str | None = None,
    trace_id: str | None = None,
    span_id: str | None = None,
    text: str | None = None,
    attr: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    max_hours: int | None = None,
) -> DataFrame:
    rows = in_range(logs, "time", params.list_floor(now, start, max_hours), end)
    for column, wanted in (("service", service), ("trace_id", trace_id), ("span_id", span_id)):
        if wanted is not None:
            rows = rows.where(F.col(column) == wanted)
    if text is not None:
        rows = rows.where(F.col("body").ilike(at.ilike_pattern(text)))
    pair = at.equals_filter(F.col("attributes"), attr)
    return rows if pair is None else rows.where(pair)


def search_logs(logs: DataFrame, now: datetime, *, limit: int | None = None, **filters) -> DataFrame:
    """Newest matching records first; with a limit a distributed top-k, not a full sort."""
    rows = filter_logs(logs, now, **filters)
    order = [F.desc("time"), F.col("trace_id"), F.col("span_id"), F.col("body")]
    return params.top(rows.orderBy(*order), limit)
