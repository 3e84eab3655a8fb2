"""Small row-level rules used by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ERROR_STATUS = 2

# Span kinds by their number.
SPAN_KINDS = ["unspecified", "internal", "server", "client", "producer", "consumer"]


def is_error(status_code: Column) -> Column:
    return F.coalesce(status_code == ERROR_STATUS, F.lit(False))


def breached(value: Column, comparator: Column, threshold: Column) -> Column:
    """Strictly beyond the threshold. No value, or not a number, never breaches."""
    usable = value.isNotNull() & ~F.isnan(value)
    beyond = F.when(comparator == "gt", value > threshold).when(comparator == "lt", value < threshold)
    return F.coalesce(usable & beyond, F.lit(False))


def severity_class(number: Column) -> Column:
    return (
        F.when(number.isNull(), F.lit(""))
        .when(number >= 17, "error")
        .when(number >= 13, "warn")
        .when(number >= 9, "info")
        .otherwise("debug")
    )


def span_kind_label(kind: Column) -> Column:
    names = F.array(*[F.lit(k) for k in SPAN_KINDS])
    return F.when(kind.isNotNull(), F.coalesce(F.get(names, kind), kind.cast("string")))


def status_label(code: Column) -> Column:
    return F.when(code == ERROR_STATUS, "error").when(code == 1, "ok").otherwise("unset")
