"""Attributes: maps from key to JSON fragment, their canonical text and predicates."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

# Resource keys that name a workload, in order of preference.
WORKLOAD_KEYS = [
    "k8s.deployment.name",
    "k8s.statefulset.name",
    "k8s.daemonset.name",
    "k8s.cronjob.name",
    "k8s.pod.name",
]
UNKNOWN_SERVICE_PREFIX = "unknown_service"


def json_string(text: Column) -> Column:
    """A text as a JSON string literal; only texts that need escapes go through the writer."""
    escaped = F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")
    return F.when(text.rlike(r'["\\\x00-\x1f]'), escaped).otherwise(F.concat(F.lit('"'), text, F.lit('"')))


def fragment_text(fragment: Column) -> Column:
    """A JSON fragment as text: strings lose their quotes, JSON null becomes NULL."""
    return (
        F.when(fragment == "null", F.lit(None).cast("string"))
        .when(~fragment.startswith('"'), fragment)
        .otherwise(_unquoted(fragment))
    )


def _unquoted(literal: Column) -> Column:
    """The text of a JSON string literal; only literals with escapes are parsed."""
    parsed = F.get_json_object(F.concat(F.lit("["), literal, F.lit("]")), "$[0]")
    return F.when(literal.contains("\\"), parsed).otherwise(F.substring(literal, F.lit(2), F.length(literal) - 2))


def canonical_json(attributes: Column) -> Column:
    """One text per attribute set: keys by length then bytes, so equal sets give equal text."""
    entries = F.transform(
        F.map_entries(attributes),
        lambda e: F.struct(F.octet_length(e["key"]).alias("n"), e["key"].alias("k"), e["value"].alias("v")),
    )
    pairs = F.transform(
        F.array_sort(entries),
        lambda e: F.concat(json_string(e["k"]), F.lit(": "), F.coalesce(e["v"], F.lit("null"))),
    )
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def series_key(service: Column, attrs_json: Column) -> Column:
    return F.md5(F.concat(F.coalesce(service, F.lit("")), F.lit("|"), attrs_json))


def merge(base: Column, overlay: Column) -> Column:
    """Union of two attribute maps; the overlay wins."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(overlay, k)), overlay)


def string_attr(attributes: Column, key: str) -> Column:
    """Value of a key if it is a non-empty string."""
    fragment = attributes[key]
    return F.when(fragment.startswith('"') & (fragment != '""'), _unquoted(fragment))


def resolve_service(attributes: Column, default: str | None = None) -> Column:
    named = string_attr(attributes, "service.name")
    options = [F.when(~named.startswith(UNKNOWN_SERVICE_PREFIX), named)]
    options += [string_attr(attributes, key) for key in WORKLOAD_KEYS]
    options.append(F.lit(default or None).cast("string"))
    return F.coalesce(*options)


def equals_filter(attributes: Column, expression: str | None) -> Column | None:
    """Predicate of a ``key=value`` filter; None when the text holds no usable pair."""
    key, sign, value = (expression or "").partition("=")
    if not sign or not key:
        return None
    return F.coalesce(attributes[key] == json.dumps(value, ensure_ascii=False), F.lit(False))


def contains_scalars(attributes: Column, wanted: Column) -> Column:
    """Every wanted pair is present with exactly that fragment."""
    return F.forall(F.map_entries(wanted), lambda e: attributes[e["key"]].eqNullSafe(e["value"]))


def has_nested(wanted: Column) -> Column:
    """Some wanted value is an object or an array, which compares by containment."""
    return F.exists(F.map_values(wanted), lambda v: v.startswith("{") | v.startswith("["))


def _holds(actual, wanted) -> bool:
    if isinstance(wanted, dict):
        return isinstance(actual, dict) and all(k in actual and _holds(actual[k], v) for k, v in wanted.items())
    if isinstance(wanted, list):
        return isinstance(actual, list) and all(any(_holds(a, w) for a in actual) for w in wanted)
    return isinstance(actual, bool) == isinstance(wanted, bool) and actual == wanted


@F.pandas_udf(BooleanType())
def contains_nested(attributes: pd.Series, wanted: pd.Series) -> pd.Series:
    """Containment with nested objects and arrays, over the JSON texts of both sides."""
    return pd.Series([_holds(json.loads(a), json.loads(w)) for a, w in zip(attributes, wanted)])


def short_key(key: Column) -> Column:
    return F.regexp_replace(key, r"^k8s\.", "")


def ilike_pattern(text: str) -> str:
    """Substring pattern where % and _ stay wildcards and a stray backslash is literal.

    A backslash escapes the next character; Spark accepts that only before % _ and
    itself, so an escape of any other character is reduced to that character.
    """
    pattern = "%" + text + "%"
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            following = pattern[i + 1]
            out.append(("\\" if following in "%_\\" else "") + following)
            i += 2
        else:
            out.append(ch)
            i += 1
    return "".join(out)
