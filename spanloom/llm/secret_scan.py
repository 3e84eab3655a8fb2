"""Secrets in texts: fixed formats, and strings whose characters look drawn at random.

The second part slides a window over each candidate string and keeps the counts of the
characters in it; one character comes in, one goes out, and the sum of c * log2(c) that the
Shannon entropy needs changes by those two counts alone. Each character class (hex of each case, base64)
has its own threshold, and allow-listed shapes are passed over. All of it is column
expressions within the row, so it needs no shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.shared import apart, let, matches, spans_of

KINDS = ["assign", "access", "hex", "entropy"]
WINDOW = 20

# Possessive forms of the base patterns: they match the same strings without backtracking.
ASSIGN = (
    r"""(?:(?i:password|passwd|secret|token|api_?key))["']?+\x20*+[:=]\x20*+["']?+(?:[A-Za-z0-9+/_.=-]++)"""
)
ASSIGN_VALUE = r"""^[A-Za-z_]++["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)$"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"[0-9a-f]{16,}+"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"

#: (name, alphabet, least entropy in bits over a window of 20 characters)
CLASSES = [
    ("hex", "0123456789abcdef", 3.0),
    ("upper hex", "0123456789ABCDEF", 3.0),
    ("mixed hex", "0123456789abcdefABCDEF", 3.2),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.9),
]

# A part of a path reads as words and numbers; drawn characters change case and sort anywhere.
_WORD = r"(?:(?:[A-Z][a-z]{2,}+){2,4}+|[A-Z]?+[a-z]++|[A-Z]++)[0-9]{0,4}+|[0-9]++"
_PART = rf"[._-]*+(?:{_WORD})(?:[._-]++(?:{_WORD}))*+[._-]*+"

#: Shapes that are no secrets: plain words and compounds, numbers, UUIDs, paths, rulers.
#: Repeats are possessive, which Java matches in a loop; it recurses for others, a frame a repeat.
ALLOWED = [
    r"^[A-Za-z]*+$",
    r"^[0-9+/_=-]*+$",
    r"^[A-Za-z]++(?:[-_/][A-Za-z]++)*+[-_/]?+$",
    r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
    rf"^/?+(?:{_PART}/){{2,}}+(?:{_PART})?+$",
]


def base_spans(text: Column) -> Column:
    """(kind, start, end) of the fixed formats, ordered by start, then kind."""
    assign = F.filter(
        matches(text, ASSIGN), lambda m: F.char_length(F.regexp_extract(m["match"], ASSIGN_VALUE, 1)) >= 12
    )
    access = F.filter(matches(text, ACCESS), lambda m: F.char_length(m["match"]) >= 18)
    return in_order(F.concat(spans_of(assign, 0), spans_of(access, 1), spans_of(matches(text, HEX), 2)))


def in_order(spans: Column) -> Column:
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.transform(
        F.sort_array(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    )


def top_entropy(text: Column, alphabet: str, window: int = WINDOW) -> Column:
    """The greatest Shannon entropy, in bits, of ``window`` adjacent characters that all
    belong to ``alphabet``; 0 if there is no such stretch."""
    parts = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])
    none = F.array_repeat(F.lit(0), len(alphabet) + 1)
    # The text is cut into characters once; looking one up by its place would walk there each time.
    places = F.transform(F.split(text, ""), lambda c: F.when(c != "", F.instr(F.lit(alphabet), c)).otherwise(0))

    def moved(acc: Column, came: Column, went: Column) -> Column:
        """Counts and their sum after one character came in and, if any, one went out."""
        here = F.get(acc["counts"], came)
        grown = acc["sum"] + F.get(parts, here + 1) - F.get(parts, here)
        left = F.get(acc["counts"], went) + F.when(went == came, 1).otherwise(0)
        sum_ = F.when(went > 0, grown + F.get(parts, left - 1) - F.get(parts, left)).otherwise(grown)
        counts = F.transform(
            acc["counts"],
            lambda n, k: n
            + F.when(k == came, 1).otherwise(0)
            - F.when((went > 0) & (k == went), 1).otherwise(0),
        )
        length = F.least(acc["length"] + 1, F.lit(window))
        entropy = F.when(length == window, F.lit(math.log2(window)) - sum_ / window).otherwise(0.0)
        return F.struct(
            length.alias("length"),
            counts.alias("counts"),
            sum_.alias("sum"),
            F.greatest(acc["best"], entropy).alias("best"),
        )

    def slid(places: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            came = F.get(places, i)
            went = F.when(acc["length"] >= window, F.get(places, i - window)).otherwise(0)
            both = F.struct(came.alias("came"), went.alias("went"))
            emptied = F.struct(
                F.lit(0).alias("length"), none.alias("counts"), F.lit(0.0).alias("sum"), acc["best"].alias("best")
            )
            return let(both, lambda b: F.when(b["came"] > 0, moved(acc, b["came"], b["went"])).otherwise(emptied))

        start = F.struct(
            F.lit(0).alias("length"), none.alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best")
        )
        return F.aggregate(F.sequence(F.lit(0), F.size(places) - 1), start, step)["best"]

    return F.when(F.char_length(text) >= window, let(places, slid)).otherwise(0.0)


def entropy_spans(text: Column, classes=None, allowed: list[str] | None = None) -> Column:
    """Candidates whose entropy reaches the threshold of a class, allow-listed ones left out."""
    allowed = ALLOWED if allowed is None else allowed

    def suspect(m: Column) -> Column:
        known = F.lit(False)
        for shape in allowed:
            known = known | m["match"].rlike(shape)
        high = F.lit(False)
        for _, alphabet, least in CLASSES if classes is None else classes:
            high = high | (top_entropy(m["match"], alphabet) >= least)
        return ~known & high

    likely = text.rlike(r"[A-Za-z0-9+/_=-]{20}")
    empty = spans_of(matches(F.lit(""), CANDIDATE), 3)
    return F.when(likely, spans_of(F.filter(matches(text, CANDIDATE), suspect), 3)).otherwise(empty)


def scan(docs: DataFrame, classes=None, allowed: list[str] | None = None) -> DataFrame:
    """doc_id, base and spans for every row: arrays of (kind, start, end).

    ``kind`` is an index into ``KINDS``. ``spans`` holds the base spans and the suspects that
    overlap none of them, by start, then kind. Null texts are empty; repeated rows appear
    again; other columns play no part.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = let(
        F.struct(base_spans(text).alias("base"), entropy_spans(text, classes, allowed).alias("more")),
        lambda r: F.struct(r["base"].alias("base"), in_order(F.concat(r["base"], apart(r["more"], r["base"]))).alias("spans")),
    )
    return docs.select("doc_id", found.alias("r")).select("doc_id", "r.*")
