"""Near-duplicate lines across documents by a deletion-neighbourhood join.

A line is the words between two line feeds. A line goes if an earlier line, by document id
and then line number, has the same words or, from ``near_words`` words on, words within one
edit (a word put in, left out or replaced). Lines without words, and those of fewer than
``min_words`` if that is raised, stay.

The neighbourhood of a line is the line itself and all variants with one word left
out, as hashed keys. Lines of equal length that agree in the variant and its position differ
in that word alone, so all of them are near each other; a line that equals a variant of
a longer one is one word shorter. So every group of equal keys either is a clique or has
one centre, and an aggregate per key finds each line's earliest neighbour without pairs.

Texts are split into words once; what is kept of a line is its place, its hashes and the keys
of its halves. The words of the few lines that need comparing are fetched by their places.
Lines, half keys and variants that hold over a thousandth of their rows are joined apart, by
a broadcast of the fewer than a thousand of them, so no task gathers one.

Equal lines are one row throughout. Variants are emitted only for lines that can have a
neighbour: of two lines within one edit one half is untouched, so lines whose halves no
other line has are left out first, and the rest emit variants of the other half only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DecimalType

from spanloom.llm.shared import free_name, let, spread_join, store, words_of

MIN_WORDS = 1
NEAR_WORDS = 10
FILTER_BITS = 1 << 26

_PLACE = DecimalType(30, 0)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
# Roles of a half: of a line of the key's length (own), or of one a word longer.
_OWN_LEFT, _OWN_RIGHT, _LONG_LEFT, _LONG_RIGHT = range(4)


def _place() -> Column:
    """Orders lines: the id times 2**32 plus the number; null ids come first."""
    number = F.col("line_no").cast(DecimalType(10, 0))
    doc = F.coalesce(F.col("doc_id").cast(DecimalType(19, 0)), F.lit(str(-(1 << 63) - 1)).cast(DecimalType(19, 0)))
    return (doc * F.lit(1 << 32).cast(DecimalType(10, 0)) + number).cast(_PLACE)


def _numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, line_no, line) of all lines."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.xxhash64("text").alias("text_hash"),
        F.posexplode(F.split("text", "\n")).alias("line_no", "line"),
    )


def _worded(rows: DataFrame) -> DataFrame:
    """``line`` becomes its words with single spaces between, which h1 and h2 are hashes of."""
    shaped = rows.withColumn("words", words_of(F.col("line")))
    return shaped.withColumn("line", F.array_join("words", " ")).select(
        "*", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")
    )


def _shaped(docs: DataFrame, min_words: int, near_words: int) -> DataFrame:
    """(doc_id, text_hash, line_no, h1, h2, n, keys) of all lines that take part, without texts.

    ``keys`` are those of the halves, null for lines that only equal ones can be near to.
    """
    rows = _worded(_numbered(docs)).withColumn("n", F.size("words")).where(F.col("n") >= max(1, min_words))
    keys = F.array(*_half_keys(F.col("words"), F.col("n")))
    return rows.select(
        "doc_id", "text_hash", "line_no", "h1", "h2", "n", F.when(F.col("n") >= near_words, keys).alias("keys")
    )


def _half_keys(words: Column, n: Column) -> list[Column]:
    """Keys of the halves of a line, at its own length and as if one word were left out."""

    def key(length: Column, part: int, left: bool) -> Column:
        half = F.floor(length / 2).cast("int")
        piece = F.slice(words, 1, half) if left else F.slice(words, n - (length - half) + 1, length - half)
        return F.xxhash64(F.lit(part), length, piece)

    return [key(n, 1, True), key(n, 2, False), key(n - 1, 1, True), key(n - 1, 2, False)]


def _variants(batches):
    """Keys (v, n, i) of the lines of a batch; i is -1 where the position does not matter."""
    for batch in batches:
        out: list[tuple] = []
        for row in batch.itertuples(index=False):
            words = row.line.split(" ")
            n = len(words)
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), dtype=np.uint64, count=n)
            powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, _BASE, dtype=np.uint64))))
            upto = np.concatenate(([np.uint64(0)], np.cumsum(hashes * powers)))
            left_out = (upto[:-1] + (upto[-1] - upto[1:]) * _INVERSE).view(np.int64)
            at = np.arange(n)
            same = at[(row.own_left & (at >= n // 2)) | (row.own_right & (at < n // 2))]
            m = n - 1
            longer = at[(row.long_left & (at >= m // 2)) | (row.long_right & (at <= m // 2))]
            leaves = np.unique(left_out[longer])
            out.append((left_out[same], np.full(len(same), n), same, False, row))
            out.append((leaves, np.full(len(leaves), m), np.full(len(leaves), -1), False, row))
            if row.own_whole:
                out.append((upto[-1:].view(np.int64), np.array([n]), np.array([-1]), True, row))
        if out:
            sizes = [len(x[0]) for x in out]
            yield pd.DataFrame(
                {
                    "v": np.concatenate([x[0] for x in out]),
                    "n": np.concatenate([x[1] for x in out]),
                    "i": np.concatenate([x[2] for x in out]),
                    "whole": np.repeat([x[3] for x in out], sizes),
                    "first": np.repeat(np.array([x[4].first for x in out], dtype=object), sizes),
                    "h1": np.repeat([x[4].h1 for x in out], sizes),
                    "h2": np.repeat([x[4].h2 for x in out], sizes),
                }
            )


def within_one_edit(a, b) -> bool:
    """Levenshtein distance of two word sequences is at most one."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    start = 0
    while start < len(a) and a[start] == b[start]:
        start += 1
    skip = start + 1 if len(a) == len(b) else start
    return a[skip:] == b[start + 1 :]


def _seen(hashes: DataFrame, bits: int):
    """A test that holds for every hash of a one-column table and for few others.

    A bitmap of ``bits`` bits, built in pages and sent to the tasks: its size is fixed
    whatever the table holds. With far more hashes than bits it lets all through, and the
    join behind it does all the work.
    """
    page = 1 << 16
    column = hashes.columns[0]
    spots = hashes.select(F.col(column).bitwiseAND(F.lit(bits - 1)).alias("bit")).distinct()
    paged = spots.select(F.floor(F.col("bit") / page).alias("page"), (F.col("bit") % page).alias("at"))

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(page, dtype=np.uint8)
        flags[group["at"].to_numpy()] = 1
        return pd.DataFrame({"page": group["page"].iloc[:1], "bytes": [np.packbits(flags).tobytes()]})

    bitmap = bytearray(bits // 8)
    for row in paged.groupBy("page").applyInPandas(fill, "page bigint, bytes binary").collect():
        bitmap[row["page"] * page // 8 : (row["page"] + 1) * page // 8] = row["bytes"]
    packed = bytes(bitmap)

    @pandas_udf("boolean")
    def test(values: pd.Series) -> pd.Series:
        at = values.to_numpy() & (bits - 1)
        return pd.Series((np.frombuffer(packed, dtype=np.uint8)[at >> 3] >> (7 - (at & 7))) & 1 == 1)

    return test


def _neighbours(
    docs: DataFrame, distinct: DataFrame, filter_bits: int
) -> DataFrame:
    """(h1, h2, place): lines with the place of their earliest earlier neighbour."""

    @pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([within_one_edit(x.split(" "), y.split(" ")) for x, y in zip(a, b, strict=True)], dtype=bool)

    keyed = distinct.where(F.col("keys").isNotNull()).select("h1", F.posexplode("keys").alias("role", "key"))
    own = F.sum(F.when(F.col("role") <= _OWN_RIGHT, 1).otherwise(0))
    longer = F.sum(F.when(F.col("role") > _OWN_RIGHT, 1).otherwise(0))
    shared = keyed.groupBy("key").agg(own.alias("own"), longer.alias("longer"))
    shared = shared.where("own > 1 or (own > 0 and longer > 0)")
    shared = store(shared.withColumn("rows", F.col("own") + F.col("longer")), "halves")
    met = spread_join(keyed, shared, ["key"], "rows")
    several, both = F.col("own") > 1, (F.col("own") > 0) & (F.col("longer") > 0)
    role = F.col("role")
    flags = met.groupBy("h1").agg(
        F.max((role == _OWN_LEFT) & several).alias("own_left"),
        F.max((role == _OWN_RIGHT) & several).alias("own_right"),
        F.max((role == _LONG_LEFT) & both).alias("long_left"),
        F.max((role == _LONG_RIGHT) & both).alias("long_right"),
        F.max((role <= _OWN_RIGHT) & both).alias("own_whole"),
    )
    wanted = store(flags.join(distinct.select("h1", "h2", "first"), "h1"), "wanted")
    here = _numbered(docs).withColumn("place", _place())
    here = here.where(_seen(wanted.select(F.xxhash64("first").alias("spot")), filter_bits)(F.xxhash64("place")))
    texts = _worded(here).select("place", "h1", "h2", "line").join(wanted, ["h1", "h2"])
    # Rows that repeat an id and a line share the place of that line.
    texts = store(texts.where(F.col("place") == F.col("first")).drop("place").dropDuplicates(["h1", "h2"]), "lines")

    kind = "v bigint, n int, i int, whole boolean, first decimal(30,0), h1 bigint, h2 bigint"
    variants = store(texts.mapInPandas(_variants, kind), "variants")
    line = F.struct("first", "h1", "h2")
    groups = variants.groupBy("v", "n", "i").agg(
        F.count("*").alias("size"),
        F.min(line).alias("any"),
        F.min(F.when(F.col("whole"), line)).alias("centre"),
        F.min(F.when(~F.col("whole"), line)).alias("leaf"),
    )
    both = spread_join(variants, store(groups.where("size > 1"), "groups"), ["v", "n", "i"], "size")
    other = F.when(F.col("i") >= 0, F.col("any")).when(F.col("whole"), F.col("leaf")).otherwise(F.col("centre"))
    found = both.select("h1", "h2", "first", other.alias("other")).where(F.col("other.first") < F.col("first"))
    found = found.groupBy("h1", "h2").agg(F.min("other").alias("other"))
    here = texts.select("h1", "h2", "line")
    there = texts.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("line").alias("earlier"))
    pairs = found.select("h1", "h2", "other.first", F.col("other.h1").alias("o1"), F.col("other.h2").alias("o2"))
    checked = pairs.join(here, ["h1", "h2"]).join(there, ["o1", "o2"]).where(near("line", "earlier"))
    return checked.select("h1", "h2", F.col("first").alias("place"))


def repeated_lines(
    docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """(doc_id, text_hash, removed): the sorted numbers, from 0, of the lines that go.

    Only documents that lose a line appear. Rows that repeat an id and a text share their
    places, so neither loses a line to the other, and get one row here.
    """
    all_lines = store(_shaped(docs, min_words, near_words), "shapes").withColumn("place", _place())
    keys = [F.min(F.col("keys")[i]).alias(f"k{i}") for i in range(4)]
    distinct = all_lines.groupBy("h1", "h2").agg(F.count("*").alias("times"), F.min("place").alias("first"), *keys)
    distinct = store(
        distinct.select(
            "h1", "h2", "times", "first", F.when(F.col("k0").isNotNull(), F.array("k0", "k1", "k2", "k3")).alias("keys")
        ),
        "distinct",
    )
    near = _neighbours(docs, distinct, filter_bits).withColumn("times", F.lit(0).cast("bigint"))
    again = distinct.where("times > 1").select("h1", "h2", F.col("first").alias("place"), "times")
    # A line that only has near ones stands once in all.
    bounds = again.union(near).groupBy("h1", "h2").agg(F.min("place").alias("earliest"), F.max("times").alias("times"))
    gone = spread_join(all_lines.drop("keys"), store(bounds, "bounds"), ["h1", "h2"], "times")
    gone = gone.where(F.col("place") > F.col("earliest"))
    return gone.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))


def _without(text: Column, removed: Column) -> Column:
    kept = let(removed, lambda r: F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(r, i)))
    return F.array_join(kept, "\n")


def deduplicate(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """``docs`` without repeated lines; rows that lose their last line with a word go.

    Rows that lose nothing, null and empty texts too, come back as they are, with all
    columns; ``n_chars`` follows the text if there is such a column.
    """
    doc, digest, removed, new = (free_name(x, docs.columns) for x in ("_doc", "_digest", "_removed", "_new"))
    gone = repeated_lines(docs, min_words, near_words).toDF(doc, digest, removed)
    same = docs["doc_id"].cast("bigint").eqNullSafe(gone[doc]) & (F.xxhash64(docs["text"]) == gone[digest])
    both = docs.join(gone, same, "left").withColumn(
        new, F.when(F.col(removed).isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col(removed)))
    )
    left = F.col(removed).isNull() | (F.btrim(F.col(new), F.lit(" \t\n\x0b\x0c\r")) != "")
    out = []
    for column, kind in docs.dtypes:
        if column == "text":
            out.append(F.col(new).alias("text"))
        elif column == "n_chars":
            length = F.char_length(F.col(new)).cast(kind)
            out.append(F.when(F.col(removed).isNull(), F.col("n_chars")).otherwise(length).alias("n_chars"))
        else:
            out.append(docs[f"`{column}`"])
    return both.where(left).select(*out)
