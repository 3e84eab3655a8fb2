"""Blocks the operators share: local names in columns, stored tables, running sums, words."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.session import ensure_checkpoint_dir

SPACES = " \t\n\x0b\x0c\r"
SUM_CHUNK = 256
ROW_GROUP = 16 << 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once however often the body names it.

    A column named twice, or named inside a lambda, may be computed again for each use
    once Catalyst has merged projections; a lambda's own variable never is.
    """
    return F.transform(F.array(value), body)[0]


def free_name(wanted: str, taken: Iterable[str]) -> str:
    """``wanted`` or a longer name that no column has (names compare without case)."""
    used = {name.lower() for name in taken}
    while wanted.lower() in used:
        wanted += "_"
    return wanted


def store(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written as Parquet below the session's checkpoint folder and reread.

    This cuts the lineage in storage that all executors share. The folder belongs to the
    run; whoever cleans ``spark.checkpoint.dir`` removes it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    # A writer holds a whole row group per core, and rows may hold texts.
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_join(rows: DataFrame, keyed: DataFrame, keys: list[str], times: str, least: int = 1000) -> DataFrame:
    """``rows`` joined with ``keyed`` on ``keys`` (no nulls), where a key may hold any share of the rows.

    ``keyed`` has one row per key and in ``times`` no more than the key's rows. Both are read
    twice, so they should be stored. Keys of over a thousandth of all rows, and over
    ``least``, number fewer than a thousand: these are broadcast and their rows stay where they are.
    """
    total = rows.count()
    large = F.col(times) > max(least, total // 1000)
    hot = F.broadcast(keyed.where(large))
    cold = rows.join(F.broadcast(keyed.where(large).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(cold.join(keyed.where(~large), keys))


def small_batches(spark: SparkSession) -> SparkSession:
    """Bound what goes to Python at once: rows hold whole texts, so few of them suffice.

    The settings hold for the session; they change no result.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def shared_folder(spark: SparkSession) -> str:
    return ensure_checkpoint_dir(spark).rstrip("/")


def words_of(text: Column) -> Column:
    """The runs of characters other than space and U+0009 to U+000D, as an array (null: none)."""
    spaced = F.coalesce(text, F.lit(""))
    for space in SPACES[1:]:
        spaced = F.replace(spaced, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def running_sums(numbers: Column) -> Column:
    """Inclusive running sums of an array<bigint>, in time that stays near linear.

    Appending to an array copies it, so a plain fold would be quadratic; here the folds
    cover chunks of a fixed length, and one more fold covers the chunk totals.
    """
    zero = F.lit(0).cast("bigint")
    none = F.array().cast("array<bigint>")

    def scan(part: Column, start: Column) -> Column:
        seed = F.struct(start.alias("sum"), none.alias("all"))
        step = lambda acc, x: F.struct(
            (acc["sum"] + x).alias("sum"), F.concat(acc["all"], F.array(acc["sum"] + x)).alias("all")
        )
        return F.aggregate(part, seed, step)["all"]

    def chunked(values: Column) -> Column:
        parts = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(values) - 1) / SUM_CHUNK).cast("int")),
            lambda c: F.slice(values, c * SUM_CHUNK + 1, SUM_CHUNK),
        )
        totals = lambda ps: F.transform(ps, lambda p: F.aggregate(p, zero, lambda a, x: a + x))
        both = let(parts, lambda ps: F.struct(ps.alias("parts"), scan(totals(ps), zero).alias("upto")))
        return let(
            both,
            lambda b: F.flatten(
                F.transform(
                    b["parts"], lambda p, c: scan(p, F.when(c == 0, zero).otherwise(F.get(b["upto"], c - 1)))
                )
            ),
        )

    return F.when(F.size(numbers) > 0, let(numbers, chunked)).otherwise(none)


_MATCHES = "array<struct<start:bigint,end:bigint,match:string,before:string,after:string>>"


def matches(text: Column, pattern: str, context: int = 24) -> Column:
    """All matches of a Java pattern, leftmost and non-overlapping, with their places.

    Array of (start, end, match, before, after): positions count code points, the end is
    exclusive; before and after are up to ``context`` characters beside the match, not
    reaching into the neighbouring ones. The pattern must not match an empty string. The text
    between matches comes from ``split`` by the same pattern, which searches in the same
    way, so match ``k`` starts after the first ``k + 1`` gaps and the ``k`` matches before it.
    """

    def placed(parts: Column) -> Column:
        length = lambda x: F.char_length(x).cast("bigint")
        found, gaps = parts["found"], parts["gaps"]
        steps = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda gap, m: length(gap) + length(m))
        return let(
            running_sums(steps),
            lambda ends: F.transform(
                found,
                lambda m, k: F.struct(
                    (F.get(ends, k) - length(m)).alias("start"),
                    F.get(ends, k).alias("end"),
                    m.alias("match"),
                    F.right(F.get(gaps, k), F.lit(context)).alias("before"),
                    F.left(F.get(gaps, k + 1), F.lit(context)).alias("after"),
                ),
            ),
        )

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(
        found,
        lambda f: F.when(
            F.size(f) > 0,
            let(F.struct(f.alias("found"), F.split(text, pattern, -1).alias("gaps")), placed),
        ).otherwise(F.array().cast(_MATCHES)),
    ).cast(_MATCHES)


_SPANS = "array<struct<kind:int,start:bigint,end:bigint>>"


def spans_of(found: Column, kind: int) -> Column:
    """(kind, start, end) of an array of matches."""
    return F.transform(
        found, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"))
    ).cast(_SPANS)


def apart(spans: Column, others: Column) -> Column:
    """Those of ``spans`` that overlap none of ``others``."""
    return F.filter(
        spans, lambda s: ~F.exists(others, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]))
    )


def spans_text(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` of each span in the given order, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )
