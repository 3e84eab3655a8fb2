"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of a covering code over the first bits of a fingerprint: a product of
perfect binary codes (Golay [23,12] with covering radius 3, Hamming [15,11] with radius
1). Every fingerprint lies within the covering radius of exactly one word of each block, its
home. If two fingerprints differ in at most ``t`` bits, the home of either lies within radius
plus ``t`` of the other, so a fingerprint is replicated to all anchors that exceed the block
radii by at most ``t`` in sum, and each anchor compares its residents (those at home) with
its visitors. No link is lost and only fingerprints of one neighbourhood ever meet.

Equal fingerprints are one row throughout. An anchor with more than ``crowd`` residents (one
large group of near copies) would compare quadratically. Its residents link in another exact
way: two fingerprints within ``t`` bits share a point within ``ceil(t / 2)`` of both, so every one
goes to the points of that small ball around it, and those that meet at a point are
linked to one of them (for odd ``t``, to those in reach). A point sees no more fingerprints
than its ball has, whatever the size of the group.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from spanloom.llm.components import stars
from spanloom.llm.shared import free_name, store

BITS = 64
SHINGLE = 3
SEED = 42
THRESHOLD = 2
CROWD = 64
TASK_ROWS = 20_000
_BLOCK = 1 << 16
_ROWS = 2048

# Fixed values: (length, covering radius, generator polynomial) of perfect cyclic codes.
CODES = {"golay23": (23, 3, 0xC75), "hamming15": (15, 1, 0x13), "hamming7": (7, 1, 0xB)}
DEFAULT_CODE = ("golay23", "golay23")


# -- fingerprints -----------------------------------------------------------------------


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits; bit i is set if over half of the shingle hashes have it. No words: zero."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    span = min(shingle, len(words))
    starts = np.concatenate(([0], ends[: len(words) - span] + 1)).tolist()
    stops = ends[span - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(stops), _BLOCK):
        part = zip(starts[at : at + _BLOCK], stops[at : at + _BLOCK], strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in part], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.flatnonzero(2 * counts > len(stops))
    return sum(1 << int(i) for i in bits)


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a bigint with the same bits."""

    @pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        found = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64)
        return pd.Series(found.view(np.int64))

    return of(text)


# -- anchors ----------------------------------------------------------------------------


def _remainders(values: np.ndarray, length: int, poly: int) -> np.ndarray:
    degree = poly.bit_length() - 1
    rest = values.copy()
    for bit in range(length - 1, degree - 1, -1):
        rest = np.where((rest >> bit) & 1, rest ^ (poly << (bit - degree)), rest)
    return rest


@lru_cache
def _patterns(name: str, reach: int) -> list[list[np.ndarray]]:
    """For each syndrome and each excess 0..reach over the radius: the error patterns that
    lead to a code word at that distance (all distances within the radius are excess 0)."""
    length, radius, poly = CODES[name]
    out: list[list[list[int]]] = [[[] for _ in range(reach + 1)] for _ in range(1 << (poly.bit_length() - 1))]
    for weight in range(radius + reach + 1):
        errors = np.array([sum(1 << i for i in c) for c in combinations(range(length), weight)], dtype=np.int64)
        for error, syndrome in zip(errors.tolist(), _remainders(errors, length, poly).tolist(), strict=True):
            out[syndrome][max(0, weight - radius)].append(error)
    return [[np.array(p, dtype=np.int64) for p in by_excess] for by_excess in out]


def anchors_of(value: int, code: tuple[str, ...], reach: int) -> np.ndarray:
    """Anchors of a fingerprint as int64, the home first, then all within radius plus reach."""
    sums: list[np.ndarray] = [np.zeros(1, dtype=np.int64)] + [np.zeros(0, dtype=np.int64)] * reach
    shift = 0
    for name in code:
        length, _, poly = CODES[name]
        part = np.array([(value >> shift) & ((1 << length) - 1)], dtype=np.int64)
        by_excess = _patterns(name, reach)[int(_remainders(part, length, poly)[0])]
        words = [(part[0] ^ p) << shift for p in by_excess]
        sums = [
            np.concatenate([(sums[a][:, None] | words[total - a][None, :]).ravel() for a in range(total + 1)])
            for total in range(reach + 1)
        ]
        shift += length
    return np.concatenate(sums)


def replicas(prints: DataFrame, code: tuple[str, ...], reach: int) -> DataFrame:
    """(anchor, fp) for every anchor of a fingerprint within radius plus ``reach``."""

    def spread(batches):
        for batch in batches:
            for at in range(0, len(batch), _ROWS):
                part = batch["fp"].to_numpy()[at : at + _ROWS]
                found = [anchors_of(v & (2**BITS - 1), code, reach) for v in part.tolist()]
                yield pd.DataFrame(
                    {"anchor": np.concatenate(found), "fp": np.repeat(part, [len(x) for x in found])}
                )

    return prints.select("fp").mapInPandas(spread, "anchor bigint, fp bigint")


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _ball(fp: Column, radius: int) -> Column:
    """All points within ``radius`` bits, as an array."""
    masks = [sum(1 << i for i in c) for size in range(radius + 1) for c in combinations(range(BITS), size)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    return F.transform(F.array(*[F.lit(m).cast("bigint") for m in signed]), lambda m: fp.bitwiseXOR(m))


def links(
    prints: DataFrame, threshold: int = THRESHOLD, code: tuple[str, ...] = DEFAULT_CODE, crowd: int = CROWD
) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs within ``threshold`` bits.

    ``prints`` has the distinct fingerprints in ``fp``. Every linked pair with a resident of
    an uncrowded anchor is an edge; residents of crowded ones are joined through points.
    """
    # A row is few bytes and much work: tasks are dealt by rows, not by bytes.
    prints = prints.select("fp").repartition(1 + prints.count() // TASK_ROWS)
    home = store(replicas(prints, code, 0), "homes")
    full = home.groupBy("anchor").count().where(F.col("count") > crowd).select("anchor")
    few = home.join(full, "anchor", "left_anti").withColumnRenamed("fp", "resident")
    # Spark sizes what Python or a generator has multiplied like its input, and would broadcast it.
    met = few.join(replicas(prints, code, threshold).hint("merge"), "anchor")
    near = met.where((F.col("fp") != F.col("resident")) & (_distance("fp", "resident") <= threshold))

    many = home.join(full, "anchor", "left_semi").select("fp")
    points = many.select("fp", F.explode(_ball(F.col("fp"), (threshold + 1) // 2)).alias("point"))
    if threshold % 2 == 0:
        # Everything in the ball of a point is within the threshold of everything else there.
        other = points.groupBy("point").agg(F.min("fp").alias("resident"))
    else:
        other = points.withColumnRenamed("fp", "resident")
    tied = points.join(other.hint("merge"), "point").where(
        (F.col("fp") != F.col("resident")) & (_distance("fp", "resident") <= threshold)
    )
    return near.select(F.col("fp").alias("a"), F.col("resident").alias("b")).union(tied.select("fp", "resident"))


def classified(
    docs: DataFrame,
    threshold: int = THRESHOLD,
    shingle: int = SHINGLE,
    code: tuple[str, ...] = DEFAULT_CODE,
    crowd: int = CROWD,
) -> DataFrame:
    """doc_id, text_hash, fp and root for every row; equal roots are one component."""
    rows = store(
        docs.select("doc_id", F.xxhash64("text").alias("text_hash"), fingerprints(F.col("text"), shingle).alias("fp")),
        "fingerprints",
    )
    prints = store(rows.select("fp").distinct(), "prints")
    roots = stars(links(prints, threshold, code, crowd)).withColumnRenamed("node", "fp")
    return rows.join(roots, "fp", "left").select("doc_id", "text_hash", "fp", F.coalesce("root", "fp").alias("root"))


def classes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, fp and component_id (least doc_id reachable) for every row of ``docs``.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows
    appear again with equal results; a null doc_id never names a component that has
    another one.
    """
    rows = classified(docs, **options)
    # Stored, so that the join has plain exchanges on both sides and a large component can be
    # split; right above an aggregate it could not.
    least = store(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    return rows.join(least, "root").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, **options) -> DataFrame:
    """One row of ``docs`` for each component, with all columns: the one of the least doc_id.

    Null ids come last; rows that repeat an id are told apart by a hash of the text, and
    of rows equal in both any one stays.
    """
    doc, digest, first = (free_name(x, docs.columns) for x in ("_doc", "_digest", "_first"))
    rows = classified(docs, **options)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    least = rows.groupBy("root").agg(F.min(order).alias(first)).select(f"{first}.doc_id", f"{first}.text_hash")
    chosen = least.distinct().toDF(doc, digest)
    hashed = docs.withColumn(first, F.xxhash64("text"))
    same = hashed["doc_id"].eqNullSafe(chosen[doc]) & (hashed[first] == chosen[digest])
    return hashed.join(chosen, same, "left_semi").dropDuplicates(["doc_id", first]).drop(first)
