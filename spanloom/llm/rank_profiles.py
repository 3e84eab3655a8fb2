"""Language identification by rank-order profiles of character n-grams.

A text is lower-cased; its letters count, every run of other characters is one space, also
before the first and after the last word. Its n-grams are the one to three adjacent
characters that hold a letter and no space between two letters. Three characters of 21 bits
fit a 63-bit integer, so counting is sorting of integers.

A language's profile lists its ``size`` most frequent n-grams over all training texts, a
document's profile its own; ties go by the n-gram. The out-of-place distance adds up, over
the document's list, how far each n-gram's rank is from its rank in the language's list,
``size`` where that lacks it. The nearest language is the prediction (ties: the least name).

All training rows count: tasks add up their n-grams, Spark adds the sums by (language,
n-gram) and keeps the first ``size`` ranks before the rows move. The driver sees ``size`` rows a language; more than
``MAX_LANGUAGES`` languages are an error, none is dropped.

Defined cases: a text that is null or has no letter is ``und`` with score 0, so is every text
if nothing was learned. Null ids count as an empty text in the split. Repeated rows count each
time. Columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.shared import store

SIZE = 400
MAX_LANGUAGES = 5_000
UNKNOWN = "und"
_BITS = 21
_FLUSH = 1 << 20
_letters: dict[str, np.ndarray] = {}


@dataclass(frozen=True)
class Profiles:
    """``ranks[g, l]`` is the rank of n-gram ``grams[g]`` in language l, -1 where it has none."""

    languages: tuple[str, ...]
    grams: np.ndarray
    ranks: np.ndarray
    size: int


def _is_letter() -> np.ndarray:
    """Which code points are letters, one table per worker."""
    if "table" not in _letters:
        _letters["table"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters["table"]


def grams_of(text: str | None) -> np.ndarray:
    """All n-grams of the text as integers, repeats included; none if it has no letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _is_letter()[points]
    if not letter.any():
        return np.zeros(0, dtype=np.int64)
    letter = np.concatenate([[False], letter, [False]])
    kept = letter | np.concatenate([[True], letter[:-1]])
    c = np.where(letter[1:-1], points, 32).astype(np.int64)
    c = np.concatenate([[32], c, [32]])[kept]
    if c[-1] != 32:
        c = np.append(c, 32)
    letter = c != 32
    two = (c[:-1] << _BITS) | c[1:]
    three = (two[:-1] << _BITS) | c[2:]
    return np.concatenate([c[letter], two[letter[:-1] | letter[1:]], three[letter[1:-1]]])


def _top(grams: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent of the n-grams in rank order."""
    found, times = np.unique(grams, return_counts=True)
    return found[np.lexsort((found, -times))[:size]]


# -- profiles ---------------------------------------------------------------------------


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, lang) rows -> (lang, gram, times), added up within the task up to a bound."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def add(lang: str, grams: np.ndarray, times: np.ndarray) -> None:
        known = held.get(lang)
        if known is not None:
            grams, times = np.concatenate([known[0], grams]), np.concatenate([known[1], times])
        unique, place = np.unique(grams, return_inverse=True)
        held[lang] = unique, np.bincount(place, weights=times, minlength=len(unique)).astype(np.int64)

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, (grams, times) in held.items():
            for at in range(0, len(grams), 50_000):
                some = slice(at, at + 50_000)
                columns = [pa.array([lang] * len(grams[some])), pa.array(grams[some]), pa.array(times[some])]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "times"])
        held.clear()

    for batch in batches:
        texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
        waiting: dict[str, list[np.ndarray]] = {}
        size = 0
        for at, (text, lang) in enumerate(zip(texts, langs, strict=True)):
            grams = grams_of(text)
            waiting.setdefault(lang, []).append(grams)
            size += len(grams)
            if size >= _FLUSH or at == len(texts) - 1:
                for name, parts in waiting.items():
                    joined = np.concatenate(parts)
                    add(name, joined, np.ones(len(joined)))
                waiting, size = {}, 0
        if sum(len(grams) for grams, _ in held.values()) > _FLUSH:
            yield from flush()
    yield from flush()


def fit(docs: DataFrame, size: int = SIZE) -> Profiles:
    """Profiles of every language among ``docs`` (text, lang); rows without either don't count."""
    rows = docs.select("text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counted = rows.mapInArrow(_counts, "lang string, gram bigint, times bigint").groupBy("lang", "gram")
    order = Window.partitionBy("lang").orderBy(F.desc("times"), "gram")
    ranked = counted.agg(F.sum("times").alias("times")).withColumn("rank", F.row_number().over(order))
    top = store(ranked.where(F.col("rank") <= size).select("lang", "gram", "rank"), "profiles")
    if top.select("lang").distinct().count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    found = top.toPandas()
    languages = tuple(sorted(found["lang"].unique()))
    grams = np.unique(found["gram"].to_numpy(dtype=np.int64))
    ranks = np.full((len(grams) + 1, len(languages)), -1, dtype=np.int32)
    column = {lang: k for k, lang in enumerate(languages)}
    rows_of = np.searchsorted(grams, found["gram"].to_numpy(dtype=np.int64))
    ranks[rows_of, [column[lang] for lang in found["lang"]]] = found["rank"].to_numpy() - 1
    return Profiles(languages, grams, ranks, size)


# -- prediction -------------------------------------------------------------------------


def nearest(text: str | None, profiles: Profiles) -> tuple[str, float]:
    """(language, score); the score is 1 less the distance's share of the largest possible one."""
    if text is None or not profiles.languages:
        return UNKNOWN, 0.0
    grams = grams_of(text)
    if not len(grams):
        return UNKNOWN, 0.0
    own = _top(grams, profiles.size)
    at = np.searchsorted(profiles.grams, own)
    known = at < len(profiles.grams)
    known[known] = profiles.grams[at[known]] == own[known]
    ranks = profiles.ranks[np.where(known, at, len(profiles.grams))]
    away = np.where(ranks < 0, profiles.size, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
    best = int(away.argmin())
    return profiles.languages[best], 1.0 - float(away[best]) / (profiles.size * len(own))


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    kind = dict(docs.dtypes)["doc_id"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [nearest(text, profiles) for text in batch.column("text").to_pylist()]
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(of, f"doc_id {kind}, lang_pred string, score double")


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether the row is kept from learning."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold
