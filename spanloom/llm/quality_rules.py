"""Learned decision lists over text statistics.

Sequential covering on labelled statistics: grow a conjunction of thresholds on two thirds of
the rows that no rule covers yet, prune its last conditions on the other third, keep it
if it is precise enough there, and go on with what is left. The list becomes one ordered
``CASE WHEN`` that Spark evaluates in the same pass as the statistics.

The learner takes a bounded sample of labelled rows (``fit_rows``); the statistics and the
rules cover every row and the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.shared import SPACES, free_name, let, words_of

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
FIT_ROWS = 8_000

# Ratios the rules may test; each is a plain function of the counts.
FEATURES = {
    "n_words": lambda s: s["n_words"],
    "word_length": lambda s: s["word_chars"] / F.greatest(s["n_words"], F.lit(1)),
    "symbol_rate": lambda s: s["n_symbols"] / F.greatest(s["n_words"], F.lit(1)),
    "dup_line_rate": lambda s: s["n_dup_lines"] / F.greatest(s["n_lines"], F.lit(1)),
    "repeat_rate": lambda s: s["n_repeat_words"] / F.greatest(s["n_words"], F.lit(1)),
    "upper_rate": lambda s: s["n_upper"] / F.greatest(s["word_chars"], F.lit(1)),
    "mark_rate": lambda s: s["n_marks"] / F.greatest(s["n_words"], F.lit(1)),
    "digit_rate": lambda s: s["n_digits"] / F.greatest(s["word_chars"], F.lit(1)),
    "line_words": lambda s: s["n_words"] / F.greatest(s["n_lines"], F.lit(1)),
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, stats: Column) -> Column:
        value = FEATURES[self.feature](stats)
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def column(self, stats: Column) -> Column:
        out = F.lit(True)
        for condition in self.conditions:
            out = out & condition.column(stats)
        return out


def _repeated_words(words: Column) -> Column:
    """Words inside windows of eight words that occur twice or more in the text."""
    # Hashes of 2, 4 and then 8 words: each round joins two neighbours of the last one.
    def joined(hashes: Column, step: int) -> Column:
        return let(hashes, lambda hs: F.transform(hs, lambda h, i: F.xxhash64(h, F.get(hs, i + step))))

    hashes = joined(joined(joined(words, 1), 2), 4)
    hashes = F.slice(hashes, 1, F.size(words) - (WINDOW - 1))

    def covered(ordered: Column) -> Column:
        """ordered: (hash, position) of all windows; equal hashes stand side by side."""
        again = F.filter(
            F.transform(
                ordered,
                lambda x, k: F.when(
                    (x["h"] == F.get(ordered, k - 1)["h"]) | (x["h"] == F.get(ordered, k + 1)["h"]), x["i"]
                ),
            ),
            lambda i: i.isNotNull(),
        )
        seed = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(
            F.sort_array(again),
            seed,
            lambda acc, i: F.struct(
                (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")
            ),
        )["n"]

    def count(hs: Column) -> Column:
        placed = F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        unique = F.size(F.array_distinct(hs)) == F.size(hs)
        return F.when(unique, F.lit(0).cast("bigint")).otherwise(let(F.sort_array(placed), covered))

    return F.when(F.size(words) > WINDOW, let(hashes, count)).otherwise(F.lit(0).cast("bigint"))


def statistics(text: Column, distinct: bool = False) -> Column:
    """Counts of one text as a struct of bigint fields (null: all zero); ``distinct`` adds
    the number of different words."""
    text = F.coalesce(text, F.lit(""))
    without = text
    for symbol in SYMBOLS:
        without = F.replace(without, F.lit(symbol), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            (F.octet_length(text) - F.octet_length(without)).cast("bigint").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            _repeated_words(w).alias("n_repeat_words"),
            F.size(lines).cast("bigint").alias("n_lines"),
            F.regexp_count(text, F.lit("[A-Z]")).cast("bigint").alias("n_upper"),
            F.regexp_count(text, F.lit("[!?]")).cast("bigint").alias("n_marks"),
            F.regexp_count(text, F.lit("[0-9]")).cast("bigint").alias("n_digits"),
            *([F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct")] if distinct else []),
        )

    return let(words_of(text), of_words)


def base_failed(stats: Column) -> Column:
    """The fixed part: under 20 words, or over 30 % of the words in repeated windows."""
    return (stats["n_words"] < MIN_WORDS) | (
        100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * stats["n_words"]
    )


def sample_labels(labels: DataFrame, fit_rows: int, label: str = "quality") -> DataFrame:
    """At most ``fit_rows`` (doc_id, label) in the order of a hash of the id.

    Rows with a null id or label, and ids with both labels, are left out.
    """
    clear = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.min(label).alias("label"), F.max(label).alias("_most"))
        .where("label = _most")
        .drop("_most")
    )
    return clear.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, **options) -> list[Rule]:
    """Rules that reject, in order. No labelled row, or no row of label 0: no rules.

    Rows that the fixed part rejects teach nothing. The features are rates that do not
    drift with the length of a text (a share of distinct words would). The statistics are computed for the sampled rows only: the sample, bounded by
    ``fit_rows``, is broadcast to one more scan of the documents.
    """
    sample = F.broadcast(sample_labels(labels, fit_rows).withColumnRenamed("doc_id", "_id"))
    texts = docs.select(F.col("doc_id"), F.col("text"))
    joined = texts.join(sample, F.col("doc_id") == F.col("_id")).select("doc_id", "label", statistics(F.col("text")).alias("s"))
    stats = F.col("s")
    columns = [make(stats).cast("double").alias(name) for name, make in FEATURES.items()]
    # As a filter this would move below the join, and so cost the statistics of every row.
    failed = base_failed(stats).alias("failed")
    found = joined.dropDuplicates(["doc_id"]).orderBy("doc_id").select("label", failed, *columns).collect()
    rows = [r for r in found if not r["failed"]]
    if not rows:
        return []
    table = np.array([[r[name] for name in FEATURES] for r in rows], dtype=float)
    return cover(table, np.array([r["label"] for r in rows]) == 0, list(FEATURES), **options)


def cover(
    table: np.ndarray,
    bad: np.ndarray,
    names: list[str],
    min_precision: float = 0.95,
    min_support: int = 5,
    max_conditions: int = 3,
    bins: int = 64,
) -> list[Rule]:
    """Sequential covering of the ``bad`` rows; every third row only prunes and judges."""
    cuts = []
    for j in range(table.shape[1]):
        values = np.unique(np.quantile(table[:, j], np.linspace(0, 1, bins + 1), method="inverted_cdf"))
        cuts.append((values[:-1] + values[1:]) / 2)
    left = np.ones(len(bad), dtype=bool)
    judge = np.arange(len(bad)) % 3 == 2
    rules: list[Rule] = []
    while (bad & left & ~judge).sum() >= min_support:
        grown = _grow(table, bad, left & ~judge, cuts, max_conditions, min_support)
        best = _prune(grown, table, bad, left & judge)
        hit = _holds(best, table)
        seen = hit & left
        if not best or (bad & seen).sum() < min_support or (bad & seen).sum() < min_precision * seen.sum():
            break
        rules.append(Rule(tuple(Condition(names[j], above, float(t)) for j, above, t in best)))
        left &= ~hit
    return rules


def _holds(conditions: list[tuple[int, bool, float]], table: np.ndarray) -> np.ndarray:
    out = np.ones(len(table), dtype=bool)
    for j, above, t in conditions:
        out &= (table[:, j] > t) if above else (table[:, j] <= t)
    return out


def _grow(table, bad, rows, cuts, max_conditions, min_support) -> list[tuple[int, bool, float]]:
    """Add the condition of the greatest gain (positives times log-precision rise)."""
    chosen: list[tuple[int, bool, float]] = []
    while len(chosen) < max_conditions:
        inside = rows & _holds(chosen, table)
        p0, n0 = (bad & inside).sum(), inside.sum()
        if p0 == n0:
            break
        found, gain = None, 0.0
        for j, thresholds in enumerate(cuts):
            place = np.searchsorted(thresholds, table[inside, j], side="left")
            upto_n = np.cumsum(np.bincount(place, minlength=len(thresholds) + 1))[:-1]
            upto_p = np.cumsum(np.bincount(place, weights=bad[inside], minlength=len(thresholds) + 1))[:-1]
            for above, n, p in ((False, upto_n, upto_p), (True, n0 - upto_n, p0 - upto_p)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gains = np.where(p >= min_support, p * (np.log2(p / n) - np.log2(p0 / n0)), 0.0)
                if len(gains) and gains.max() > gain + 1e-9:
                    found, gain = (j, above, float(thresholds[gains.argmax()])), gains.max()
        if found is None:
            break
        chosen.append(found)
    return chosen


def _prune(conditions, table, bad, rows) -> list[tuple[int, bool, float]]:
    """Drop last conditions while (p - n) / (p + n) on the judging rows does not fall."""

    def worth(some) -> float:
        hit = rows & _holds(some, table)
        p, n = (bad & hit).sum(), (~bad & hit).sum()
        return (p - n) / (p + n) if p + n else -1.0

    best = list(conditions)
    for size in range(len(conditions) - 1, 0, -1):
        if worth(conditions[:size]) >= worth(best):
            best = list(conditions[:size])
    return best


def verdict(rules: list[Rule], stats: Column) -> Column:
    """1-based number of the first rule that rejects, 0 if none does."""
    if not rules:
        return F.lit(0)
    out = None
    for number, rule in enumerate(rules, start=1):
        out = F.when(rule.column(stats), number) if out is None else out.when(rule.column(stats), number)
    return out.otherwise(0)


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the statistics, base_failed, rule and kept, for every row of ``docs``.

    Null texts count as empty, so they fail; a repeated row appears again with equal
    results; other columns of ``docs`` play no part.
    """

    def full(s: Column) -> Column:
        names = [f for f in _STAT_NAMES]
        failed = base_failed(s)
        rule = verdict(rules, s)
        return F.struct(
            *[s[n].alias(n) for n in names],
            failed.alias("base_failed"),
            rule.alias("rule"),
            (~failed & (rule == 0)).alias("kept"),
        )

    out = docs.select("doc_id", let(statistics(F.col("text")), full).alias("r"))
    return out.select("doc_id", "r.*")


def keep_good(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns. One pass, no shuffle."""
    keep = let(statistics(F.col("text")), lambda s: ~base_failed(s) & (verdict(rules, s) == 0))
    flag = free_name("_keep", docs.columns)
    return docs.withColumn(flag, keep).where(F.col(flag)).drop(flag)


_STAT_NAMES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_upper",
    "n_marks",
    "n_digits",
)
