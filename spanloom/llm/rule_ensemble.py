"""Quality scores by a sparse ensemble of rules.

Boosted trees over text statistics are grown only for their paths: every path from the root is
a conjunction of thresholds, so a rule that holds or not. A logistic model with an L1
penalty weighs the rules and drops most; what is left is one sum of conditions that Spark
evaluates in the same pass as the statistics.

The learner takes a bounded sample of labelled rows (``fit_rows``); scores cover every row and
the whole text. Ids, labels, languages and sources are no inputs of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm import quality_rules, trees
from spanloom.llm.shared import let

FIT_ROWS = 8_000
THRESHOLD = 0.7

FEATURES = quality_rules.FEATURES | {
    "distinct_rate": lambda s: s["n_distinct"] / F.greatest(s["n_words"], F.lit(1)),
}


@dataclass(frozen=True)
class Ensemble:
    """Log-odds: ``intercept`` plus the weight of each rule that holds."""

    intercept: float
    rules: tuple[tuple[float, tuple[trees.Condition, ...]], ...] = ()

    def column(self, stats: Column) -> Column:
        values = list(FEATURES.values())
        total = F.lit(self.intercept)
        for weight, conditions in self.rules:
            holds = F.lit(True)
            for feature, above, threshold in conditions:
                value = values[feature](stats)
                holds = holds & (value > F.lit(threshold) if above else value <= F.lit(threshold))
            total = total + F.when(holds, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4 (null: no)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, label: str = "quality") -> Ensemble:
    """Learn from labelled rows that aren't held out. Labels of one kind only, or none: a
    constant score, the share of label 1 (one half without labels)."""
    sample = quality_rules.sample_labels(labels.where(~held_out(F.col("doc_id"))), fit_rows, label)
    sample = F.broadcast(sample.withColumnRenamed("doc_id", "_id"))
    joined = docs.select("doc_id", "text").join(sample, F.col("doc_id") == F.col("_id"))
    stats = joined.select("doc_id", "label", quality_rules.statistics(F.col("text"), distinct=True).alias("s"))
    columns = [make(F.col("s")).cast("double").alias(name) for name, make in FEATURES.items()]
    rows = stats.dropDuplicates(["doc_id"]).orderBy("doc_id").select("label", *columns).collect()
    y = np.array([float(r["label"]) for r in rows])
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Ensemble(float(np.log(share / (1 - share))))
    return ensemble(np.array([[r[name] for name in FEATURES] for r in rows], dtype=float), y)


def ensemble(table: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3) -> Ensemble:
    """Paths of boosted trees as rules, weighed by lasso; every fifth row chooses the penalty."""
    _, grown = trees.boost(table, y, rounds, depth)
    rules = list(dict.fromkeys(path for tree in grown for path in trees.paths(tree)))
    holds = np.array([_holds(rule, table) for rule in rules], dtype=float).T.reshape(len(y), len(rules))
    judge = np.arange(len(y)) % 5 == 4
    best, loss = None, np.inf
    for penalty in (0.1, 0.03, 0.01, 0.003, 0.001):
        intercept, weights = lasso(holds[~judge], y[~judge], penalty)
        p = np.clip(trees.sigmoid(intercept + holds[judge] @ weights), 1e-6, 1 - 1e-6)
        now = -np.mean(y[judge] * np.log(p) + (1 - y[judge]) * np.log(1 - p))
        if now < loss - 1e-4:
            best, loss = penalty, now
    intercept, weights = lasso(holds, y, best or 0.01)
    kept = [(float(w), rule) for w, rule in zip(weights, rules, strict=True) if abs(w) > 1e-4]
    return Ensemble(float(intercept), tuple(kept))


def lasso(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty on all but the intercept, by accelerated
    proximal gradient steps. Rules are scaled so that rare ones pay no more than common."""
    scale = np.maximum(x.std(axis=0), 0.02)
    z = np.column_stack((np.ones(len(x)), x / scale))
    rate = 4 * len(y) / max(np.linalg.norm(z, 2) ** 2, 1e-9)
    w = v = np.zeros(z.shape[1])
    t = 1.0
    for _ in range(steps):
        grad = z.T @ (trees.sigmoid(z @ v) - y) / len(y)
        new = v - rate * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w[0], w[1:] / scale


def _holds(rule: tuple[trees.Condition, ...], table: np.ndarray) -> np.ndarray:
    out = np.ones(len(table), dtype=bool)
    for j, above, threshold in rule:
        out &= (table[:, j] > threshold) if above else (table[:, j] <= threshold)
    return out


def score(docs: DataFrame, model: Ensemble, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted, for every row.

    Null texts count as empty and have a score too; repeated rows appear again. One pass,
    no shuffle; other columns play no part.
    """
    stats = quality_rules.statistics(F.col("text"), distinct=True)
    found = docs.select("doc_id", let(stats, model.column).alias("score"))
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )
