"""Connected components of an edge table by alternating star steps.

Each round points every neighbour of a node at the node's least neighbour (larger ones
first, then smaller ones). The edges end as stars around the least node of each
component; the number of rounds grows with the logarithm of the nodes. A round is
aggregations (combined before the shuffle, so a node with very many edges is no single
task's load) and joins that AQE may split; it ends in a stored table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.shared import store

MAX_ROUNDS = 100


def _attached(pairs: DataFrame, wanted: str) -> DataFrame:
    """Edges from the v of each (u, v) to the least of u and its v's."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.where(wanted).join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _round(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _attached(both, "v > u").distinct()
    down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # Smaller neighbours and the node itself all point at the least of them.
    own = down.groupBy("u").agg(F.min("v").alias("v"))
    return _attached(down, "true").union(own).distinct()


def _digest(edges: DataFrame) -> tuple:
    """Tells two edge sets apart: their number and the sum of their hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def stars(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge and isn't the least of its component.

    ``edges`` has two columns of one orderable type, in any direction, repeats and loops
    allowed; edges with a null end count for nothing.
    """
    a, b = edges.columns
    now = store(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
            F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
        ).distinct(),
        "edges",
    )
    seen = _digest(now)
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            break
        now = store(_round(now), "edges")
        new = _digest(now)
        if new == seen:
            break
        seen = new
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
