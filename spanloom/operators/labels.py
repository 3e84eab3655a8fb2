"""Readable labels for the series of a metric."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.attributes import short_key

# Keys that identify a node, host or container, best first.
IDENTITY_KEYS = [
    "k8s.node.name",
    "host.name",
    "host.id",
    "k8s.container.name",
    "container.name",
    "k8s.pod.name",
    "k8s.deployment.name",
    "service.instance.id",
]
LABEL_KEYS = 3


def series_labels(series: DataFrame) -> DataFrame:
    """Label each (name, attrs_json) by the keys that vary over the metric's series.

    Identity keys lead, id-like keys step back when another key varies, and equal ranks
    go by key. An absent key counts as an empty value.
    """
    rows = series.select("name", "attrs_json").distinct()
    rows = rows.withColumn("_attrs", F.from_json("attrs_json", "map<string,string>"))
    totals = rows.groupBy("name").agg(F.count("*").alias("_series"))
    pairs = rows.select("name", F.explode("_attrs").alias("key", "v"))
    per_value = pairs.groupBy("name", "key", F.coalesce("v", F.lit("")).alias("v")).agg(F.count("*").alias("n"))
    per_key = per_value.groupBy("name", "key").agg(
        F.count("*").alias("values"), F.sum("n").alias("present"), F.max(F.col("v") == "").alias("has_empty")
    )
    sided = per_key.join(totals, "name")
    absent = (F.col("present") < F.col("_series")) & ~F.col("has_empty")
    varying = sided.where(F.col("values") + absent.cast("int") > 1)

    idlike = F.col("key").endswith("id")
    rank = F.coalesce(
        F.nullif(F.array_position(F.array(*[F.lit(k) for k in IDENTITY_KEYS]), F.col("key")), F.lit(0)),
        F.lit(len(IDENTITY_KEYS) + 1),
    )
    ranked = varying.withColumn("_idlike", idlike).withColumn(
        "_rank", F.row_number().over(W.partitionBy("name").orderBy("_idlike", rank, "key"))
    )
    kept = ranked.where(F.col("_rank") <= LABEL_KEYS)
    keys = kept.groupBy("name").agg(
        F.array_sort(F.collect_list(F.struct("_idlike", "_rank", "key"))).alias("_keys")
    )
    # Id-like keys only when nothing else varies.
    friendly = F.filter("_keys", lambda k: ~k["_idlike"])
    keys = keys.withColumn("_keys", F.when(F.size(friendly) > 0, friendly).otherwise(F.col("_keys")))

    sides = totals.join(keys, "name", "left")
    part = F.transform(
        "_keys",
        lambda k: F.concat(short_key(k["key"]), F.lit("="), F.coalesce(F.col("_attrs")[k["key"]], F.lit("∅"))),
    )
    text = F.array_join(part, " · ")
    label = F.when(F.col("_series") <= 1, "all").when(F.length(text) > 0, text).otherwise("—")
    return rows.join(sides, "name").select("name", "attrs_json", label.alias("label"))
