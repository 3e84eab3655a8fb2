"""The kept table of metric facts: a folder per version, the newest finished one counts.

Merging facts again changes nothing, so a batch that runs twice, or another stream that
starts from batch zero, does no harm. A version is finished once its ``_SUCCESS`` file is
there; the last few stay for readers that have listed them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.operators.metric_facts import FACTS, merge_facts

KEEP_VERSIONS = 3


def _versions(spark: SparkSession, path: str) -> tuple[object, list[int]]:
    """The file system and the numbers of the finished versions, oldest first."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return fs, []
    names = [status.getPath().getName() for status in fs.listStatus(root)]
    numbers = sorted(int(name.removeprefix("version=")) for name in names if name.startswith("version="))
    return fs, [n for n in numbers if fs.exists(hadoop.Path(f"{path}/version={n}/_SUCCESS"))]


def keep(facts: DataFrame, path: str) -> int:
    """Merge facts into the table; returns the new version's number. One writer at a time."""
    spark = facts.sparkSession
    fs, known = _versions(spark, path)
    number = known[-1] + 1 if known else 0
    merged = merge_facts(facts, _read(spark, path, known[-1])) if known else merge_facts(facts)
    merged.write.mode("overwrite").parquet(f"{path}/version={number}")
    for old in known[: max(0, len(known) + 1 - KEEP_VERSIONS)]:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/version={old}"), True)
    return number


def _read(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(FACTS).parquet(f"{path}/version={version}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The newest finished version; no rows if there is none."""
    _, known = _versions(spark, path)
    return _read(spark, path, known[-1]) if known else spark.createDataFrame([], FACTS)
