"""Session settings the operators rely on, and the checkpoint folder rule."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every operator assumes. Partition counts are left to AQE: a high
# initial number with coalescing lets one setting serve megabytes and terabytes.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Settings of the context, which only a new session can take. Iterative operators leave
# a checkpoint per round; this lets Spark delete the ones no plan needs any more.
CONTEXT_SETTINGS = {"spark.cleaner.referenceTracking.cleanCheckpoints": "true"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "spanloom", extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **CONTEXT_SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of the session.

    On a cluster it has to be a shared folder named by ``spark.checkpoint.dir``.
    Only a local master may fall back to a folder of its own machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "set spark.checkpoint.dir to a shared folder: iterative operators cut their lineage there"
            )
        configured = tempfile.mkdtemp(prefix="spanloom-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written as Parquet below the checkpoint folder and read again.

    This cuts the lineage in storage that all executors share, and unlike a checkpoint
    computes the rows once. The files belong to the run, like the folder they are in.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
