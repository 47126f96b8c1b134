"""Session settings the operators are designed for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # Run-time re-planning: small shuffle partitions merge, hot join partitions split.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Repeated groups in an expression recurse in the JVM; hostile text needs deep stacks.
    "spark.executor.extraJavaOptions": "-Xss16m",
    "spark.driver.extraJavaOptions": "-Xss16m",
}


def build_session(app: str = "evidlake", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared checkpoint folder of the cluster; make one only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", "")
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="evidlake-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame once to the shared checkpoint folder and read it back.

    Cuts lineage like a checkpoint does, and the table read back has its true size, so
    later joins broadcast it only when it really is small.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """``materialize``, with aggregates that are observed during the write: no job of their own."""
    seen = Observation()
    written = materialize(df.observe(seen, *[c.alias(name) for name, c in metrics.items()]))
    return written, seen.get
