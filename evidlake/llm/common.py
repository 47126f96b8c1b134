"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidlake.session import ensure_checkpoint_dir

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def keep(df: DataFrame) -> DataFrame:
    """Write a frame once to the shared checkpoint folder and read it back.

    It cuts the lineage: a lost executor costs a read, not the work before it.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_of(frame: pd.DataFrame, name: str) -> list:
    """The values of a text column, null as None."""
    return [None if x is None or x is pd.NA or x != x else x for x in frame[name]]


def blocks(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of about ``most`` bytes; a larger row has its own."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def hashed_sample(df: DataFrame, rows: int, *by: str, seed: int = 0) -> pd.DataFrame:
    """At most ``rows`` rows, those with the least hashes of ``by``, in that order.

    First the hashes alone are ranked, so only the sample's own rows reach the driver.
    """
    hashed = df.withColumn("_sample", F.xxhash64(F.lit(seed), *by))
    edge = hashed.select("_sample").orderBy("_sample").limit(rows).agg(F.max("_sample")).first()[0]
    if edge is None:
        return df.limit(0).toPandas()
    picked = hashed.filter(F.col("_sample") <= edge).orderBy("_sample", *by).limit(rows)
    return picked.drop("_sample").toPandas()


def holds_out(doc_id):
    """True for rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
