"""Threat-intelligence verdicts joined to hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidlake.operators.joins import lookup_join


def verdict(intel: DataFrame) -> DataFrame:
    """Score and level of each answer; no engines gives no score."""
    bad, odd = F.col("malicious"), F.col("suspicious")
    engines = bad + odd + F.col("harmless") + F.col("undetected")
    score = F.floor((bad * 2 + odd) / F.nullif(engines, F.lit(0)) * 100)
    level = (
        F.when(bad > 10, "HIGH")
        .when((bad > 3) | (odd > 5), "MEDIUM")
        .when((bad > 0) | (odd > 0), "LOW")
        .otherwise("CLEAN")
    )
    return intel.withColumns({"engines": engines, "threat_score": score, "threat_level": level})


def latest(intel: DataFrame) -> DataFrame:
    """The newest answer per hash, folded before the shuffle; of equal times the greatest row."""
    others = [c for c in intel.columns if c != "hash"]
    newest = intel.groupBy(F.lower("hash").alias("hash")).agg(
        F.max_by(F.struct(*others), F.struct("ts", *[c for c in others if c != "ts"])).alias("a")
    )
    return newest.select("hash", "a.*")


def hash_verdicts(
    hashes: DataFrame, intel: DataFrame, as_of: Column, valid_hours: int = 24, on: str = "sha256"
) -> DataFrame:
    """Verdict of each file; an answer older than the limit counts as unknown."""
    fresh = intel.filter(F.col("ts") > as_of - F.make_dt_interval(F.lit(0), F.lit(valid_hours)))
    answers = verdict(latest(fresh)).withColumnRenamed("hash", on).drop("ts")
    joined = lookup_join(hashes.withColumn(on, F.lower(on)), answers, on, "left", measured=True)
    return joined.withColumn("threat_level", F.coalesce("threat_level", F.lit("UNKNOWN")))


def verdict_tally(verdicts: DataFrame) -> DataFrame:
    """clean / suspicious / malicious / unknown counts."""
    level = F.col("threat_level")
    group = (
        F.when(level == "CLEAN", "clean")
        .when(level.isin("LOW", "MEDIUM"), "suspicious")
        .when(level == "HIGH", "malicious")
        .otherwise("unknown")
    )
    return verdicts.groupBy(group.alias("verdict")).agg(F.count("*").alias("files"))
