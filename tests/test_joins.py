"""Joins whose hot keys are found by a sketch, and path passes that count while they write."""

import pytest
from pyspark.sql import functions as F

from evidlake.operators import hashes, joins, mft


@pytest.fixture
def no_broadcast(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def files(spark, n):
    """Hash rows of which a third have one content."""
    content = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 1000).cast("string"))
    return spark.range(n).select(
        F.col("id").cast("string").alias("path"), F.md5(content.cast("binary")).alias("md5"),
        F.sha2(content, 256).alias("sha256"), F.lit(1).cast("long").alias("size"),
    )


def test_salts_follow_the_measured_share():
    hot = [{"item": 7, "count": 4000}, {"item": 9, "count": 700}, {"item": 1, "count": 12}]
    assert joins.hot_key_salts(12_000, hot, 8) == {7: 6}
    assert joins.hot_key_salts(12_000, hot, 100) == {7: 67, 9: 12}
    assert joins.hot_key_salts(0, [], 8) == {}


def test_a_content_with_a_third_of_the_rows(spark, rows, no_broadcast):
    table = files(spark, 30_000)
    known = spark.createDataFrame(
        [("md5", __import__("hashlib").md5(b"hot").hexdigest(), "worm", "CRITICAL"), ("sha256", "0" * 64, "none", "LOW")],
        "algorithm string, hash string, threat string, severity string",
    )
    found = hashes.known_bad(table, known)
    assert found.count() == 10_000 and {r.threat for r in found.select("threat").distinct().collect()} == {"worm"}
    copies = hashes.duplicate_files(table)
    want = table.groupBy("sha256").agg(F.count("*").alias("copies"), F.min("path").alias("first_path"))
    want = table.select("sha256", "path").join(want, "sha256")
    assert rows(copies, "path", "sha256", "copies", "first_path") == rows(want, "path", "sha256", "copies", "first_path")
    per_salt = joins._measured_join(
        table.select("sha256", "path"), table.groupBy("sha256").agg(F.count("*").alias("n")), ["sha256"], "left", None
    )
    assert per_salt.count() == 30_000 and "_salt" in per_salt._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("how", ["left", "inner"])
def test_null_keys_other_types_and_empty_sides(spark, rows, no_broadcast, how):
    left = spark.range(600).select(F.when(F.col("id") % 2 == 0, F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    right = spark.range(3).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    want = rows(left.join(right, "k", how).fillna(-1), "k", "v", "w")
    assert rows(joins.lookup_join(left, right, "k", how, measured=True).fillna(-1), "k", "v", "w") == want
    narrow = right.withColumn("k", F.col("k").cast("int"))
    assert rows(joins.lookup_join(left, narrow, "k", how, measured=True).fillna(-1), "k", "v", "w") == want
    assert joins.lookup_join(left.limit(0), right, "k", how, measured=True).count() == 0
    gone = joins.lookup_join(left, right.limit(0), "k", how, measured=True)
    assert gone.count() == (600 if how == "left" else 0)


RECORDS = "volume string, entry_number long, parent_reference long, filename string"


def test_paths_of_deep_trees_cycles_repeats_and_no_rows(spark):
    chain = [("C:", 5, 5, ".")] + [("C:", 100 + i, 99 + i if i else 5, f"d{i}") for i in range(40)]
    cycle = [("C:", 900, 901, "a"), ("C:", 901, 900, "b"), ("C:", 902, 777, "lost"), ("C:", 903, 902, "below")]
    table = spark.createDataFrame(chain + cycle + chain[3:9], RECORDS)
    got = {r.entry_number: r.path for r in mft.directory_paths(table).collect()}
    assert got[138] == "C:\\" + "\\".join(f"d{i}" for i in range(39))
    assert not {900, 901, 902} & set(got)
    assert mft.directory_paths(table.limit(0)).count() == 0


def test_a_pass_is_one_job(spark):
    chain = [("C:", 5, 5, ".")] + [("C:", 100 + i, 99 + i if i else 5, f"d{i}") for i in range(16)]
    table = spark.createDataFrame(chain, RECORDS)
    writes, real = [], mft.materialize_observed

    def counted(df, **metrics):
        writes.append(1)
        return real(df, **metrics)

    mft.materialize_observed = counted
    try:
        mft.directory_paths(table)
    finally:
        mft.materialize_observed = real
    assert len(writes) <= 6  # the first table and log2(16) passes and no last one that finds nothing
