"""Joins that stay even when one key holds much of the data."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidlake.session import materialize_observed

DEFAULT_SALTS = 16
#: Hot keys a sketch reports, and keys it follows: one with over 1/1024 of all rows is never lost.
HOT_KEYS, FOLLOWED_KEYS = 64, 1024


def plan_bytes(df: DataFrame) -> int:
    """Size of a frame as the optimizer estimates it."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    except ValueError:  # an estimate with thousands of digits, after many joins
        return sys.maxsize


def broadcast_limit(spark) -> int:
    raw = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760").strip().lower()
    number = raw.rstrip("bkmgtp")
    unit = raw[len(number):].rstrip("b")
    return int(number) * 1024 ** (" kmgtp".index(unit) if unit else 0)


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str] | str,
    how: str = "left",
    spread: Sequence[str] | None = None,
    salts: int | None = None,
    may_broadcast: bool = True,
    measured: bool = False,
) -> DataFrame:
    """Join rows to a side with at most one row per key.

    A right side whose estimated size is below the session's broadcast limit is
    broadcast by Spark. The estimate is a bound for what filters and aggregates leave, but
    not for exploded rows: such a side sets ``may_broadcast=False``. Above the limit, each left row goes to one of ``salts`` partitions of its
    key and the right row is copied to all of them, so the rows of one hot key are
    split over ``salts`` tasks. The salt is a hash of ``spread`` (by default every
    left column that can be hashed), so a task that runs again gives the same rows.
    Where the left keys are unique as well, ``salts=1`` makes it a plain join.

    With ``measured``, the left rows are written once to the shared folder and a sketch of
    their keys is observed on the way: each hot key gets salts by its own share of the rows,
    and right rows are copied for hot keys only. It suits a left side that costs much to
    compute, as it is computed once.
    """
    on = [on] if isinstance(on, str) else list(on)
    limit = broadcast_limit(left.sparkSession)
    if may_broadcast and 0 < limit and plan_bytes(right) <= limit:
        return left.join(right, on, how)
    if measured and salts is None and not left.isStreaming and _same_types(left, right, on):
        return _measured_join(left, right, on, how, spread)
    if salts is None:
        salts = int(left.sparkSession.conf.get("evidlake.join.salts", str(DEFAULT_SALTS)))
    if salts == 1:
        return left.join(right, on, how)
    spread = _hashable(left) if spread is None else spread
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    if not may_broadcast:
        copies = copies.hint("merge")
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def _hashable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if "map" not in f.dataType.simpleString()]


def _same_types(left: DataFrame, right: DataFrame, on: Sequence[str]) -> bool:
    """Keys are met by their hashes, which differ between types."""
    return all(left.schema[c].dataType == right.schema[c].dataType for c in on)


def hot_key_salts(rows: int, hot: Sequence, partitions: int) -> dict[int, int]:
    """Salts of each key whose rows are more than half of an even partition."""
    even = max(1, rows // (2 * max(1, partitions)))
    return {r["item"]: -(-r["count"] // even) for r in hot if r["count"] > even}


def _measured_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str, spread) -> DataFrame:
    key = F.xxhash64(*on)
    names = ", ".join(f"`{c}`" for c in on)
    left, seen = materialize_observed(
        left, rows=F.count("*"), hot=F.expr(f"approx_top_k(xxhash64({names}), {HOT_KEYS}, {FOLLOWED_KEYS})")
    )
    partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = hot_key_salts(seen["rows"], seen["hot"] or [], partitions)
    if not salts:
        return left.join(right, on, how)
    pairs = [F.lit(x) for item in salts.items() for x in item]
    many = F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(1))
    spread = _hashable(left) if spread is None else spread
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), many).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), many.cast("int") - 1)))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def top_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence, n: int, rank: str = "rank"
) -> DataFrame:
    """First n rows of each group.

    A ``row_number() <= n`` filter makes Spark keep n rows per group in every input
    task before the shuffle, so a hot group reaches its last task already cut.
    """
    from pyspark.sql import Window

    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)
