"""Mixing of sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidlake.llm.common import keep

WEIGHTS = (5.0, 2.0, 1.0)
#: Ratio of the bands that a source's document weights are counted in.
BAND = 1.1


def word_count(text: Column) -> Column:
    """Runs of anything but space and the controls 9 to 13; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Between 0.1 and 1: the share of letters, digits and spaces among the characters."""
    plain = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}\s]+", ""))
    return F.greatest(F.lit(0.1), F.coalesce(F.try_divide(plain, F.length(text)), F.lit(0.1)))


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: float = 3.0) -> DataFrame:
    """Target words of each source: ``source``, ``source_size``, ``n``, ``target``.

    ``sizes`` has one row per source. Sources in code point order, null last, weigh
    ``weights`` in turn and share the words of all; a target stops at ``most`` times its
    source and the excess goes to the others by weight. With sources ordered by
    cap / weight, those over the common level are a prefix, so running sums give the
    level without a loop.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    w = sizes.withColumn(
        "_w", F.element_at(cycle, (F.row_number().over(order) - 1) % len(weights) + 1)
    ).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    )
    # the level rises over the prefix that is full and falls after it
    return w.withColumn("_level", level).select(
        "source", "source_size", "n",
        F.least(F.col("_cap"), F.max("_level").over(everything) * F.col("_w")).alias("target"),
    )


def bucketed(docs: DataFrame, quality: Column | None, weights, most: float, seed: int, per_bucket: int) -> DataFrame:
    """``docs`` with its own columns by their places, sizes, keys, targets and buckets of keys."""
    weight = F.least(F.greatest(quality if quality is not None else quality_weight(F.col("text")), F.lit(1e-6)), F.lit(1e6))
    uniform = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    # one row in 16 says how a source's weights are spread; only the buckets' bounds follow from it
    measured = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "text"), F.lit(16)) == 0
    # own columns go by their places, so that none has the name of a helper
    own = [F.col(f"`{name}`").alias(f"own {i}") for i, name in enumerate(docs.columns)]
    keyed = docs.select(
        *own, "doc_id", "source",
        word_count(F.col("text")).alias("size"),
        (-F.log(uniform) / weight).alias("_key"),
        F.when(measured, F.floor(F.log(weight) / math.log(BAND)).cast("int")).alias("_band"),
        F.xxhash64("text").alias("_tie"),
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("_s"),  # never null
    )
    bands = keyed.groupBy("source", "_s", "_band").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    sizes = bands.groupBy("source", "_s").agg(
        F.sum("words").alias("source_size"),
        F.sum("n").alias("n"),
        F.collect_list(
            F.when(F.col("_band").isNotNull(), F.struct(F.pow(F.lit(BAND), F.col("_band")).alias("weight"), "n"))
        ).alias("_bands"),
    )
    # one row per source, written once: its true size decides about a broadcast, so that
    # the documents are not shuffled by source before Spark knows how small the table is
    sizes = keep(sizes)
    targets = keep(source_targets(sizes.drop("_bands"), weights, most).join(
        sizes.select("_s", F.sort_array("_bands").alias("_bands")),
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")) == F.col("_s"),
    ).drop("source"))
    # the share of the source's keys that lie below a key
    known = F.aggregate("_bands", F.lit(0).cast("long"), lambda sum_, b: sum_ + b["n"])
    below = F.coalesce(F.try_divide(F.aggregate(
        "_bands", F.lit(0.0), lambda sum_, b: sum_ + b["n"] * (1 - F.exp(-F.col("_key") * b["weight"]))
    ), known), F.lit(0.0))
    return keyed.join(targets, "_s", "left").withColumn(
        "_bucket", F.floor(below * F.ceil(F.col("n") / per_bucket)).cast("long")
    ).drop("_bands")


def bucket_sizes(docs: DataFrame, per_bucket: int = 2000) -> DataFrame:
    """How many rows each bucket of keys has, by source."""
    return bucketed(docs, None, WEIGHTS, 3.0, 0, per_bucket).groupBy("_s", "_bucket").count()


def mix(
    docs: DataFrame, quality: Column | None = None, weights=WEIGHTS, most: float = 3.0,
    seed: int = 0, per_bucket: int = 2000,
) -> DataFrame:
    """Every row of ``docs`` with ``size``, ``source_size``, ``target`` and ``taken``.

    ``taken`` is a multiple of ``size``: as many complete epochs as the source's target
    holds, and one more for the documents of the fractional epoch, drawn by
    Efraimidis-Spirakis sampling: key -ln(u) / quality with u from a hash of seed, id and
    text; the smallest keys are taken until their sizes fill the rest of the target. The
    document on the edge is taken if that brings the sum closer.

    Running sums over a source are made in two steps: keys are cut into monotone buckets
    of about ``per_bucket`` rows, whose totals are summed first, so no task sees a whole
    source. A bucket is a range of the distribution that the source's own weights give its
    keys, taken in bands of 10 % from a sixteenth of its rows, so whatever they are, it holds
    about 1.1 times its share at most. The result does not depend on the buckets. Null text has size 0 and takes nothing; null sources are one source; repeated
    rows count each time and get equal keys, of which the edge takes any. Columns of these
    names that ``docs`` has already are replaced.
    """
    made = ["size", "source_size", "target", "taken"]
    docs = docs.drop(*made)
    rows = bucketed(docs, quality, weights, most, seed, per_bucket)
    in_bucket = Window.partitionBy("_s", "_bucket").orderBy("_key", "doc_id", "_tie")
    ahead = Window.partitionBy("_s").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_s", "_bucket").agg(F.sum("size").alias("_sum")).select(
        "_s", "_bucket", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead")
    )
    placed = rows.join(totals, ["_s", "_bucket"], "left").withColumn(
        "_before",
        F.col("_ahead") + F.coalesce(
            F.sum("size").over(in_bucket.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ),
    )
    whole = F.col("source_size") > 0
    epochs = F.when(whole, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("target") - epochs * F.col("source_size")
    one_more = (F.col("_before") + F.col("size") / 2.0 <= rest).cast("long")
    given_back = [F.col(f"own {i}").alias(name) for i, name in enumerate(docs.columns)]
    return placed.withColumn("taken", (epochs + one_more) * F.col("size")).select(*given_back, *made)


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``.

    A document without words has no words to take and appears once, so nothing clean is
    lost to the arithmetic.
    """
    columns = docs.columns  # of which some may have the names that the mix adds
    own = docs.select(*[F.col(f"`{c}`").alias(f"kept {i}") for i, c in enumerate(columns)], "doc_id", "text", "source")
    taken = mix(own, **options)
    times = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(1)
    copies = F.explode(F.array_repeat(F.lit(0), times))
    rows = taken.select(*[f"kept {i}" for i in range(len(columns))], copies.alias("copy"))
    return rows.select(*[F.col(f"kept {i}").alias(c) for i, c in enumerate(columns)])
