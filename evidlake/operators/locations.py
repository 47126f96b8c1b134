"""Lists of locations as tables: paths that hold a listed place, or begin with one.

Places and paths are compared in lower case. An empty or null place is in no path, a null
path holds no place, and repeated places count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidlake.operators.joins import lookup_join
from evidlake.session import materialize_observed

#: Longest key of a place looked for anywhere, and of one at the beginning of a path.
GRAM, PREFIX = 8, 48


def _pieces(text: Column, n: Column) -> Column:
    """All parts of n characters; n is at most the length."""
    return F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n))


def _rarest_pieces(places: DataFrame) -> DataFrame:
    """Each place by that piece of it which the fewest places have."""
    size = F.least(F.length("place"), F.lit(GRAM))
    pieces = places.select("place", F.explode(F.array_distinct(_pieces(F.col("place"), size))).alias("key"))
    counts = pieces.groupBy("key").agg(F.count("*").alias("held_by"))
    rated = lookup_join(pieces, counts, "key", "inner")
    return rated.groupBy("place").agg(F.min(F.struct("held_by", "key"))["key"].alias("key"))


def place_hits(paths: DataFrame, places: DataFrame, at_start: bool = False) -> DataFrame:
    """Each distinct path with each listed place in it: columns ``path`` and ``place``.

    Every place is filed under one key of its text, and a path is looked up by its own
    pieces of the lengths that keys have; the whole place is compared after that. So the
    work is one row per piece of a path, whatever the number of places. Keys at the start
    have at most 48 lengths; elsewhere a place is filed by its rarest piece of eight
    characters, so places with a common beginning do not meet under it.
    """
    wanted = places.select(F.lower("place").alias("place")).filter("length(place) > 0").distinct()
    if at_start:
        keyed = wanted.withColumn("key", F.substring("place", 1, PREFIX))
    else:
        keyed = _rarest_pieces(wanted)
    # one bit for each length that a key has
    keyed, seen = materialize_observed(
        keyed.select("key", "place"), lengths=F.expr("bit_or(shiftleft(1L, length(key) - 1))")
    )
    bits = seen["lengths"] or 0
    lengths = [n for n in range(1, PREFIX + 1) if bits >> (n - 1) & 1]
    low = F.col("low")
    none = F.array().cast("array<string>")
    if at_start:
        parts = [F.when(F.length(low) >= n, F.array(F.substring(low, 1, n))).otherwise(none) for n in lengths]
    else:
        parts = [F.when(F.length(low) >= n, _pieces(low, F.lit(n))).otherwise(none) for n in lengths]
    distinct = paths.select("path").filter(F.col("path").isNotNull()).distinct()
    asked = distinct.withColumn("low", F.lower("path"))
    asked = asked.select("path", "low", F.explode(F.array_distinct(F.concat(none, *parts))).alias("key"))
    met = lookup_join(asked, keyed, "key", "inner", spread=["path"])
    held = F.startswith(low, F.col("place")) if at_start else F.contains(low, F.col("place"))
    # a place has one key and a path's keys are distinct: no pair comes twice
    return met.filter(held).select("path", "place")


def in_listed_places(files: DataFrame, places: DataFrame, at_start: bool = False) -> DataFrame:
    """Files in a listed place, with the longest one (ties: the least) as ``place``.

    All rows of a path are kept; a column ``place`` of the files is replaced.
    """
    hits = place_hits(files, places, at_start)
    best = hits.groupBy("path").agg(F.min(F.struct(-F.length("place"), "place"))["place"].alias("place"))
    return lookup_join(files.drop("place"), best, "path", "inner", may_broadcast=False)


def outside_listed_places(files: DataFrame, places: DataFrame, at_start: bool = True) -> DataFrame:
    """Files in none of the listed places; files without a path stay."""
    hits = place_hits(files, places, at_start).select("path").distinct()
    return lookup_join(files, hits, "path", "left_anti", may_broadcast=False)
