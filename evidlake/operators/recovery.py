"""How much of a deleted file is still there: cluster runs against allocation.

Cluster space is cut into blocks of 512. Allocation becomes one row per block
with its allocated pieces; a run becomes one piece per block it touches. The range
join is then an equi-join to at most one row per block, no pair of ranges is ever
emitted, and the overlap is summed inside the row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidlake.operators.joins import lookup_join

BLOCK = 512
STRETCH = 1 << 20


def _div(value: Column, by: int) -> Column:
    return F.call_function("div", value, F.lit(by))


def _pieces(df: DataFrame, start: str, end: str) -> DataFrame:
    """One row per block that [start, end) touches, cut to the block.

    Blocks are made in two steps, so a run over a whole disk never becomes one long array.
    """
    first, last = _div(F.col(start), BLOCK), _div(F.col(end) - 1, BLOCK)
    out = df.filter(F.col(end) > F.col(start)).withColumn(
        "_many", F.explode(F.sequence(_div(first, BLOCK), _div(last, BLOCK)))
    )
    blocks = F.sequence(
        F.greatest(first, F.col("_many") * BLOCK), F.least(last, (F.col("_many") + 1) * BLOCK - 1)
    )
    out = out.withColumn("block", F.explode(blocks)).drop("_many")
    low = F.greatest(F.col(start), F.col("block") * BLOCK)
    high = F.least(F.col(end), (F.col("block") + 1) * BLOCK)
    return out.withColumns({"piece_start": low, "piece_end": high})


def allocation_blocks(extents: DataFrame) -> DataFrame:
    """Allocated pieces of each block, as disjoint pieces in order.

    Repeated and overlapping extents are merged inside the block, so no cluster counts
    twice; the distinct pieces of a block are bounded by its 512 clusters.
    """
    pieces = _pieces(extents.withColumnRenamed("end_excl", "end"), "start", "end")
    piece = F.struct(F.col("piece_start").alias("s"), F.col("piece_end").alias("e"))
    found = pieces.groupBy("volume", "block").agg(F.array_sort(F.collect_set(piece)).alias("found"))

    def add(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))
        joins = (F.size(done) > 0) & (x["s"] <= last["e"])
        return F.when(
            joins, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))
        ).otherwise(F.concat(done, F.array(x)))

    none = F.array().cast("array<struct<s:bigint,e:bigint>>")
    merged = found.select("volume", "block", F.aggregate("found", none, add).alias("allocated"))
    return merged.withColumn(
        "filled", F.aggregate("allocated", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    )


def _extents(found: list[tuple]) -> pd.DataFrame:
    names = ["volume", "start", "end_excl"]
    return pd.DataFrame(dict(zip(names, (np.concatenate(part) for part in zip(*found)))))


def bitmap_extents(bitmap: DataFrame) -> DataFrame:
    """Allocated extents from rows of (volume, byte_offset, bits), in time linear in the bytes.

    Each row stays in its task and is read ``STRETCH`` bytes at a time; an extent that
    crosses the edge of a row or stretch gives two adjoining extents. Null and empty rows
    give none.
    """

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, held = [], 0
            for volume, offset, data in batch.itertuples(index=False):
                data = data or b""
                for at in range(0, len(data), STRETCH):
                    bits = np.unpackbits(np.frombuffer(data[at : at + STRETCH], np.uint8), bitorder="little")
                    turns = np.flatnonzero(np.diff(bits, prepend=np.uint8(0), append=np.uint8(0)))
                    turns += 8 * (int(offset) + at)
                    found.append((np.full(len(turns) // 2, volume, object), turns[::2], turns[1::2]))
                    held += len(turns)
                    if held > STRETCH:
                        yield _extents(found)
                        found, held = [], 0
            if held:
                yield _extents(found)

    volume = bitmap.schema["volume"].dataType.simpleString()
    rows = bitmap.select("volume", "byte_offset", "bits")
    return rows.mapInPandas(edges, f"volume {volume}, start long, end_excl long")


def runs_of(files: DataFrame) -> DataFrame:
    """One row per cluster run of files that carry their runs as an array."""
    rows = files.select("volume", "file_id", F.posexplode("data_runs").alias("run", "r"))
    return rows.select("volume", "file_id", "run", "r.start", "r.n")


def free_clusters(runs: DataFrame, extents: DataFrame) -> DataFrame:
    """Total and allocated clusters of each file from its runs (volume, file_id, run,
    start, n). A file may have any number of runs: they are never put into one group."""
    runs = runs.withColumn("end", F.col("start") + F.col("n"))
    joined = lookup_join(
        _pieces(runs, "start", "end"), allocation_blocks(extents), ["volume", "block"], "left",
        spread=["file_id", "run"], may_broadcast=False,
    )
    overlap = F.aggregate(
        F.coalesce("allocated", F.array().cast("array<struct<s:bigint,e:bigint>>")),
        F.lit(0).cast("long"),
        lambda acc, a: acc
        + F.greatest(
            F.lit(0),
            F.least(a["e"], F.col("piece_end")) - F.greatest(a["s"], F.col("piece_start")),
        ),
    )
    whole = F.col("piece_end") - F.col("piece_start") == BLOCK
    return joined.groupBy("volume", "file_id").agg(
        F.sum(F.col("piece_end") - F.col("piece_start")).alias("total_clusters"),
        F.sum(F.when(whole, F.coalesce("filled", F.lit(0))).otherwise(overlap)).alias("used_clusters"),
    )


def recovery_status(percent: Column) -> Column:
    return F.when(percent == 100, "FULL").when(percent > 0, "PARTIAL").otherwise("OVERWRITTEN")


def assess(
    files: DataFrame, extents: DataFrame | None = None, runs: DataFrame | None = None
) -> DataFrame:
    """Status and percent of each file (volume, file_id, is_resident).

    Resident data is whole; a file without runs has only metadata; otherwise the share
    of free clusters decides. Without an allocation map half is assumed. Runs are the
    files' ``data_runs`` arrays, or rows of their own given as ``runs``, with a boolean
    ``has_runs`` in the files.
    """
    no_runs = F.array().cast("array<struct<start:bigint,n:bigint>>")
    if "has_runs" in files.columns:
        has_runs = F.col("has_runs")
    else:
        has_runs = F.size(F.coalesce("data_runs", no_runs)) > 0
    resident = F.col("is_resident")
    if extents is None:
        run_sum = F.aggregate("data_runs", F.lit(0).cast("long"), lambda a, r: a + r["n"])
        rows = files.withColumns(
            {"total_clusters": run_sum, "used_clusters": F.lit(None).cast("long")}
        )
        percent, status = F.lit(50.0), F.lit("PARTIAL")
    else:
        if runs is None:
            runs = runs_of(files.filter(~resident & has_runs))
        counted = free_clusters(runs, extents)
        rows = lookup_join(files, counted, ["volume", "file_id"], "left", salts=1)
        free = F.col("total_clusters") - F.col("used_clusters")
        percent = F.coalesce(free / F.nullif(F.col("total_clusters"), F.lit(0)) * 100.0, F.lit(0.0))
        status = recovery_status(percent)
    return rows.withColumns(
        {
            "recovery_percent": F.when(resident, 100.0).when(~has_runs, 0.0).otherwise(percent),
            "status": F.when(resident, "FULL").when(~has_runs, "METADATA_ONLY").otherwise(status),
            "total_clusters": F.when(resident | ~has_runs, 0).otherwise(F.coalesce("total_clusters", F.lit(0))),
            "used_clusters": F.when(resident | ~has_runs, 0).otherwise(F.col("used_clusters")),
        }
    )


def recovery_statistics(assessed: DataFrame) -> DataFrame:
    status = F.col("status")
    return assessed.agg(
        F.count("*").alias("total_files"),
        F.count_if(status == "FULL").alias("full_recovery"),
        F.count_if(status == "PARTIAL").alias("partial_recovery"),
        F.count_if(status == "METADATA_ONLY").alias("metadata_only"),
        F.count_if(status == "OVERWRITTEN").alias("overwritten"),
        F.round(F.coalesce(F.avg("recovery_percent"), F.lit(0.0)), 4).alias("average_recovery_pct"),
    )
