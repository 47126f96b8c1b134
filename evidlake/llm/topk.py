"""Exact top-k search: tiled matrix products, partial selection per tile, tree merging."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a shard and queries of a block; both bound a task's matrices.
SHARD, BLOCK = 4096, 4096
#: Rows of queries multiplied at once inside a task.
STRIPE = 256


def usable(vector: Column) -> Column:
    """True for vectors without null, NaN or infinite components; empty ones are not usable."""
    return F.coalesce(
        (F.size(vector) > 0)
        & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | F.abs(x).isin(float("inf"))),
        F.lit(False),
    )


def floor_256(vector: Column) -> Column:
    """floor(256 * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256.0).cast("double"))


def inner_product(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact for whole numbers: in doubles while sums stay below 2**53, else in 64-bit integers."""
    most = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * queries.shape[1]
    if most < 2**53:
        return queries @ vectors.T
    return queries.astype(np.int64) @ vectors.astype(np.int64).T


def pair_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows; equal rows give equal values wherever they stand."""
    norm = np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))
    return (a * b).sum(axis=1) / norm


def select(scores: np.ndarray, ids: np.ndarray, k: int, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k best scores; ties go to smaller ids.

    ``skip`` marks cells that take no part.
    """
    low = -np.inf if scores.dtype.kind == "f" else np.iinfo(scores.dtype).min
    scores[skip] = low
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    else:
        least = np.full(len(scores), low)
    row, column = np.nonzero((scores >= least[:, None]) & ~skip)
    order = np.lexsort((ids[column], -scores[row, column], row))
    row, column = row[order], column[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row, side="left")
    return row[rank < k], column[rank < k]


def search_tile(
    queries: pd.DataFrame, vectors: pd.DataFrame, k: int,
    product: Callable[[np.ndarray, np.ndarray], np.ndarray], whole: bool,
) -> pd.DataFrame:
    """The k best of one shard for each query of one block, a stripe of queries at a time."""
    out = []
    sizes = set() if queries.empty or vectors.empty else set(queries["v"].map(len)) & set(vectors["v"].map(len))
    for size in sorted(sizes):  # vectors of other lengths cannot be compared
        q, x = queries[queries["v"].map(len) == size], vectors[vectors["v"].map(len) == size]
        ids, mine = x["id"].to_numpy(), q["id"].to_numpy()
        matrix, asked = np.stack(x["v"].to_numpy()), np.stack(q["v"].to_numpy())
        for at in range(0, len(q), STRIPE):
            scores = product(asked[at : at + STRIPE], matrix)
            own = mine[at : at + STRIPE, None] == ids[None, :]
            if whole:
                row, column = select(scores, ids, k, own)
                got = scores[row, column]
            else:  # equal vectors may differ in a product's last bits: choose rounded, then score anew
                row, column = select(np.round(scores, 12), ids, k, own)
                got = pair_cosine(asked[at + row], matrix[column])
            out.append(pd.DataFrame({
                "query_id": mine[at + row], "vec_id": ids[column],
                "score": got.astype(np.int64) if whole else got,
            }))
    kind = np.int64 if whole else np.float64
    return pd.concat(out) if out else pd.DataFrame({
        "query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, kind)
    })


def best_of(lists: DataFrame, k: int, group: Sequence[str] = ()) -> DataFrame:
    """The k best rows of each query (and group); cut in every task before the shuffle."""
    order = Window.partitionBy("query_id", *group).orderBy(F.col("score").desc(), "vec_id")
    return lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def merge_tree(lists: DataFrame, k: int, shards: int, fan_in: int = 64) -> DataFrame:
    """Merge per-shard lists (query_id, vec_id, score, shard), ``fan_in`` lists at a time."""
    while shards > fan_in:
        lists = best_of(lists.withColumn("shard", F.floor(F.col("shard") / fan_in)), k, ["shard"]).drop("rank")
        shards = -(-shards // fan_in)
    return best_of(lists, k).select("query_id", "rank", "vec_id", "score")


def tiles_of(count: int, size: int) -> int:
    return max(1, -(-count // size))


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, shard: int = SHARD, block: int = BLOCK,
    product: Callable[[np.ndarray, np.ndarray], np.ndarray] = inner_product, whole: bool = True,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of each query's k best vectors.

    Both inputs have ``id`` (long) and ``v`` (array<double>, no nulls). Queries are dealt
    into blocks and vectors into shards by a hash of the id; each block meets each shard
    in one task, which multiplies their matrices and keeps k of each row. No row of a
    query's own id is a candidate. Fewer candidates give fewer rows, none give none; ties
    go to the smaller id; repeated rows of an id are candidates as often as they occur.
    """
    shards, groups = tiles_of(vectors.count(), shard), tiles_of(queries.count(), block)
    left = queries.select(
        "id", "v", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(groups).cast("long")).alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"),
    )
    # new names for the columns: both sides may come from one frame, and a cogroup needs them apart
    right = vectors.select(
        F.col("id").alias("id"), F.col("v").alias("v"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("block"),
        F.pmod(F.xxhash64("id"), F.lit(shards).cast("long")).alias("shard"),
    )
    kind = "long" if whole else "double"

    def run(key: tuple, q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        return search_tile(q, x, k, product, whole).assign(shard=key[1])

    lists = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInPandas(
        run, f"query_id long, vec_id long, score {kind}, shard long"
    )
    return merge_tree(lists, k, shards)


def exact_search(
    table: DataFrame, k: int = 5, vector: str = "embedding", key: str = "vec_id", every: int = 50
) -> DataFrame:
    """Top k by integer inner product of floor(256 * x) for rows whose id is divisible by ``every``.

    Rows with a null id, or a vector that is null, empty or holds null or non-finite
    components, take no part. Other columns are ignored.
    """
    rows = table.filter(F.col(key).isNotNull() & usable(F.col(vector))).select(
        F.col(key).cast("long").alias("id"), floor_256(F.col(vector)).alias("v")
    )
    return top_k(rows, rows.filter(F.col("id") % every == 0), k)
