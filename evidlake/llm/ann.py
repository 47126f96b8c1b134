"""Approximate nearest neighbours: balanced graph partitions and a learnt router."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidlake.llm.common import hashed_sample, keep
from evidlake.llm.topk import merge_tree, search_tile, tiles_of, usable

#: Bound of the sample on which graph, partitions and router are fitted.
SAMPLE = 6000
TILE, BLOCK = 4096, 4096


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Each row's k nearest other rows by cosine, a stripe at a time."""
    k = min(k, len(x) - 1)
    found = np.zeros((len(x), max(k, 0)), np.int64)
    for a in range(0, len(x) if k > 0 else 0, 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        found[a : a + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return found


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.05) -> np.ndarray:
    """Partition a neighbour graph into parts of at most ``slack`` times the mean size.

    Starts from recursive halving along principal directions and then moves nodes to the
    part that holds most of their neighbours (in both directions of the edges), best gain
    first, as long as there is room; every move lowers the number of cut edges.
    """
    n = len(x)
    part = np.zeros(n, np.int64)
    count = 1
    while count < parts:
        for p in range(count):
            at = np.flatnonzero(part == p)
            if len(at) > 1:
                centred = x[at] - x[at].mean(axis=0)
                along = centred @ np.linalg.eigh(centred.T @ centred)[1][:, -1]
                part[at[np.argsort(along, kind="stable")[len(at) // 2 :]]] = p + count
        count *= 2
    room = int(np.ceil(slack * n / count))
    source = np.repeat(np.arange(n), graph.shape[1])
    ends = np.concatenate([source, graph.ravel()]), np.concatenate([graph.ravel(), source])
    for _ in range(rounds):
        votes = np.bincount(ends[0] * count + part[ends[1]], minlength=n * count).reshape(n, count)
        gain = votes.max(axis=1) - votes[np.arange(n), part]
        sizes = np.bincount(part, minlength=count)
        moved = 0
        for i in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())].tolist():
            to = int(votes[i].argmax())
            if sizes[to] < room:
                sizes[part[i]] -= 1
                sizes[to] += 1
                part[i] = to
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """A softmax classifier over parts, and how many of them a query tries at least.

    A query that lies apart from the sample has no clear part: it also tries parts until
    their probabilities add up to ``mass``.
    """

    weights: np.ndarray
    bias: np.ndarray
    probes: int
    mass: float = 0.8

    def order(self, x: np.ndarray) -> np.ndarray:
        """Parts of each row, most probable first."""
        return np.argsort(-(unit_rows(x) @ self.weights + self.bias), axis=1, kind="stable")

    def tries(self, x: np.ndarray, order: np.ndarray) -> np.ndarray:
        """How many parts of each row's order the row tries."""
        z = np.take_along_axis(unit_rows(x) @ self.weights + self.bias, order, axis=1)
        p = np.exp(z - z[:, :1])
        added = np.cumsum(p, axis=1) / p.sum(axis=1, keepdims=True)
        likely = (added < self.mass).sum(axis=1) + 1
        return np.minimum(np.maximum(likely, self.probes), order.shape[1])


def train_router(x: np.ndarray, part: np.ndarray, graph: np.ndarray, parts: int, steps: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Fit on soft targets: the shares of a row's own and its neighbours' parts."""
    n = len(x)
    target = np.bincount(
        np.repeat(np.arange(n), graph.shape[1]) * parts + part[graph].ravel(), minlength=n * parts
    ).reshape(n, parts).astype(float)
    target[np.arange(n), part] += max(graph.shape[1] / 2, 1)
    target /= target.sum(axis=1, keepdims=True)
    w, b = np.zeros((x.shape[1], parts)), np.zeros(parts)
    m, v = np.zeros((x.shape[1] + 1, parts)), np.zeros((x.shape[1] + 1, parts))
    for t in range(1, steps + 1):
        z = x @ w + b
        z = np.exp(z - z.max(axis=1, keepdims=True))
        error = (z / z.sum(axis=1, keepdims=True) - target) / n
        g = np.vstack([x.T @ error + 1e-6 * w, error.sum(axis=0)[None]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-12)
        w -= step[:-1]
        b -= step[-1]
    return w, b


def fit(vectors: DataFrame, k: int = 5, parts: int = 64, neighbours: int = 10, sample: int = SAMPLE, recall: float = 0.95, seed: int = 3) -> Router:
    """Fit graph, partitions and router on at most ``sample`` rows chosen by a hash of the id.

    A third of the sample is kept from the fit. The number of parts that a query tries is
    the least one with which these rows find ``recall`` of their true nearest rows of the
    whole sample, each row lying in its most probable part.
    """
    rows = hashed_sample(vectors, sample, "id", seed=seed)
    if len(rows):
        size = int(rows["v"].map(len).mode().iloc[0])
        rows = rows[rows["v"].map(len) == size]
    if len(rows) < 4 * k + 8:
        width = len(rows["v"].iloc[0]) if len(rows) else 1
        return Router(np.zeros((width, 1)), np.zeros(1), 1)
    x = unit_rows(np.stack(rows["v"].to_numpy()))
    learnt = x[len(x) // 3 :]
    parts = min(parts, 1 << int(np.log2(max(len(learnt) // (2 * k), 1))))
    parts = 1 << int(np.log2(max(parts, 1)))
    graph = neighbour_graph(learnt, neighbours)
    part = balanced_parts(learnt, graph, parts)
    router = Router(*train_router(learnt, part, graph, parts), parts)
    home = router.order(x)[:, 0]
    asked = x[: len(x) // 3]
    scores = asked @ x.T
    scores[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    true = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    place = np.argsort(router.order(asked), axis=1)
    needed = np.take_along_axis(place, home[true], axis=1) + 1
    router.probes = int(np.ceil(np.quantile(needed, recall)))
    return router


def cosine(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosines of the original vectors, in doubles."""
    return (queries @ vectors.T) / (np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(vectors, axis=1)[None, :])


def assign(rows: DataFrame, router: Router, sizes: dict[int, int] | None = None, wanted: int = 0) -> DataFrame:
    """Each row in its most probable part; with ``sizes`` of the parts, a query in those it tries.

    These are as many of the most probable parts as the router says and, in its order, as many
    more as hold ``wanted`` vectors, if all together do. Vectors of another length than the
    router's are all in part 0.
    """
    shared = rows.sparkSession.sparkContext.broadcast((router, sizes))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r, known = shared.value
        for batch in batches:
            chosen: list[np.ndarray] = [np.zeros(1, np.int64)] * len(batch)
            fits = np.flatnonzero(batch["v"].map(len).to_numpy() == len(r.weights))
            if len(fits):
                x = np.stack(batch["v"].iloc[fits].to_numpy())
                order = r.order(x)
                tried = np.ones(len(fits), np.int64)
                if known is not None:
                    held = np.cumsum(np.array([known.get(p, 0) for p in range(order.shape[1])])[order], axis=1)
                    enough = np.minimum((held < wanted).sum(axis=1) + 1, order.shape[1])
                    tried = np.maximum(enough, r.tries(x, order))
                for i, parts, n in zip(fits, order, tried):
                    chosen[i] = parts[:n]
            yield batch.assign(parts=chosen)

    return rows.mapInPandas(run, "id long, v array<double>, parts array<long>").select(
        "id", "v", F.explode("parts").alias("part")
    )


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, router: Router | None = None, tile: int = TILE, block: int = BLOCK, **options) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the nearest rows found.

    Every vector is indexed in its most probable part. A query goes to the router's
    ``probes`` most probable parts, and to more where these hold fewer than k other vectors,
    and is ranked there by exact cosine. Parts are cut into
    tiles and the queries of a part into blocks, so no part has to fit into a task. Inputs
    are as for ``topk.top_k``, without zero vectors; ties go to the smaller id.
    """
    router = fit(vectors, k, **options) if router is None else router
    indexed = assign(vectors, router)
    width = F.size("v") == len(router.weights)
    # one row for each of the router's parts
    counts = indexed.groupBy("part").agg(F.count("*").alias("n"), F.count(F.when(width, 1)).alias("fits")).collect()
    sizes = {r["part"]: r["n"] for r in counts}
    asked = assign(queries, router, {r["part"]: r["fits"] for r in counts}, k + 1)
    calls = {r["part"]: r["n"] for r in asked.groupBy("part").agg(F.count("*").alias("n")).collect()}
    tiles = {p: tiles_of(n, tile) for p, n in sizes.items() if p in calls}
    blocks = {p: tiles_of(calls[p], block) for p in tiles}
    if not tiles:
        return merge_tree(vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double, shard long"), k, 1)
    pairs = vectors.sparkSession.createDataFrame(
        [(p, tiles[p], blocks[p]) for p in tiles], "part long, tiles long, blocks long"
    )
    right = indexed.join(F.broadcast(pairs), "part").select(
        F.col("id").alias("id"), F.col("v").alias("v"), F.col("part").alias("part"), F.pmod(F.xxhash64("id"), F.col("tiles")).alias("tile"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"),
    )
    left = asked.join(F.broadcast(pairs), "part").select(
        "id", "v", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile"),
        F.pmod(F.xxhash64(F.lit(1), "id"), F.col("blocks")).alias("block"),
    )
    keys = ["part", "tile", "block"]
    first, total = {}, 0
    for p in sorted(tiles):
        first[p] = total
        total += tiles[p]

    def run(key: tuple, q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        return search_tile(q, x, k, cosine, False).assign(shard=first[key[0]] + key[1])

    lists = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        run, "query_id long, vec_id long, score double, shard long"
    )
    return merge_tree(lists, k, total, fan_in=256)


def approximate_search(table: DataFrame, k: int = 5, vector: str = "embedding", key: str = "vec_id", every: int = 50, **options) -> DataFrame:
    """Nearest rows by cosine for rows whose id is divisible by ``every``.

    Rows with a null id, or a vector that is null, empty, zero or holds null or non-finite
    components, take no part. Other columns are ignored; an empty table gives no rows.
    """
    v = F.col(vector)
    rows = keep(
        table.filter(F.col(key).isNotNull() & usable(v) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False)))
        .select(F.col(key).cast("long").alias("id"), F.transform(v, lambda x: x.cast("double")).alias("v"))
    )
    return nearest(rows, rows.filter(F.col("id") % every == 0), k, **options)
