"""Near-duplicate documents by SuperMinHash, banding, verification and union-find."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidlake.llm.common import GOLDEN, blocks, column_of, keep, mix64
from evidlake.llm.components import components
from evidlake.llm.shingles import shingle_sets
from evidlake.operators.joins import lookup_join

BANDS, ROWS = 32, 4


def super_minhash(sets: list[np.ndarray], registers: int, seed: int = 1) -> np.ndarray:
    """One row of registers for each non-empty set.

    Each element has a random permutation of the registers, made step by step: in step k
    it offers k plus a random fraction to the k-th register of its permutation. A register
    keeps its least offer. Once every register of a set holds less than k, later steps
    cannot change it, and the set stops; large sets stop after two or three steps.
    """
    n = len(sets)
    signature = np.full(n * registers, np.inf)
    owner = np.repeat(np.arange(n) * registers, [len(s) for s in sets])
    element = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    element = element ^ mix64(np.full(1, seed, np.uint64))[0]
    swaps: list[np.ndarray] = []
    for k in range(registers):
        random = mix64(element + np.full(1, k + 1, np.uint64) * GOLDEN)
        chosen = k + ((random >> np.uint64(32)) % np.uint64(registers - k)).astype(np.int64)
        register = chosen
        for t in range(k - 1, -1, -1):  # undo the swaps of earlier steps
            register = np.where(swaps[t] == register, t, register)
        offer = k + (random & np.uint64(0xFFFFFFFF)).astype(np.float64) / 2.0**32
        np.minimum.at(signature, owner + register, offer)
        open_sets = signature.reshape(n, registers).max(axis=1) >= k + 1
        if not open_sets.any():
            break
        stays = open_sets[owner // registers]
        element, owner = element[stays], owner[stays]
        swaps = [s[stays] for s in [*swaps, chosen]]
    return signature.reshape(n, registers)


def _bands(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = mix64(signature.view(np.uint64)).reshape(len(signature), bands, rows)
    h = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * GOLDEN
    for i in range(rows):
        h = mix64(h ^ bits[:, :, i]) + GOLDEN
    return h.view(np.int64)


def texts_of(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_hash``, ``text``; the first two name a row's text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def fingerprints(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n_shingles``, two set hashes and the bands."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["doc_id"]
            sets = []
            sizes = [0 if t is None else len(t) for t in column_of(batch, "text")]
            for a, b in blocks(sizes, 4 << 20):
                sets = list(shingle_sets(column_of(batch.iloc[a:b], "text")))
                full = [i for i, s in enumerate(sets) if len(s)]
                signature = np.zeros((0, bands * rows))
                parts = [
                    super_minhash([sets[i] for i in full[x:y]], bands * rows)
                    for x, y in blocks([8 * len(sets[i]) for i in full], 1 << 20)
                ]
                if parts:
                    signature = np.concatenate(parts)
                keys: list = [None] * len(sets)
                for i, x in zip(full, _bands(signature, bands, rows)):
                    keys[i] = x
                yield pd.DataFrame({
                    "doc_id": ids.iloc[a:b].astype("Int64").array,
                    "text_hash": batch["text_hash"].iloc[a:b].to_numpy(),
                    "n_shingles": [len(s) for s in sets],
                    "hash1": [int(np.bitwise_xor.reduce(s).view(np.int64)) if len(s) else 0 for s in sets],
                    "hash2": [int(mix64(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for s in sets],
                    "bands": keys,
                })

    return texts_of(docs).mapInPandas(
        run,
        "doc_id long, text_hash long, n_shingles long, hash1 long, hash2 long, bands array<long>",
    )


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are similar enough.

    ``nodes`` has node, doc_id, text_hash, the row that stands for a node; ``texts`` has
    doc_id, text_hash, text.
    """
    with_texts = pairs
    for side in "ab":
        row = nodes.select(F.col("node").alias(side), "doc_id", "text_hash")
        text = texts.withColumnRenamed("text", f"text_{side}")
        with_texts = with_texts.join(row, side).join(text, ["doc_id", "text_hash"]).drop("doc_id", "text_hash")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: OrderedDict[int, np.ndarray] = OrderedDict()

        def get(key: int, text: str) -> np.ndarray:
            if key not in known:
                known[key] = next(shingle_sets([text]))
                if len(known) > 64:
                    known.popitem(last=False)
            return known[key]

        for batch in batches:
            good = []
            for a, b, text_a, text_b in zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"]):
                x, y = get(a, text_a), get(b, text_b)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    good.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.loc[good, ["a", "b"]]

    return with_texts.mapInPandas(run, "a long, b long")


def linked_pairs(sets: list[np.ndarray], components_: list, percent: int, stripe: int = 4096) -> list[tuple[int, int]]:
    """Links between different components among some sets, as few as keep what they connect.

    All intersections at once: products of the sets' incidence matrix with itself, over
    ``stripe`` shingles at a time.
    """
    n = len(sets)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    common = times[column] > 1
    names = np.cumsum(times > 1) - 1
    row, column = row[common], names[column[common]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((n, n), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, stripe):
        x, y = np.searchsorted(column, [at, at + stripe])
        part = np.zeros((n, stripe), np.float32)
        part[row[x:y], column[x:y] - at] = 1
        both += part @ part.T
    size = np.array([len(s) for s in sets], np.float64)
    label = np.unique(np.array(components_), return_inverse=True)[1]
    link = 100.0 * both >= percent * (size[:, None] + size[None, :] - both)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in np.argwhere(np.triu(link & (label[:, None] != label[None, :]), 1)).tolist():
        a, b = find(int(label[i])), find(int(label[j]))
        if a != b:
            root[b] = a
            out.append((i, j))
    return out


def able_to_link(sets: DataFrame, percent: int) -> DataFrame:
    """Ids whose sets (id, component, shingles) can be linked with one of another component.

    Order all shingles so that those of one component come first. A set x is only linked with
    a set that shares one of its first |x| - ceil(t |x|) + 1 shingles, in any such order; so
    a set with as many shingles that no other component has is linked with none. No two
    sets meet here: shingles are counted, and every set is held against its own count.
    """
    each = sets.select("id", "component", F.explode("shingles").alias("shingle"))
    shared = each.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    common = lookup_join(each.select("id", "shingle"), shared.filter("lo <> hi").select("shingle"), "shingle", "inner", spread=["id"])
    counted = common.groupBy("id").agg(F.count("*").alias("common"))
    size = F.size("shingles").cast("long")
    first = size - F.call_function("div", size * percent + 99, F.lit(100)) + 1
    return sets.join(counted, "id").filter(size - F.col("common") < first).select("id")


def _rest(buckets: DataFrame, nodes: DataFrame, texts: DataFrame, groups: DataFrame, percent: int, block: int) -> DataFrame:
    """Confirmed links between members of a bucket that lie in different components.

    Only buckets whose members are in several components after the first round are left, and
    of these only members that counts of shingles let be linked with another component.
    They are dealt into blocks, and every two blocks of a bucket meet in a task, which
    compares full sets and returns at most a tree of links: neither a task's input nor the
    result grows with the square of the bucket. Texts are hashed once; tasks get sets.
    """
    labelled = buckets.join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "component", F.coalesce("component", "id")
    )

    def mixed(rows: DataFrame) -> DataFrame:
        of = rows.groupBy("bucket").agg(
            F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")
        )
        return rows.join(of.filter("lo <> hi").select("bucket", "n"), "bucket")

    # of two members one is the bucket's least, which all others were held against
    members = keep(mixed(labelled).filter("n > 2").drop("n"))
    who = members.select("id", "component").distinct()
    rows = who.join(nodes.withColumnRenamed("node", "id"), "id").join(texts, ["doc_id", "text_hash"])

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [s.view(np.int64) for s in shingle_sets(column_of(batch, "text"))]
            yield pd.DataFrame({"id": batch["id"], "component": batch["component"], "shingles": sets})

    sets = rows.select("id", "component", "text").mapInPandas(hashed, "id long, component long, shingles array<long>")
    # rows that repeat an id and text have one set
    sets = keep(sets.groupBy("id").agg(F.first("component").alias("component"), F.first("shingles").alias("shingles")))
    able = keep(able_to_link(sets, percent))
    members = mixed(keep(members.join(able, "id"))).withColumn("of", F.ceil(F.col("n") / block).cast("int"))
    members = members.withColumn("at", F.pmod(F.xxhash64("id"), F.col("of")).cast("int"))
    # two blocks i <= j hold all their members; of one block, i = j
    tiles = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1))).select(
        "bucket", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "id", "component"
    ).join(sets.select("id", "shingles"), "id")

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        if frame["component"].nunique() < 2:
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        ids = frame["id"].to_numpy()
        found = [np.asarray(s, np.int64) for s in frame["shingles"]]
        pairs = linked_pairs(found, list(frame["component"]), percent)
        return pd.DataFrame(
            {"a": [ids[i] for i, _ in pairs], "b": [ids[j] for _, j in pairs]}, dtype=np.int64
        )

    return tiles.groupBy("bucket", "i", "j").applyInPandas(run, "a long, b long")


def numbered(classes: DataFrame) -> DataFrame:
    """Classes with a number ``node`` of their own: a hash, under the first seed without equal ones."""
    keys = ["n_shingles", "hash1", "hash2"]
    total = classes.count()
    for seed in range(64):
        out = classes.withColumn("node", F.xxhash64(F.lit(seed), *keys))
        if out.select("node").distinct().count() == total:
            return out
    raise RuntimeError("no seed tells all classes apart")


def labelled_rows(docs: DataFrame, percent: int, bands: int, rows: int, block: int) -> DataFrame:
    """Every row's doc_id, text_hash and n_shingles, with the row that stands for its component.

    That row, ``first`` (doc_id, text_hash), is null for a text without words or id.
    """
    known = keep(fingerprints(docs, bands, rows))
    keys = ["n_shingles", "hash1", "hash2"]
    classes = keep(
        known.filter("n_shingles > 0 and doc_id is not null").groupBy(*keys).agg(
            F.min(F.struct("doc_id", "text_hash")).alias("row"), F.first("bands").alias("bands")
        )
    )
    classes = keep(numbered(classes))
    nodes = classes.select("node", "row.*")
    buckets = classes.select(F.col("node").alias("id"), F.explode("bands").alias("bucket"))
    pivots = buckets.groupBy("bucket").agg(F.min("id").alias("pivot"), F.count("*").alias("n"))
    first = (
        buckets.join(pivots.filter("n > 1"), "bucket").filter("id <> pivot")
        .select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    )
    texts = texts_of(docs)
    links = keep(verified(first, nodes, texts, percent))
    groups = components(links)
    more = keep(_rest(buckets, nodes, texts, groups, percent, block))
    if not more.isEmpty():
        groups = components(
            groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
        )
    placed = classes.join(groups, "node", "left").select(
        *keys, "row", F.coalesce("component", "node").alias("component")
    )
    least = placed.groupBy("component").agg(F.min("row").alias("first"))
    labels = lookup_join(placed.drop("row"), least, "component", "inner", spread=keys).drop("component")
    # a null id is no node, whatever its text
    named = known.withColumn("n_shingles_", F.col("n_shingles"))
    own = named.withColumn("n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("n_shingles")))
    return own.join(labels, keys, "left").select("doc_id", "text_hash", F.col("n_shingles_").alias("n_shingles"), "first")


def near_duplicates(
    docs: DataFrame, percent: int = 75, bands: int = BANDS, rows: int = ROWS, block: int = 512
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Documents whose sets of five-word shingles have 100 * intersection >= percent * union
    are linked; a component is what links reach, and its least ``doc_id`` is kept. Equal
    sets are one node from the start, so thousands of copies cost one signature.

    Two sets of similarity 0.75 share none of 32 bands of 4 registers with probability
    5e-6. First, every member of a bucket is held against the bucket's least member; then
    members of buckets that still span several components are compared in blocks. Every
    link is confirmed on full sets.

    Null or wordless texts have an empty set and are linked with nothing. A null
    ``doc_id`` is no node: such a row has a null component and is kept. Rows of one id
    with different texts are nodes of their own, and links do not pass from one to the
    other by the id; repeated rows give repeated results. Other columns of ``docs`` are
    ignored.
    """
    found = labelled_rows(docs, percent, bands, rows, block)
    return found.select(
        "doc_id", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(
    docs: DataFrame, percent: int = 75, bands: int = BANDS, rows: int = ROWS, block: int = 512
) -> DataFrame:
    """The documents that stay, with all their columns: one row of each component.

    That is the row with the least id, and of its texts the one with the least hash. A row
    goes only for a kept row of its own component, or for a kept one with its id and text.
    Rows without an id stay.
    """
    found = labelled_rows(docs, percent, bands, rows, block)
    goes = ~F.col("first").eqNullSafe(F.struct("doc_id", "text_hash")) & F.col("first").isNotNull()
    gone = found.filter(goes).select(F.col("doc_id").alias("id of row"), F.col("text_hash").alias("hash of text")).distinct()
    own = [F.col(f"`{c}`") for c in docs.columns]
    # rows are given an order of their own by what else they hold
    row = docs.select(
        F.struct(*own).alias("own row"), F.col("doc_id").cast("long").alias("id of row"), F.xxhash64("text").alias("hash of text"),
        F.xxhash64(*own).alias("order of row"),
    )
    named = row.filter(F.col("id of row").isNotNull()).join(gone, ["id of row", "hash of text"], "left_anti")
    place = F.row_number().over(Window.partitionBy("id of row", "hash of text").orderBy("order of row"))
    once = named.withColumn("place", place).filter("place = 1").select("own row.*")
    return once.unionByName(docs.filter(F.col("doc_id").isNull()))
