"""Removal of repeated byte strings by threshold-bounded interval expansion on a BWT.

Every window of ``length`` bytes is filed under the least hash of its ``GRAM``-byte grams;
equal windows have the same least hash, and consecutive windows with one hash are kept as
one run. Runs whose hash occurs once in the corpus cannot repeat. The texts of the others
are gathered by hash into shards, and in each shard a Burrows-Wheeler transform of all its
texts gives the windows that occur again. The windows of a hash with more text than a shard
are filed again, under the least hash of other and then wider grams, in the end under the
hash of the whole window, so that no window is left out and no hash exceeds a shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidlake.llm.common import GOLDEN, blocks, column_of, keep, mix64

GRAM = 32
#: Gram size (0 is the whole window) and seed of each filing.
FILINGS = ((GRAM, 0), (GRAM, 1), (128, 2), (0, 3))
SEGMENT = 1 << 20
BLOCK = 1 << 18
#: Windows of a run; longer runs (periodic texts) are cut.
RUN = 2000
SHARD_BYTES = 2 << 20
END = b"\xff"  # occurs in no UTF-8 text


def slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """Minimum or maximum of each ``width`` consecutive values, by doubling."""
    have = 1
    while 2 * have <= width:
        values = pick(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return pick(values[:-rest], values[rest:]) if rest else values


def gram_hashes(raw: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of each ``size`` consecutive bytes, by doubling."""
    h = mix64(np.arange(256, dtype=np.uint64) + np.uint64(1 + seed * 256))[raw]
    have = 1
    while have < size:
        step = min(have, size - have)  # the last two halves may overlap
        h = h[:-step] * np.uint64(0x9FB21C651E98DF25) + h[step:]
        h ^= h >> np.uint64(29)
        have += step
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def runs_of(
    raw: np.ndarray, bounds: np.ndarray, length: int, gram: int = GRAM, seed: int = 0
) -> tuple[np.ndarray, ...]:
    """Least hash, first window, number of windows and weight (1 or 2) of each run.

    ``raw`` holds texts end to end, ``bounds`` where each starts and the last ends; windows
    over a bound are left out. Weight 2 marks a run in which the least gram stands twice:
    only such a run can hold the same window twice.
    """
    grams = gram_hashes(raw, gram, seed)
    width = length - gram + 1
    least = slide(grams, width, np.minimum)
    step = np.zeros(len(least) + 1, np.int32)
    long_ = np.flatnonzero(np.diff(bounds) >= length)
    step[bounds[long_]] += 1
    step[bounds[long_ + 1] - length + 1] -= 1
    inside = np.cumsum(step[:-1]) > 0
    start = np.concatenate([[0], np.flatnonzero((least[1:] != least[:-1]) | (inside[1:] != inside[:-1])) + 1])
    count = np.diff(np.concatenate([start, [len(least)]]))
    start, count = start[inside[start]], count[inside[start]]
    value = least[start]
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    places = np.flatnonzero(slide(padded, width, np.maximum) == grams)
    at = np.searchsorted(places, start)
    stop = np.searchsorted(places, start + count + width - 1)
    same = np.zeros(len(start), np.int64)
    for j in range(int((stop - at).max(initial=0)) if len(places) else 0):
        within = at + j < stop
        same += within & (grams[places[np.minimum(at + j, len(places) - 1)]] == value)
        if j > 16:  # a periodic text: whatever else it is, it repeats
            same[within] = 2
            break
    if count.max(initial=0) > RUN:
        cuts = -(-count // RUN)
        first = np.repeat(start, cuts) + RUN * (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts))
        ends = np.repeat(start + count, cuts)
        return np.repeat(value, cuts), first, np.minimum(first + RUN, ends) - first, np.repeat(np.minimum(same, 2), cuts)
    return value, start, count, np.minimum(same, 2)


def text_runs(
    texts: list[bytes], length: int, gram: int = GRAM, seed: int = 0
) -> Iterator[tuple[np.ndarray, ...]]:
    """Text number, least hash, first window, windows and weight of all runs of some texts.

    Each window of each whole text is in exactly one run. Short texts are done together,
    a long one a segment at a time.
    """
    for a, b in blocks([len(t) for t in texts], BLOCK):
        if b == a + 1:
            raw = np.frombuffer(texts[a], np.uint8)
            for x in range(0, max(len(raw) - length + 1, 0), SEGMENT):
                part = raw[x : x + SEGMENT + length - 1]
                value, start, count, weight = runs_of(part, np.array([0, len(part)]), length, gram, seed)
                yield np.full(len(value), a), value.view(np.int64), start + x, count, weight
            continue
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts[a:b]])])
        if bounds[-1] >= length:
            raw = np.frombuffer(b"".join(texts[a:b]), np.uint8)
            value, start, count, weight = runs_of(raw, bounds, length, gram, seed)
            which = np.searchsorted(bounds, start, side="right") - 1
            yield which + a, value.view(np.int64), start - bounds[which], count, weight


def sorted_suffixes(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order by at least ``depth`` bytes (prefix doubling), and each suffix's first 8 bytes."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    first = np.zeros(n, np.uint64)
    for i in range(8):
        first = (first << np.uint64(8)) | padded[i : i + n]
    order = np.argsort(first)
    ranked = first[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = group
    have = 8
    while have < depth:
        # places in the order whose group has more than one suffix
        single = new & np.append(new[1:], True)
        open_ = np.flatnonzero(~single)
        if not len(open_):
            break
        suffix = order[open_]
        key = group[open_] * (n + 2) + rank[np.minimum(suffix + have, n)] + 1
        by = np.argsort(key)
        suffix, key = suffix[by], key[by]
        order[open_] = suffix
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        new[open_] |= fresh
        group[open_] = np.maximum.accumulate(np.where(fresh, open_, 0))
        rank[suffix] = group[open_]
        have *= 2
    return order, first


def repeated_starts(text: np.ndarray, length: int) -> np.ndarray:
    """True at each position whose next ``length`` bytes start at another position as well.

    The text ends with a byte that no string of interest holds; strings with it are not judged.

    The common prefix of neighbours in suffix order is derived level by level. The first 8
    bytes give levels 0 to 7. Then, from level to level, each boundary found is extended
    backward: if the next rows with one character before them enclose a boundary of level
    l, the boundary between their extensions, when not yet found, has level l + 1. After
    level ``length`` - 1 the boundaries not found are those with longer common prefixes,
    whatever their exact value.
    """
    n = len(text)
    if n < 2:
        return np.zeros(n, bool)
    order, first = sorted_suffixes(text, length)
    before = text[order - 1]
    lead = first[order]
    differ = lead[1:] ^ lead[:-1]
    common = np.zeros(n, np.int16)  # of row r with row r - 1; row 0 has level 0
    for j in range(1, 9):
        common[1:] += differ < (np.uint64(1) << np.uint64(64 - 8 * j)) if j < 8 else differ == 0
    found = common < 8
    by_char = np.argsort(before, kind="stable")  # also the order of the extensions
    same = before[by_char][1:] == before[by_char][:-1]
    extension = np.empty(n, np.int64)
    extension[by_char] = np.arange(n)
    following = np.full(n, n, np.int64)
    following[by_char[:-1][same]] = by_char[1:][same]
    target = extension + 1  # the boundary between a row's extension and the next row's
    live = np.flatnonzero((following < n) & ~found[np.minimum(target, n - 1)])
    wide = live[following[live] - live > 1]
    level = np.flatnonzero(common == 7)
    for _ in range(8, length):
        left = level - 1
        hit = left[(left >= 0) & (following[np.maximum(left, 0)] == level)]
        reached = [target[hit]]
        if len(wide) and len(level):
            inside = np.searchsorted(level, wide, side="right") < np.searchsorted(level, following[wide], side="right")
            reached.append(target[wide[inside]])
            wide = wide[~inside]
        more = np.concatenate(reached)
        more = np.sort(more[~found[more]])
        more = more[np.concatenate([[True], more[1:] != more[:-1]])] if len(more) else more
        if not len(more):
            break
        found[more] = True
        level = more
    deep = np.flatnonzero(~found)
    mark = np.zeros(n, bool)
    mark[order[deep]] = True
    mark[order[deep - 1]] = True
    return mark


def ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).view(np.int8)))
    return edges[::2], edges[1::2]


def repeated_in(texts: list[bytes], copies: list[int], length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the ranges of window starts that occur again in these texts."""
    joined = np.frombuffer(END.join(texts) + END, np.uint8)
    mark = repeated_starts(joined, length)
    out, at = [], 0
    for text, n in zip(texts, copies):
        windows = len(text) - length + 1
        flags = mark[at : at + windows].copy()
        if n > 1:
            flags[:] = True
        out.append(ranges(flags))
        at += len(text) + 1
    return out


def filed_again(texts: DataFrame, length: int, filing: int) -> tuple[DataFrame, DataFrame]:
    """Texts under the hashes of a later filing, and where they stand in ``texts``.

    Windows keep to the hash they had, so each is compared with what it could equal before.
    """
    gram = min(FILINGS[filing][0] or length, length)
    seed = FILINGS[filing][1]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            key, copies = batch["key"].to_numpy(), batch["copies"].to_numpy()
            had = batch["least"].to_numpy().view(np.uint64) * GOLDEN
            for which, value, start, count, weight in text_runs(list(batch["piece"]), length, gram, seed):
                yield pd.DataFrame({
                    "key": key[which], "least": mix64(had[which] + value.view(np.uint64)).view(np.int64),
                    "start": start, "windows": count, "weight": weight * copies[which],
                })

    runs = keep(texts.mapInPandas(find, "key binary, least long, start long, windows int, weight long"))
    often = runs.groupBy("least").agg(F.sum("weight").alias("_n")).filter("_n > 1").select("least")
    wanted = (
        runs.join(often, "least", "left_semi").groupBy("key")
        .agg(F.collect_list(F.struct("start", "windows", "least")).alias("runs"))
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for parent, text, copies, found in zip(batch["key"], batch["piece"], batch["copies"], batch["runs"]):
                for r in found:
                    piece = text[r["start"] : r["start"] + r["windows"] + length - 1]
                    key = hashlib.blake2b(piece, digest_size=16).digest()
                    rows.append((parent, r["start"], r["least"], key, piece, copies))
            yield pd.DataFrame(rows, columns=["parent", "start", "least", "key", "piece", "copies"])

    parts = keep(
        texts.select("key", "piece", "copies").join(wanted, "key").mapInPandas(
            cut, "parent binary, start long, least long, key binary, piece binary, copies long"
        )
    )
    finer = keep(parts.groupBy("least", "key", "piece").agg(F.sum("copies").alias("copies")))
    return finer, parts.select("parent", "start", "key")


def repeats_among(texts: DataFrame, length: int, shard_bytes: int, filing: int = 0) -> DataFrame:
    """``key``, ``a``, ``b``: ranges of window starts in ``texts`` that occur again among them.

    A hash whose texts exceed ``shard_bytes`` is filed again; the others go to shards of
    about that size. Under the last filing a hash has one text, a window.
    """
    sizes = texts.groupBy("least").agg(F.sum(F.length("piece") + 1).alias("_size"))
    last = filing == len(FILINGS) - 1
    large = F.lit(False) if last else F.col("_size") > shard_bytes
    total, heavy = sizes.agg(F.sum(F.when(~large, F.col("_size"))), F.sum(large.cast("long"))).first()
    light = texts
    if heavy:  # few, as each has more than a shard
        over = F.broadcast(sizes.filter(large).select("least"))
        light = texts.join(over, "least", "left_anti")
    shards = max(1, -(-(total or 0) // shard_bytes))

    def expand(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        # copies of one text and no other text of this hash: every window is known to repeat
        plain = (frame.groupby("least")["key"].transform("size") == 1) & (frame["copies"] > 1)
        rows = [(k, [0], [len(p) - length + 1]) for k, p in zip(frame["key"][plain], frame["piece"][plain])]
        frame = frame[~plain]
        found = repeated_in(list(frame["piece"]), list(frame["copies"]), length)
        rows += [(k, a, b) for k, (a, b) in zip(frame["key"], found) if len(a)]
        return pd.DataFrame(rows, columns=["key", "a", "b"])

    repeats = light.withColumn("_shard", F.pmod(F.xxhash64("least"), F.lit(shards))).groupBy("_shard").applyInPandas(
        expand, "key binary, a array<long>, b array<long>"
    )
    if not heavy:
        return repeats
    finer, places = filed_again(texts.join(over, "least", "left_semi"), length, filing + 1)
    again = places.join(repeats_among(finer, length, shard_bytes, filing + 1), "key")
    return repeats.unionByName(again.select(
        F.col("parent").alias("key"),
        F.transform("a", lambda x: x + F.col("start")).alias("a"),
        F.transform("b", lambda x: x + F.col("start")).alias("b"),
    ))


def repeated_spans(docs: DataFrame, length: int = 200, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``_d``, ``_h`` (row key) and ``_spans``: byte ranges covered by repeated strings."""
    keyed = docs.select("_d", "_h", "text")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            d, h = batch["_d"].to_numpy(), batch["_h"].to_numpy()
            data = [(t or "").encode("utf-8", "surrogatepass") for t in column_of(batch, "text")]
            for which, value, start, count, weight in text_runs(data, length):
                yield pd.DataFrame({
                    "_d": d[which], "_h": h[which], "least": value, "start": start, "windows": count,
                    "weight": weight,
                })

    runs = keep(keyed.mapInPandas(find, "_d long, _h long, least long, start long, windows int, weight int"))
    often = runs.groupBy("least").agg(F.sum("weight").alias("_n")).filter("_n > 1").select("least")
    wanted = (
        runs.join(often, "least", "left_semi").groupBy("_d", "_h")
        .agg(F.collect_set(F.struct("start", "windows", "least")).alias("runs"))
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, h, text, found in zip(batch["_d"], batch["_h"], column_of(batch, "text"), batch["runs"]):
                data = (text or "").encode("utf-8", "surrogatepass")
                rows = []
                for r in found:
                    piece = data[r["start"] : r["start"] + r["windows"] + length - 1]
                    rows.append((d, h, r["start"], r["least"], hashlib.blake2b(piece, digest_size=16).digest(), piece))
                yield pd.DataFrame(rows, columns=["_d", "_h", "start", "least", "key", "piece"])

    pieces = keep(
        keyed.join(wanted, ["_d", "_h"]).mapInPandas(
            cut, "_d long, _h long, start long, least long, key binary, piece binary"
        )
    )
    texts = keep(pieces.groupBy("least", "key", "piece").agg(F.count("*").alias("copies")))
    repeats = repeats_among(texts, length, shard_bytes)
    spans = pieces.select("_d", "_h", "start", "key").join(repeats, "key").select(
        "_d", "_h",
        F.explode(F.arrays_zip("a", "b")).alias("r"), "start",
    ).select("_d", "_h", F.struct(
        (F.col("start") + F.col("r.a")).alias("a"), (F.col("start") + F.col("r.b") + (length - 1)).alias("b")
    ).alias("span"))
    return spans.groupBy("_d", "_h").agg(F.array_sort(F.collect_set("span")).alias("_spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs covered by sorted ranges."""
    out: list[list[int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without_repeats(docs: DataFrame, length: int = 200, **options) -> DataFrame:
    """Every row of ``docs`` with the struct ``deduplicated``.

    It holds ``n_bytes`` (of the text in UTF-8), ``n_removed`` bytes, ``n_spans`` (maximal removed runs), ``spans`` (byte
    ranges, end exclusive), ``kept`` (the remaining bytes) and ``kept_sha256``. Each byte
    covered by a string of ``length`` bytes that also starts elsewhere in the table, in
    the same text or another row, is removed; all occurrences are judged on the input.
    Null text is empty; shorter texts lose nothing; each of some repeated rows is
    "elsewhere" for the others. An existing column ``deduplicated`` is replaced.
    """
    rows = docs.drop("deduplicated").withColumns({
        "_d": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)),
        "_h": F.xxhash64("doc_id", "text"),
    })
    spans = repeated_spans(rows, length, **options)
    schema = "n_bytes long, n_removed long, n_spans long, spans array<array<long>>, kept binary, kept_sha256 string"

    @F.pandas_udf(schema)
    def remove(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        out = []
        for text, ranges_ in zip(texts, found):
            data = b"" if text is None or text != text else text.encode("utf-8", "surrogatepass")
            runs = merged([(int(r["a"]), int(r["b"])) for r in ranges_]) if ranges_ is not None else []
            parts, end = [], 0
            for a, b in runs:
                parts.append(data[end:a])
                end = b
            kept = b"".join([*parts, data[end:]])
            out.append((
                len(data), sum(b - a for a, b in runs), len(runs), [list(r) for r in runs], kept,
                hashlib.sha256(kept).hexdigest(),
            ))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256"])

    return rows.join(spans, ["_d", "_h"], "left").withColumn(
        "deduplicated", remove("text", "_spans")
    ).drop("_d", "_h", "_spans")
