"""Best-fit packing of token sequences by bin completion."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidlake.llm.common import column_of, keep

# The pre-tokenizer of byte-level BPE vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level BPE of a tokenizers file, run by tiktoken: same ids, about five times faster.

    In these vocabularies ids rise with the order of merges, so an id is a rank. Texts are
    split at the file's added tokens, which have ids of their own.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)
    added = vocabulary.get("added_tokens", [])
    if any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that take blanks or whole words only are not supported")
    special = {t["content"]: t["id"] for t in added}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    ranks = {
        bytes(letters[c] for c in token): i
        for token, i in vocabulary["model"]["vocab"].items()
        if token not in special
    }
    return tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


#: From about a million white-space characters in a row on, the faster encoder's expressions
#: run out of stack; texts with long runs go to tokenizers itself.
LONG_SPACE = re.compile(r"\s{100000}")


@lru_cache(maxsize=2)
def plain_encoder(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def token_ids(path: str, text: str) -> list[int]:
    """Ids of a whole text, added tokens by their own ids, without special tokens around it."""
    if len(text) >= 100_000 and LONG_SPACE.search(text):
        return plain_encoder(path).encode(text, add_special_tokens=False).ids
    return encoder(path).encode(text, allowed_special="all")


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` of each piece.

    ``tokenizer`` is a path that every executor can read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = partial(token_ids, tokenizer)
        for batch in batches:
            out: list[tuple] = []
            for at, (doc_id, text) in enumerate(zip(batch["doc_id"], column_of(batch, "text"))):
                ids = encode(text or "")
                ids.append(end_id)
                data = np.array(ids, "<u4").tobytes()
                first = len(ids) % capacity or min(capacity, len(ids))
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(edges, edges[1:])):
                    out.append((doc_id, piece, a, b - a, zlib.crc32(data[4 * a : 4 * b])))
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


class Lengths:
    """A multiset of lengths with the largest one not over a limit at hand."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.count = np.bincount(lengths, minlength=capacity + 1).tolist()
        self.mask = sum(1 << i for i, n in enumerate(self.count) if n)

    def at_most(self, limit: int) -> int:
        """0 if there is none."""
        return max((self.mask & ((2 << limit) - 1)).bit_length() - 1, 0) if limit > 0 else 0

    def take(self, length: int) -> None:
        self.count[length] -= 1
        if not self.count[length]:
            self.mask ^= 1 << length

    def give(self, length: int) -> None:
        if not self.count[length]:
            self.mask |= 1 << length
        self.count[length] += 1


def best_fit(lengths: Lengths, space: int) -> tuple[list[int], int]:
    """The best-fit-decreasing filling of ``space`` and what it leaves."""
    chosen: list[int] = []
    item = lengths.at_most(space)
    while item:
        n = min(lengths.count[item], space // item)
        chosen += [item] * n
        space -= n * item
        item = lengths.at_most(min(space, item - 1))
    return chosen, space


def complete(lengths: Lengths, space: int, nodes: int) -> list[int]:
    """The best filling of ``space`` found: branch and bound over undominated fillings.

    The incumbent is the best-fit-decreasing filling, made before the search. A branch fixes the largest item;
    items go down in length, so that each filling is met once. A branch ends when
    nothing fits its rest (a maximal filling; others are dominated by one), and is cut
    when its rest, filled with items no longer than its largest, cannot have less waste
    than the incumbent. ``nodes`` bounds the search for better ones, not what is packed.
    """
    best, waste = best_fit(lengths, space)
    left = nodes

    def search(rest: int, largest: int, chosen: list[int]) -> None:
        nonlocal best, waste, left
        item = lengths.at_most(min(rest, largest))
        if not item:
            if rest < waste:
                best, waste = list(chosen), rest
            return
        smallest = (lengths.mask & -lengths.mask).bit_length() - 1
        while item and waste and left > 0:
            left -= 1
            lengths.take(item)
            chosen.append(item)
            search(rest - item, item, chosen)
            chosen.pop()
            lengths.give(item)
            # with only shorter items, as many as there are, the rest must beat the incumbent
            item = lengths.at_most(item - 1)
            if item and (rest // smallest) * item <= rest - waste:
                break

    search(space, space, [])
    return best


def pack_lengths(lengths: np.ndarray, capacity: int, nodes: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item by bin completion, largest item first."""
    stock = Lengths(lengths, capacity)
    waiting: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        waiting.setdefault(int(lengths[i]), []).append(i)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    number = 0
    while stock.mask:
        largest = stock.at_most(capacity)
        stock.take(largest)
        items = [largest, *complete(stock, capacity - largest, nodes)]
        for x in items[1:]:
            stock.take(x)
        offset = 0
        for x in items:
            i = waiting[x].pop()
            bins[i], offsets[i] = number, offset
            offset += x
        number += 1
    return bins, offsets


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, per_group: int = 16_384,
    nodes: int = 400,
) -> DataFrame:
    """Pieces of all documents with ``sequence_id`` and ``offset``.

    A document is its token ids and ``end_id``; null text is empty, so every row gives at
    least one piece. Longer ones than ``capacity`` are cut so that all but the first piece
    are full; full pieces are sequences of their own. The others are dealt by a hash into
    groups of about ``per_group`` pieces, each packed in one task: a group's size does not
    grow with the data, and every group but the last few bins of each is filled as well
    as the whole would be. Repeated rows are packed as often as they occur; extra columns
    are ignored. An empty table gives no rows.
    """
    pieces = keep(token_pieces(docs, tokenizer, capacity, end_id))
    short = pieces.filter(F.col("length") < capacity)
    groups = max(1, -(-short.count() // per_group))
    # a hot key would need equal ids, checksums and lengths; rows are dealt in turn as well
    dealt = short.withColumn(
        "_group", F.pmod(F.xxhash64("doc_id", "ids_crc32", "length", F.monotonically_increasing_id()), F.lit(groups))
    )

    def fill(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=False, kind="stable")
        bins, offsets = pack_lengths(frame["length"].to_numpy(), capacity, nodes)
        return frame.drop(columns="_group").assign(
            sequence_id=bins * (groups + 1) + int(key[0]) + 1, offset=offsets
        )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    packed = dealt.groupBy("_group").applyInPandas(fill, schema)
    full = pieces.filter(F.col("length") == capacity).withColumns({
        "sequence_id": F.monotonically_increasing_id() * (groups + 1),
        "offset": F.lit(0).cast("long"),
    })
    return packed.unionByName(full)
