"""Sets of hashed five-word shingles of whole texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from evidlake.llm.common import GOLDEN, blocks, mix64

BLOCK = 1 << 20
SPACE = re.compile(rb"[\x20\t-\r]")


def _segments(data: bytes, most: int) -> Iterator[bytes]:
    """Pieces of about ``most`` bytes, cut at white space."""
    start = 0
    while len(data) - start > most:
        cut = SPACE.search(data, start + most)
        if not cut:
            break
        yield data[start : cut.start()]
        start = cut.start()
    yield data[start:]


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word; A-Z count as a-z."""
    raw = np.frombuffer(data, np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if len(starts) == 0:
        return np.zeros(0, np.uint64), starts
    lengths = ends - starts
    low = raw + (((raw >= 65) & (raw <= 90)) << 5).astype(np.uint8)
    letters = low[~space].astype(np.uint64) + np.uint64(1)
    firsts = np.cumsum(lengths) - lengths
    place = np.arange(len(letters)) - np.repeat(firsts, lengths)
    powers = np.full(int(lengths.max()), 0x100000001B3, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.add.reduceat(letters * powers[place], firsts)
    return mix64(sums ^ (lengths.astype(np.uint64) * GOLDEN)), starts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, and the number of words of each."""
    if len(texts) == 1 and len(texts[0]) > 4 * BLOCK:
        hashes = np.concatenate([_words(x)[0] for x in _segments(texts[0], 4 * BLOCK)])
        return hashes, np.array([len(hashes)])
    hashes, starts = _words(b"\n".join(texts))
    sizes = np.array([len(t) + 1 for t in texts])
    at = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    return hashes, np.diff(at)


def _fold(words: np.ndarray, n: int) -> np.ndarray:
    size = len(words) - n + 1
    h = np.zeros(size, np.uint64)
    for i in range(n):
        h = (h + words[i : i + size]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return mix64(h + np.uint64(n))


def shingle_sets(texts: list[str | None], n: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of n words.

    A text with fewer words has one shingle, the whole of it; without words, none.
    """
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    for a, b in blocks([len(d) for d in data], BLOCK):
        words, counts = word_hashes(data[a:b])
        folded = _fold(words, n) if len(words) >= n else None
        end = 0
        for count in counts.tolist():
            start, end = end, end + count
            if count == 0:
                yield np.zeros(0, np.uint64)
            elif count < n:
                yield _fold(words[start:end], count)
            else:
                s = np.sort(folded[start : end - n + 1])
                yield s[np.concatenate([[True], s[1:] != s[:-1]])]
