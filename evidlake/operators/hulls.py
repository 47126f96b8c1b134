"""Where in a text an expression can match, found in linear time before it is run.

The JVM tries an expression at every character of a text, some 20 nanoseconds each. A
shipped expression has a *hull*: the same expression for Arrow's linear engine (RE2), widened
where the two engines differ, so it matches wherever the expression does. Letters that
fold to i are in it, Unicode classes are those of any mode, and word borders stay only where
they are ASCII ones. The JVM then scans what the hulls leave, with the same matches:

- most expressions match inside a line: the lines that hold a match of the hull, put together;
- some match over line ends by white space alone: the runs of as many lines with text as the
  expression has places for white space, one more, that hold a match of the hull;
- any other expression: the whole text if it holds a match of the hull. A caller's own
  expression has no hull and runs over every text.

``tests/test_hulls.py`` holds scans of what is left against scans of whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from evidlake.catalogs import Pattern
from evidlake.catalogs.gates import NEEDLES, SHAPE_OF, SHAPES
from evidlake.functions.text import WHOLE_WORDS
from evidlake.operators.scan import is_shipped

SPACE = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
WORD = r"0-9A-Za-z_\x{80}-\x{10ffff}"
WIDE = {r"\s": SPACE, r"\d": r"\p{Nd}", r"\w": WORD}
#: Hulls tried as one; lines or texts without a match of any are done with.
GROUP = 8


@dataclass(frozen=True)
class Hull:
    regex: str
    #: Places for white space that may hold a line end; None: a match may run over any lines.
    crossings: int | None


def _hull(regex: str, multiline: bool, ascii_borders: bool) -> Hull | None:
    """The hull of an expression; None when it has a part that is not known to be alike."""
    parts = re.findall(r"\\.|.", regex, re.DOTALL)
    out, crossings, free, inside = [], 0, False, None
    for i, part in enumerate(parts):
        after = parts[i + 1] if i + 1 < len(parts) else ""
        if part[0] == "\\" and part[1].isalnum() and part not in (r"\b", r"\s", r"\d", r"\w", r"\r", r"\n"):
            return None
        if inside is None:
            if part == "[":
                inside = []
            elif part == r"\b":
                out.append(part if ascii_borders else "")
            elif part in WIDE:
                crossings += part == r"\s"
                out.append(f"[{WIDE[part]}]")
            elif part in ("i", "I"):
                out.append("[iıİ]")
            elif part == "(" and after == "?" and parts[i + 2] != ":":
                return None
            else:
                free |= part in ("\n", r"\n", "^") or part == "$" and not multiline or part == ")" and after in ("*", "+", "{") and r"\s" in parts
                out.append("" if part in ("^", "$") else part)
            continue
        if part == "[" or part == r"\b":
            return None
        if part != "]":
            inside.append(part)
            continue
        breaks = {r"\s", r"\n", "\n"} & set(inside)
        if inside[:1] == ["^"]:
            if {r"\d", r"\w"} & set(inside):
                return None
            free |= not breaks
            out.append(f"[{''.join(inside)}]")
        else:
            crossings += bool(breaks)
            free |= bool(breaks) and after in ("*", "+", "{")
            letters = "ıİ" if any(p.isalpha() for p in inside) else ""  # in front, as a class may end with "-"
            out.append(f"[{letters}{''.join(WIDE.get(p, p) for p in inside)}]")
        inside = None
    return Hull("".join(out), None if free else crossings)


@lru_cache(maxsize=4096)
def hull(pattern: Pattern, ascii_classes: bool = False) -> Hull | None:
    """The hull of a shipped expression, None for any other or one that RE2 does not know."""
    if not is_shipped(pattern):
        return None
    found = _hull(pattern.regex, pattern.multiline, ascii_classes and pattern.regex not in WHOLE_WORDS)
    if found is None:
        return None
    # what counts characters from many places has many states, which are made anew for every call
    if pattern.name in SHAPE_OF:
        part = _hull(SHAPES[SHAPE_OF[pattern.name]].removeprefix("(?U)"), True, False)
    elif pattern.name in NEEDLES and re.match(r"(?:\\b)?\[[^\]]*\]\{", pattern.regex):
        part = _hull("|".join(re.escape(n) for n in NEEDLES[pattern.name]), True, False)
    else:
        part = found
    try:
        pc.match_substring_regex(pa.array([""]), _caseless(part.regex))
    except pa.ArrowInvalid:
        return None
    return Hull(part.regex, found.crossings)


def _caseless(regex: str) -> str:
    return f"(?i){regex}"


def _hits(texts: pa.Array, regex: str) -> np.ndarray:
    return np.flatnonzero(pc.match_substring_regex(texts, _caseless(regex)).to_numpy(zero_copy_only=False))


def _grouped(texts: pa.Array, hulls: Sequence[tuple[int, Hull]]) -> Iterator[tuple[int, Hull, np.ndarray]]:
    """Hulls with the numbers of the texts that hold a match of them."""
    regexes = list(dict.fromkeys(h.regex for _, h in hulls))
    for at in range(0, len(regexes), GROUP):
        group = regexes[at:at + GROUP]
        some = _hits(texts, "|".join(f"(?:{r})" for r in group))
        if not len(some):
            continue
        held = texts.take(pa.array(some))
        for regex in group:
            found = some if len(group) == 1 else some[_hits(held, regex)]
            if len(found):
                yield from ((number, h, found) for number, h in hulls if h.regex == regex)


def _pieces(data: pa.Buffer, edges: np.ndarray) -> pa.Array:
    """The bytes between edges that follow each other, as texts."""
    wide = edges[-1] > np.iinfo(np.int32).max
    kind, number = (pa.large_string(), np.int64) if wide else (pa.string(), np.int32)
    return pa.Array.from_buffers(kind, len(edges) - 1, [None, pa.py_buffer(edges.astype(number)), data])


def _runs(data: pa.Buffer, lines: pa.Array, starts: np.ndarray, h: Hull) -> list[tuple[int, int]]:
    """First and last line of the runs of lines that hold every match of a hull, apart from each other."""
    filled = _hits(lines, f"[^{SPACE}]")
    if len(filled) < 2:
        return [(0, len(lines) - 1)]
    size = h.crossings + 1
    held = []
    for first in range(min(size, len(filled))):
        heads = np.arange(first, len(filled), size)
        edges = starts[filled[heads]].copy()
        if first == 0:
            edges[0] = 0
        held.append(heads[_hits(_pieces(data, np.append(edges, starts[-1])), h.regex)])
    runs: list[tuple[int, int]] = []
    for head in np.sort(np.concatenate(held)).tolist():
        low = int(filled[head]) if head else 0
        high = int(filled[head + size - 1]) if head + size < len(filled) else len(lines) - 1
        if runs and low <= runs[-1][1] + 1:
            runs[-1] = runs[-1][0], max(runs[-1][1], high)
        else:
            runs.append((low, high))
    return runs


def left_to_scan(text: str, hulls: Sequence[Hull | None]) -> Iterator[tuple[int, str, list[int], list[int]]]:
    """What the expressions have to scan: number, text, where its parts begin in it, and where in the whole.

    Places are in characters. An expression that cannot match has no row, one that is cut
    into several texts has a row for each.
    """
    for number, h in enumerate(hulls):
        if h is None:
            yield number, text, [0], [0]
    known = [(number, h) for number, h in enumerate(hulls) if h is not None]
    if not known or not text:
        return
    raw = text.encode()
    data, codes = pa.py_buffer(raw), np.frombuffer(raw, np.uint8)
    starts = np.concatenate([[0], np.flatnonzero(codes == 10) + 1, [len(raw)]])
    lines = _pieces(data, starts)
    if len(raw) == len(text):
        places = starts
    else:
        filled = starts[starts < len(raw)]
        counts = np.add.reduceat(codes & 0xC0 != 0x80, filled, dtype=np.int64)
        places = np.concatenate([[0], np.cumsum(counts), [len(text)] * (len(starts) - len(filled) - 1)])

    def part(low: int, high: int) -> str:
        end = int(starts[high + 1])
        return raw[starts[low]:end - (high + 2 < len(starts))].decode()

    for number, _, found in _grouped(lines, [x for x in known if x[1].crossings == 0]):
        parts = [part(i, i) for i in found.tolist()]
        at = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])[:-1]])
        yield number, "\n".join(parts), at.tolist(), places[found].tolist()
    whole = _pieces(data, starts[[0, -1]])
    for number, h, _ in _grouped(whole, [x for x in known if x[1].crossings != 0]):
        if h.crossings is None:
            yield number, text, [0], [0]
            continue
        for low, high in _runs(data, lines, starts, h):
            yield number, part(low, high), [0], [int(places[low])]
