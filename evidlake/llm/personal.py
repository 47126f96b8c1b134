"""Personal data: generators propose spans, boosted trees choose among them."""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidlake.llm import secrets
from evidlake.llm.boosting import Trees, boost
from evidlake.llm.common import hashed_sample
from evidlake.llm.linear import calibrate, sigmoid

#: Base kinds in the order of the digest, then what the trees add.
KINDS = ("email", "ip", "card", "phone", "contact", "number", "secret", "document")
Span = tuple[str, int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Wide on purpose: anything that may be an address written out, or a grouped number.
WRITTEN = re.compile(
    r"(?i)\b[a-z0-9._%+-]{1,64}\s?[\[({<]?\s?(?:@|\bat\b)\s?[\])}>]?\s?"
    r"[a-z0-9-]{1,63}(?:\s?[\[({<]?\s?(?:\.|\bdot\b)\s?[\])}>]?\s?[a-z0-9-]{1,63}){1,4}"
)
HINT = re.compile(r"(?i)@|\bdot\b")
NEAR = 160
CUES = re.compile(
    r"(?i)(?:tel|phone|call|fax|mobile|cell|mail|e-mail|contact|card|visa|account|iban|ssn|ip|address|host|nr|no)\W*$"
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The four base kinds, leftmost and non-overlapping per kind, in digest order.

    Each is found from its rare character (``@``, a digit, ``+``), so the time is linear
    in the text however long its runs of word characters are.
    """
    found: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append(("email", start, end := domain.end()))
        at = text.find("@", max(at + 1, end))
    runs = [m.span() for m in DIGITS.finditer(text)]
    dotted: list[tuple[int, int]] = []
    chain: list[tuple[int, int]] = []

    def end_chain() -> None:
        if 12 <= sum(b - a for a, b in chain) <= 19:
            a, b = chain[0][0], chain[-1][1]
            if luhn("".join(text[x:y] for x, y in chain)):
                found.append(("card", a, b))

    for a, b in runs:
        gap = text[chain[-1][1]:a] if chain and a - chain[-1][1] == 1 else ""
        if chain and gap not in (" ", "-"):
            end_chain()
            chain = []
        chain.append((a, b))
        if dotted and not (a - dotted[-1][1] == 1 and text[a - 1] == "."):
            dotted = []
        dotted.append((a, b))
        if len(dotted) == 4:
            if all(len(part := text[x:y].lstrip("0")) < 4 and int(part or 0) <= 255 for x, y in dotted):
                found.append(("ip", dotted[0][0], b))
            dotted = []
    if chain:
        end_chain()
    at = text.find("+")
    while at >= 0:
        m = PHONE.match(text, at)
        if m and 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            found.append(("phone", *m.span()))
        at = text.find("+", m.end() if m else at + 1)
    return ordered(found)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


class Taken:
    """Places that spans take; each question costs a binary search."""

    def __init__(self, spans: list[Span] = ()):  # in the order of their starts
        self.starts = [a for _, a, _ in spans]
        self.ends: list[int] = []
        for _, _, b in spans:
            self.ends.append(max(b, self.ends[-1]) if self.ends else b)

    def meets(self, span: Span) -> bool:
        k = bisect_left(self.starts, span[2])
        return k > 0 and self.ends[k - 1] > span[1]

    def add(self, span: Span) -> None:
        """Add a span that meets none of these, which do not overlap."""
        k = bisect_left(self.starts, span[1])
        self.starts.insert(k, span[1])
        self.ends.insert(k, span[2])


def candidates(text: str) -> list[Span]:
    """High-recall proposals; they overlap each other and the base spans.

    ``number``: each run of digit groups with up to two separators between them, as a
    whole and from its second group on. ``contact``: addresses in any spelling. ``secret``
    and ``document``: keys, tokens, passwords, account and identity numbers (``secrets``).
    """
    found: list[Span] = []
    group: list[tuple[int, int]] = []

    def end_group() -> None:
        digits = sum(b - a for a, b in group)
        if 7 <= digits <= 24:
            first = group[0][0]
            while first > 0 and text[first - 1] in "+(":
                first -= 1
            found.append(("number", first, group[-1][1]))
            if len(group) > 2:
                found.append(("number", group[1][0], group[-1][1]))

    for m in DIGITS.finditer(text):
        a, b = m.span()
        if group and not (a - group[-1][1] <= 2 and all(c in " ().-/" for c in text[group[-1][1]:a])):
            end_group()
            group = []
        group.append((a, b))
    if group:
        end_group()
    end = 0
    for hint in HINT.finditer(text):
        if hint.start() < end:
            continue
        for m in WRITTEN.finditer(text, max(end, hint.start() - NEAR), min(len(text), hint.end() + NEAR)):
            found.append(("contact", *m.span()))
            end = m.end()
    return found + secrets.proposals(text)


def features(text: str, span: Span) -> list[float]:
    kind, a, b = span
    if kind in ("secret", "document"):
        return secrets.features(text, span)
    body = text[a:b]
    groups = [len(g) for g in DIGITS.findall(body)] or [0]
    digits = "".join(DIGITS.findall(body))
    before, after = text[max(0, a - 24) : a], text[b : b + 1]
    inner = DIGITS.sub("", body)
    return [
        float(kind == "contact"), len(body), len(digits), len(groups), max(groups), min(groups), groups[-1],
        body.count("."), body.count("-"), body.count(" "), body.count("("), float(body[:1] == "+"),
        float("@" in body), sum(c.isalpha() for c in body) / max(len(body), 1),
        float(12 <= len(digits) <= 19 and luhn(digits)),
        float(bool(before) and before[-1].isalnum()), float(bool(after) and after.isalnum()),
        float(bool(CUES.search(before))), float(len(set(inner)) <= 1),
        float(max((int(g) for g in DIGITS.findall(body) if len(g) < 4), default=999) <= 255 and len(groups) == 4),
        len(set(digits)),
    ]


@dataclass
class Judge:
    """Trees with their calibration and the threshold that selects."""

    trees: Trees
    slope: float
    shift: float
    threshold: float

    def probability(self, rows: list[list[float]]) -> np.ndarray:
        return sigmoid(self.slope * self.trees.raw(np.array(rows, np.float64)) + self.shift)


@dataclass
class Model:
    """A judge for each kind of proposal; a kind without one adds nothing."""

    judges: dict[str, Judge] = field(default_factory=dict)


@dataclass
class Examples:
    """Labelled proposals; those of every third document are kept aside."""

    x: list[list[float]] = field(default_factory=list)
    y: list[float] = field(default_factory=list)
    aside: list[bool] = field(default_factory=list)

    def add(self, row: int, text: str, span: Span, truth: bool) -> None:
        self.x.append(features(text, span))
        self.y.append(float(truth))
        self.aside.append(row % 3 == 0)

    def fit(self, precision: float) -> Judge | None:
        held, truth = np.array(self.aside, bool), np.array(self.y)
        rows = np.array(self.x, np.float64)
        if len(truth) < 20 or not 0 < truth[~held].sum() < (~held).sum() or not held.any():
            return None
        trees = boost(rows[~held], truth[~held])
        raw = trees.raw(rows[held])
        slope, shift = calibrate(raw, truth[held])
        chance = sigmoid(slope * raw + shift)
        order = np.argsort(-chance, kind="stable")
        reached = np.cumsum(truth[held][order]) / np.arange(1, len(order) + 1) >= precision
        last_of_value = np.append(chance[order][1:] < chance[order][:-1], True)
        good = np.flatnonzero(reached & last_of_value)
        return Judge(trees, slope, shift, max(float(chance[order][good[-1]]), 0.5)) if len(good) else None


def _rewritten(text: str, span: Span, turn: int) -> tuple[str, Span] | None:
    """The same personal value in a spelling that the base patterns miss."""
    kind, a, b = span
    body = text[a:b]
    if kind == "email":
        local, _, domain = body.partition("@")
        styles = [" at ", " [at] ", "(at)", " (at) "]
        dots = [" dot ", " [dot] ", ".", " (dot) "]
        body = local + styles[turn % 4] + domain.replace(".", dots[turn % 4])
        kind = "contact"
    elif kind == "phone":
        body = body.lstrip("+") if turn % 2 else "00" + body[1:]
        kind = "number"
    elif kind == "card":
        digits = "".join(DIGITS.findall(body))
        body = ("." if turn % 2 else " - ")[:2].join(digits[i : i + 4] for i in range(0, len(digits), 4))
        kind = "number"
    else:
        return None
    return text[max(0, a - 40) : a] + body + text[b : b + 40], (kind, min(a, 40), min(a, 40) + len(body))


def train(docs: DataFrame, sample: int = 2000, longest: int = 50_000, precision: float = 0.98) -> Model:
    """Fit on a sample of at most ``sample`` documents, chosen by a hash of their ids.

    A number or contact is positive if it covers a base span or is such a value respelt; all
    others, and the respelt numbers with one digit changed so that they pass no check,
    are negative. Secrets and documents are labelled by their form where that says enough, and
    made-up ones and look-alikes are put into the texts. Numbers and contacts share a judge,
    secrets and documents have their own. Every third document is kept aside: on it, scores
    are calibrated and a threshold is set to the least one that reaches ``precision``.
    """
    short = docs.filter(F.col("text").rlike("[0-9@]") & (F.length("text") <= longest)).select("doc_id", "text")
    texts = hashed_sample(short, sample, "doc_id", "text")
    grouped, own = Examples(), {"secret": Examples(), "document": Examples()}
    for row, text in enumerate(texts["text"]):
        base = base_spans(text)
        taken = Taken(base)
        for c in candidates(text):
            if c[0] in own:
                if (label := secrets.weak_label(text, c)) is not None:
                    own[c[0]].add(row, text, c, label)
                continue
            meets = taken.meets(c)
            covers = meets and any(c[1] <= s[1] and s[2] <= c[2] for s in base)
            if covers or not meets:
                grouped.add(row, text, c, covers)
        for turn, s in enumerate(base):
            made = _rewritten(text, s, row + turn)
            if made:
                other, span = made
                grouped.add(row, other, span, True)
                if s[0] == "card":
                    last = other[span[2] - 1]
                    wrong = other[: span[2] - 1] + str((int(last) + 3) % 10) + other[span[2] :]
                    grouped.add(row, wrong, span, False)
        for other, span, truth in secrets.made_examples(text, row):
            own[span[0]].add(row, other, span, truth)
    shared = grouped.fit(precision)
    judges = {"contact": shared, "number": shared} | {kind: found.fit(precision) for kind, found in own.items()}
    return Model({kind: judge for kind, judge in judges.items() if judge})


def all_spans(texts: list[str], model: Model) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text; one call of each judge for all of them."""
    base = [base_spans(t) for t in texts]
    offered: dict[str, list[tuple[int, Span]]] = {}
    rows: dict[str, list[list[float]]] = {}
    for i, text in enumerate(texts):
        taken = Taken(base[i])
        for c in candidates(text):
            if c[0] in model.judges and not taken.meets(c):
                offered.setdefault(c[0], []).append((i, c))
                rows.setdefault(c[0], []).append(features(text, c))
    chosen: list[tuple[float, int, Span]] = []
    for kind, spans in offered.items():
        judge = model.judges[kind]
        for chance, (i, c) in zip(judge.probability(rows[kind]), spans):
            if chance >= judge.threshold:
                chosen.append((float(chance), i, c))
    added: dict[int, list[Span]] = {}
    used: dict[int, Taken] = {}
    for _, i, c in sorted(chosen, key=lambda r: (-r[0], r[1], r[2][1], r[2][2], r[2][0])):
        mine = used.setdefault(i, Taken())
        if not mine.meets(c):
            mine.add(c)
            added.setdefault(i, []).append(c)
    return [(b, ordered(b + added.get(i, []))) for i, b in enumerate(base)]


def _mask(text: str, spans: list[Span]) -> str:
    out, end = [], 0
    for kind, a, b in spans:
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def personal_spans(docs: DataFrame, model: Model | None = None, **fit) -> DataFrame:
    """Every row of ``docs`` with the struct ``personal``.

    It holds ``spans`` and ``base`` (arrays of kind, start, end in code points, end
    exclusive), counts of the base kinds, and ``redacted``, the text with each span
    replaced by its kind in brackets. Base spans always stay; the trees add only spans
    that overlap none of them. Null text is empty and its ``redacted`` null; repeated rows
    give equal results; an existing column ``personal`` is replaced.
    """
    model = train(docs, **fit) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = "array<struct<kind string, start long, `end` long>>"
    schema = (
        f"base {span}, spans {span}, redacted string, n_email long, n_ip long, n_card long, n_phone long"
    )

    @F.pandas_udf(schema)
    def find(texts: pd.Series) -> pd.DataFrame:
        values = [None if t is None or t != t else t for t in texts]
        out = []
        for text, (base, spans) in zip(values, all_spans([v or "" for v in values], shared.value)):
            kinds = [k for k, _, _ in base]
            out.append((
                [{"kind": k, "start": a, "end": b} for k, a, b in base],
                [{"kind": k, "start": a, "end": b} for k, a, b in spans],
                None if text is None else _mask(text, spans), *(kinds.count(k) for k in KINDS[:4]),
            ))
        return pd.DataFrame(out, columns=["base", "spans", "redacted", "n_email", "n_ip", "n_card", "n_phone"])

    return docs.withColumn("personal", find(F.col("text")))


def span_digest(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
