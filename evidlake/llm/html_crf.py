"""Main text of web pages: a linear-chain conditional random field over leaf blocks."""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidlake.llm.common import hashed_sample


SILENT = frozenset("script style template noscript head title svg canvas iframe object math textarea select".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag ends these open elements of its parent.
ENDS = {
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"},
}
#: Words of class and id values, by what they say of a block.
WORDS = {
    "advert": "ad ads adv advert adverts advertisement banner promo promotion promoted sponsor sponsored outbrain taboola",
    "menu": "nav navbar navigation menu menus breadcrumb breadcrumbs toc pagination pager tabs toolbar topbar",
    "footer": "footer foot bottom copyright legal colophon",
    "header": "header masthead top logo brand site-title",
    "side": "sidebar side aside related recommended widget widgets rail trending popular more teaser",
    "notice": "cookie cookies notice consent gdpr alert popup modal overlay subscribe newsletter paywall signup banner disclaimer",
    "comments": "comment comments reply replies discussion disqus respond reader feedback",
    "form": "form login search searchbox signin register contact-form input",
    "share": "share sharing social follow tags meta byline tools print",
    "content": "content article post entry story body main text page-content article-body post-content prose",
}
KIND_OF = {w: k for k, words in WORDS.items() for w in words.split()}
TAGS = frozenset(
    "article main nav header footer aside form section div ul ol li table figure figcaption button label "
    "blockquote pre h1 h2 h3 h4 h5 h6 p body dl details dialog".split()
)
AWAY = frozenset("nav header footer aside form button dialog".split())
AWAY_KINDS = frozenset("advert menu footer side notice comments form share".split())
NOTICE_TEXT = re.compile(r"(?i)\b(cookies?|subscribe|newsletter|sign up|log ?in|advert|sponsored|all rights reserved|privacy)\b|©")


@dataclass(eq=False)
class Path:
    """An open element and those around it; what a block's path says is carried along.

    Equal paths of a page are one object, so a block deep in a page costs no more than
    another one.
    """

    tag: str
    kinds: frozenset[str]
    parent: Path | None
    names: tuple[str, ...]
    below: bool  # an article or main element, or inside of one
    away: bool  # in a part of the article that is no text of it


@dataclass
class Block:
    text: str
    path: Path | None
    linked: int


def path_to(known: dict, parent: Path | None, tag: str, kinds: frozenset[str]) -> Path:
    key = (id(parent), tag, kinds)
    if key not in known:
        names = parent.names if parent else ()
        own = [f"in {tag}"] * (tag in TAGS) + [f"kind {k}" for k in sorted(kinds)]
        new = [x for x in own if x not in names]
        below = bool(parent and parent.below) or tag in ("article", "main")
        away = bool(parent and parent.away) or (below and (tag in AWAY or bool(kinds & AWAY_KINDS)))
        known[key] = Path(tag, kinds, parent, (*names, *new) if new else names, below, away)
    return known[key]


class LeafBlocks(HTMLParser):
    """The text between two block-level tags, with its ancestors; malformed markup is fine."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.stack: list[Path] = []
        self.open: Counter[str] = Counter()
        self.known: dict = {}
        self.sections_end = True
        self.parts: list[str] = []
        self.linked = self.links = self.silent = 0
        self.quiet: list[str] = []

    def end_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(Block(text, self.stack[-1] if self.stack else None, min(self.linked, len(text))))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            if tag not in ("head", "title"):
                self.end_block()
            self.quiet.append(tag)
            return
        if self.quiet and self.quiet[-1] == "head":  # an unclosed head ends with the body
            if tag in VOID:
                return
            self.quiet.pop()
        if self.quiet:
            return
        if tag in INLINE:
            self.links += tag == "a"
            if tag in ("br", "wbr", "img"):
                self.parts.append(" " if tag == "br" else "")
            return
        self.end_block()
        self.links = 0
        if tag in VOID:
            return
        if tag not in ENDS and self.stack and self.stack[-1].tag == "p":
            self.leave(len(self.stack) - 1)
        while tag in ENDS and self.stack and self.stack[-1].tag in ENDS[tag]:
            self.leave(len(self.stack) - 1)
        self.open[tag] += 1
        self.stack.append(path_to(self.known, self.stack[-1] if self.stack else None, tag, self.kinds(attrs)))

    def kinds(self, attrs) -> frozenset[str]:
        kinds = set()
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                for word in value.lower().replace("_", "-").split():
                    kinds.update(KIND_OF.get(w, "") for w in (word, *word.split("-")))
        return frozenset(kinds - {""})

    def leave(self, depth: int) -> None:
        for path in self.stack[depth:]:
            self.open[path.tag] -= 1
        del self.stack[depth:]

    def parse_marked_section(self, i, report=1):
        """Markup up to its ``>``, a character data section up to ``]]>``; else the rest of the page."""
        if self.sections_end and self.rawdata[i + 3 : i + 9].lower() == "cdata[":
            end = self.rawdata.find("]]>", i)
            if end >= 0:
                return end + 3
            self.sections_end = False  # nor do later ones
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else len(self.rawdata)

    def parse_comment(self, i, report=1):
        """An unclosed comment is the rest of the page."""
        for empty in ("<!-->", "<!--->"):
            if self.rawdata.startswith(empty, i):
                return i + len(empty)
        end = super().parse_comment(i, report)
        return end if end >= 0 else len(self.rawdata)

    def parse_html_declaration(self, i):
        end = super().parse_html_declaration(i)
        return end if end >= 0 else len(self.rawdata)

    def handle_endtag(self, tag):
        if self.quiet:
            if tag in self.quiet:
                del self.quiet[self.quiet.index(tag):]
            return
        if tag in INLINE:
            self.links = max(0, self.links - (tag == "a"))
            return
        self.end_block()
        self.links = 0
        if self.open[tag]:
            at = len(self.stack) - 1
            while self.stack[at].tag != tag:
                at -= 1
            self.leave(at)

    def handle_data(self, data):
        if not self.quiet:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def leaf_blocks(html: str | None) -> list[Block]:
    parser = LeafBlocks()
    parser.feed(html or "")
    parser.close()
    parser.end_block()
    return parser.blocks


def path_features(path: Path | None) -> list[str]:
    return ["bias", "leaf " + (path.tag if path else "none"), *(path.names if path else ())]


def parent_of(path: Path | None) -> Path | None:
    return path.parent if path else None


def block_features(blocks: list[Block]) -> list[list[str]]:
    """Names of the binary features of each block."""
    out = []
    for i, b in enumerate(blocks):
        names = path_features(b.path)
        words = b.text.count(" ") + 1
        names.append(f"words {min(words.bit_length(), 8)}")
        names.append(f"linked {int(4 * b.linked / max(len(b.text), 1))}")
        names.append("stop" if b.text[-1] in ".!?…:\"'»”" else "no stop")
        if NOTICE_TEXT.search(b.text):
            names.append("notice text")
        if i == 0:
            names.append("first")
        if i == len(blocks) - 1:
            names.append("last")
        names.append("same parent" if i and parent_of(blocks[i - 1].path) is parent_of(b.path) else "new parent")
        out.append(names)
    return out


@dataclass
class Model:
    weights: dict[str, float]  # how much a feature speaks for label 1, content
    moves: np.ndarray  # 2 x 2, from the label of a block to that of the next

    def labels(self, blocks: list[Block]) -> list[int]:
        get = self.weights.get
        return viterbi([sum(get(x, 0.0) for x in row) for row in block_features(blocks)], self.moves)


def viterbi(scores: list[float], moves: np.ndarray) -> list[int]:
    """The best labels, given how much each block speaks for label 1; ties go to 1 (content)."""
    if not scores:
        return []
    (m00, m01), (m10, m11) = moves.tolist()
    s0, s1 = 0.0, scores[0]
    back = []
    for u in scores[1:]:
        b0 = 1 if s1 + m10 >= s0 + m00 else 0
        b1 = 1 if s1 + m11 >= s0 + m01 else 0
        s0, s1 = (s1 + m10 if b0 else s0 + m00), (s1 + m11 if b1 else s0 + m01) + u
        back.append((b0, b1))
    label = 1 if s1 >= s0 else 0
    labels = [label]
    for step in reversed(back):
        labels.append(label := step[label])
    return labels[::-1]


def fit(pages: Iterable[tuple[list[Block], list[int]]], steps: int = 120, rate: float = 0.1, penalty: float = 1e-3) -> Model:
    """Maximum likelihood of labelled block sequences by Adam; gradients by forward-backward."""
    data = [(block_features(b), y) for b, y in pages if b]
    names: dict[str, int] = {}
    for rows, _ in data:
        for row in rows:
            for name in row:
                names.setdefault(name, len(names))
    n, longest = len(data), max((len(y) for _, y in data), default=0)
    width = len(names)
    w, moves = np.zeros((width, 2)), np.zeros((2, 2))
    if not n:
        return Model({}, moves)
    flat_page, flat_place, flat_name = [], [], []
    truth = np.zeros((n, longest, 2))
    live = np.zeros((n, longest), bool)
    for p, (rows, y) in enumerate(data):
        for i, row in enumerate(rows):
            flat_page += [p] * len(row)
            flat_place += [i] * len(row)
            flat_name += [names[name] for name in row]
            truth[p, i, y[i]] = 1
            live[p, i] = True
    cell = np.array(flat_page) * longest + np.array(flat_place)
    name = np.array(flat_name)
    gold_moves = np.einsum("pia,pib->ab", truth[:, :-1], truth[:, 1:])
    total = live.sum()
    m, v = np.zeros(2 * width + 4), np.zeros(2 * width + 4)

    def log_sum(x, axis):
        top = x.max(axis=axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))

    for t in range(1, steps + 1):
        unary = np.stack([np.bincount(cell, w[name, k], n * longest) for k in (0, 1)], axis=1).reshape(n, longest, 2)
        forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        forward[:, 0] = unary[:, 0]
        for i in range(1, longest):
            step = log_sum(forward[:, i - 1, :, None] + moves[None], 1) + unary[:, i]
            forward[:, i] = np.where(live[:, i, None], step, forward[:, i - 1])
        for i in range(longest - 2, -1, -1):
            step = log_sum(moves[None] + (unary[:, i + 1] + backward[:, i + 1])[:, None, :], 2)
            backward[:, i] = np.where(live[:, i + 1, None], step, 0.0)
        z = log_sum(forward[:, -1], 1)
        share = np.exp(forward + backward - z[:, None, None]) * live[:, :, None]
        pair = np.exp(
            forward[:, :-1, :, None] + moves[None, None] + (unary[:, 1:] + backward[:, 1:])[:, :, None, :]
            - z[:, None, None, None]
        ) * live[:, 1:, None, None]
        error = (share - truth).reshape(-1, 2)
        gw = np.stack([np.bincount(name, error[cell, k], width) for k in (0, 1)], axis=1) / total + penalty * w
        gm = (pair.sum(axis=(0, 1)) - gold_moves) / total + penalty * moves
        g = np.concatenate([gw.ravel(), gm.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
        w -= move[: 2 * width].reshape(width, 2)
        moves -= move[2 * width :].reshape(2, 2)
    return Model({x: float(w[i, 1] - w[i, 0]) for x, i in names.items()}, moves)


def drawn_page(rng: random.Random) -> str:
    """A labelled page of one of many layouts; blocks of the article carry ``data-main``."""
    def words(a, b):
        return " ".join("".join(rng.choice("aeioulnrstdm") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(a, b)))

    def sentence(a=6, b=60):
        return words(a, b).capitalize() + rng.choice([".", ".", ".", "!", "?", ""])

    def links(k):
        return "".join(f'<li><a href="/x">{words(1, 3)}</a></li>' for _ in range(k))

    def pick(kind):
        return rng.choice(WORDS[kind].split())

    def around(tag, kind, inner):
        name = rng.choice([f' class="{pick(kind)}"', f' id="{pick(kind)}"', ""]) if tag != "div" else f' class="{pick(kind)}"'
        return f"<{tag}{name}>{inner}</{tag}>"

    def junk():
        return rng.choice([
            lambda: around(rng.choice(["nav", "div"]), "menu", f"<ul>{links(rng.randint(2, 8))}</ul>"),
            lambda: around("div", "advert", f"<p>{sentence(3, 20)}</p>" if rng.random() < 0.5 else sentence(3, 20)),
            lambda: around(rng.choice(["aside", "div"]), "side", f"<h3>{words(1, 4)}</h3><ul>{links(3)}</ul>" + f"<p>{sentence()}</p>" * rng.randint(0, 2)),
            lambda: around(rng.choice(["div", "section"]), "notice", f"<p>{sentence(4, 25)}</p><button>{words(1, 2)}</button>"),
            lambda: around("form", "form", f"<label>{words(1, 2)}</label><input><button>{words(1, 2)}</button>"),
            lambda: around("div", "share", links(3)),
        ])()

    def comments():
        return around(rng.choice(["section", "div"]), "comments", f"<h2>{words(1, 3)}</h2>" + "".join(
            rng.choice(["<div><p>%s</p></div>", '<div class="comment"><p>%s</p></div>', "<ol><li><p>%s</p></li></ol>"]) % sentence(3, 40)
            for _ in range(rng.randint(1, 5))))

    main = []
    if rng.random() < 0.8:
        main.append(f"<h1 data-main>{words(2, 12).capitalize()}</h1>")
    for _ in range(rng.randint(1, 10)):
        main.append(rng.choices([
            lambda: f"<p data-main>{sentence(2, 120)}</p>", lambda: f"<p data-main><b>{sentence(2, 80)}<br>",
            lambda: f"<h2 data-main>{words(1, 8)}</h2>", lambda: "<ul>" + "".join(f"<li data-main>{sentence(2, 20)}</li>" for _ in range(3)) + "</ul>",
            lambda: f"<blockquote data-main>{sentence(5, 40)}</blockquote>", junk,
        ], [12, 3, 1.5, 1, 1, 0.7])[0]())
    inner = "".join(main)
    body = rng.choice([
        lambda: f"<article>{inner}</article>", lambda: f"<main><article>{inner}</article></main>",
        lambda: f"<main>{inner}</main>", lambda: f'<div class="{pick("content")}">{inner}</div>',
        lambda: f'<div id="{pick("content")}">{inner}</div>',
        lambda: f"<article>{inner}{comments()}</article>",
    ])()
    head = around("header", "header", f"<p>{words(1, 4)}</p>") if rng.random() < 0.5 else ""
    foot = around("footer", "footer", rng.choice(["&copy; ", ""]) + sentence(2, 30)) if rng.random() < 0.9 else ""
    before = "".join(junk() for _ in range(rng.randint(0, 3)))
    after = "".join(junk() for _ in range(rng.randint(0, 2))) + (comments() if rng.random() < 0.4 else "")
    return f"<html><head><title>{words(2, 6)}</title></head><body>{head}{before}{body}{after}{foot}</body></html>"


def labelled(html: str) -> tuple[list[Block], list[int]]:
    """Blocks of a drawn page with their labels, read from ``data-main``."""
    class Marked(LeafBlocks):
        def kinds(self, attrs):
            return super().kinds(attrs) | ({"*"} if ("data-main", None) in attrs else set())

    parser = Marked()
    parser.feed(html)
    parser.close()
    parser.end_block()
    labels = [int(bool(b.path) and "*" in b.path.kinds) for b in parser.blocks]
    known: dict = {}

    def unmarked(path: Path | None) -> Path | None:
        return path and path_to(known, unmarked(path.parent), path.tag, path.kinds - {"*"})

    blocks = [Block(b.text, unmarked(b.path), b.linked) for b in parser.blocks]
    return blocks, labels


def landmarks(blocks: list[Block]) -> list[int] | None:
    """Labels of a real page whose markup names its article; None if it names none."""
    labels = [int(bool(b.path) and b.path.below and not b.path.away) for b in blocks]
    return labels if any(labels) else None


def train(pages: DataFrame, sample: int = 150, drawn: int = 400, longest: int = 200_000, most_blocks: int = 64) -> Model:
    """Fit on ``drawn`` generated labelled pages and up to ``sample`` pages of the table.

    The table's pages are chosen by a hash and labelled by their landmarks (an article or
    main element); pages without landmarks, over ``longest`` code points or with more than
    ``most_blocks`` blocks are left out of the sample, never out of the extraction.
    """
    rng = random.Random(7)
    data = [labelled(drawn_page(rng)) for _ in range(drawn)]
    rows = hashed_sample(pages.filter(F.length("html") <= longest).select("html"), sample, "html")
    for html in rows["html"]:
        blocks = leaf_blocks(html)
        labels = landmarks(blocks) if len(blocks) <= most_blocks else None
        if labels:
            data.append((blocks, labels))
    return fit(data)


def extract(html: str | None, model: Model) -> list[str]:
    """The content blocks of one page, in page order."""
    blocks = leaf_blocks(html)
    return [b.text for b, label in zip(blocks, model.labels(blocks)) if label]


def main_text(pages: DataFrame, model: Model | None = None, **fit_options) -> DataFrame:
    """Every row of ``pages`` with ``text`` (main text) and ``n_chars`` (its code points).

    Null and empty html give an empty text, as do pages in which nothing is content.
    Repeated rows give equal results; existing columns ``text`` and ``n_chars`` are replaced.
    """
    model = train(pages, **fit_options) if model is None else model
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def run(html: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(extract(None if x is None or x != x else x, shared.value)) for x in html], dtype=object)

    return pages.withColumn("text", run(F.col("html"))).withColumn("n_chars", F.length("text").cast("long"))
