"""How the sources of a language differ in their words, by exact integer arithmetic.

Terms are counted inside tasks by numpy: a block's terms are cut out of its bytes at once and
sorted by length buckets. Terms of up to 8 bytes are one uint64 word, those of up to 16 two;
both are sorted by their 16-bit digits, least first, which numpy does by radix. Longer terms
lie in a bucket for each power of two of their length and are sorted as bytes. Runs of equal
terms give occurrences and documents. Spark sums what the blocks found.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidlake.llm.common import blocks, keep

#: Bytes of a term, `[^\x00-\x40\x5B-\x60\x7B-\x7F]`: ASCII letters and all that is not ASCII.
TERM = np.zeros(256, bool)
TERM[0x41:0x5B] = TERM[0x61:0x7B] = TERM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Keeps the first n bytes of a big-endian word.
FIRST = np.array([0] + [(1 << 64) - (1 << (64 - 8 * n)) for n in range(1, 9)], np.uint64)
BLOCK_BYTES, BLOCK_TEXTS = 4 << 20, 1 << 16
SCALE = 1_000_000_000
COUNTS = "lang string, source string, term string, n long, docs long"


def radix_order(digits: Iterable[np.ndarray]) -> np.ndarray:
    """The order that sorts rows by 16-bit digits, given from the least to the first."""
    order = None
    for digit in digits:
        if digit.size and digit.min() == digit.max():
            continue  # says nothing
        digit = digit if order is None else digit[order]
        step = np.argsort(digit, kind="stable")  # radix sort, as 16-bit integers have it
        order = step if order is None else order[step]
    return order


def word_digits(word: np.ndarray) -> Iterator[np.ndarray]:
    for shift in (0, 16, 32, 48):
        yield ((word >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)


def words_at(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Up to 8 bytes from each start as a big-endian word; ``raw`` has 8 bytes more at its end."""
    view = np.ndarray(len(raw) - 7, ">u8", raw.tobytes(), strides=(1,))
    return view[starts].astype(np.uint64) & FIRST[np.clip(lengths, 0, 8)]


class Terms:
    """Terms as starts and lengths in lower-case bytes, each with a weight and its text's number."""

    def __init__(self, raw: np.ndarray, starts, lengths, weights, texts):
        self.raw, self.starts, self.lengths = raw, starts, lengths
        self.weights, self.texts = weights, texts

    @classmethod
    def of_texts(cls, raw: np.ndarray, offsets: np.ndarray) -> Terms:
        """All terms of the texts that lie in ``raw`` between ``offsets``; none crosses two texts."""
        inside = np.zeros(len(raw) + 2, bool)
        inside[1:-1] = TERM[raw]
        first = inside[1:-1] & ~inside[:-2]
        last = inside[1:-1] & ~inside[2:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(raw))]
        first[edges] |= inside[1:-1][edges]
        last[edges - 1] |= inside[1:-1][edges - 1]
        starts = np.flatnonzero(first)
        lengths = np.flatnonzero(last) + 1 - starts
        texts = np.searchsorted(offsets, starts, side="right") - 1
        return cls(LOWER[raw], starts, lengths, None, texts)

    def bytes_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The terms of some rows one after another, and their offsets."""
        lengths = self.lengths[rows]
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        at = np.arange(offsets[-1]) + np.repeat(self.starts[rows] - offsets[:-1], lengths)
        return self.raw[at], offsets

    def buckets(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of each length bucket in sorted order, equal terms by text; True where a term begins."""
        padded = np.concatenate([self.raw, np.zeros(8, np.uint8)])
        bucket = np.maximum(3, np.ceil(np.log2(np.maximum(self.lengths, 1))).astype(np.int64))
        for b in np.unique(bucket):
            rows = np.flatnonzero(bucket == b)
            starts, lengths = self.starts[rows], self.lengths[rows]
            text = self.texts[rows].astype(np.uint16)
            if b <= 4:
                keys = [words_at(padded, starts, lengths)]
                if b == 4:  # all are longer than 8
                    keys.append(words_at(padded, starts + 8, lengths - 8))
                order = radix_order([text, *(d for k in reversed(keys) for d in word_digits(k))])
                if order is None:
                    order = np.arange(len(rows))
                keys = [k[order] for k in keys]
                new = np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])
            else:
                joined, offsets = self.bytes_of(rows)
                table = np.zeros((len(rows), 1 << int(b)), np.uint8)
                within = np.arange(len(joined)) - np.repeat(offsets[:-1], lengths)
                table[np.repeat(np.arange(len(rows)), lengths), within] = joined
                keys = table.view(f"S{1 << int(b)}").ravel()
                order = radix_order([text])
                order = np.arange(len(rows)) if order is None else order
                order = order[np.argsort(keys[order], kind="stable")]
                keys = keys[order]
                new = np.concatenate([[True], keys[1:] != keys[:-1]])
            yield rows[order], new

    def counted(self, group: np.ndarray) -> Iterator[tuple[Terms, np.ndarray, np.ndarray]]:
        """Runs of equal terms in a group of texts: one term each with its occurrences, group, texts.

        ``group`` numbers the group of each text and does not fall from text to text.
        """
        for rows, new in self.buckets():
            texts = self.texts[rows]
            groups = group[texts]
            run = new.copy()
            run[1:] |= groups[1:] != groups[:-1]
            text = run.copy()
            text[1:] |= texts[1:] != texts[:-1]
            begins = np.flatnonzero(run)
            weights = np.ones(len(rows), np.int64) if self.weights is None else self.weights[rows]
            some = rows[begins]
            yield (
                Terms(self.raw, self.starts[some], self.lengths[some], np.add.reduceat(weights, begins), self.texts[some]),
                groups[begins],
                np.add.reduceat(text.astype(np.int64), begins),
            )

    def merged_text(self) -> Terms:
        """Distinct terms of the pieces of one text, to be counted together with other pieces."""
        found = [t for t, _, _ in self.counted(np.zeros(1, np.int64))]
        parts = [t.bytes_of(np.arange(len(t.starts))) for t in found]
        raw = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint8)
        lengths = np.concatenate([t.lengths for t in found]) if found else np.zeros(0, np.int64)
        weights = np.concatenate([t.weights for t in found]) if found else np.zeros(0, np.int64)
        return Terms(raw, np.cumsum(lengths) - lengths, lengths, weights, np.zeros(len(lengths), np.int64))


def joined(parts: list[Terms]) -> Terms:
    shift = np.cumsum([0] + [len(p.raw) for p in parts])
    return Terms(
        np.concatenate([p.raw for p in parts]),
        np.concatenate([p.starts + s for p, s in zip(parts, shift)]),
        np.concatenate([p.lengths for p in parts]),
        np.concatenate([p.weights for p in parts]),
        np.concatenate([p.texts for p in parts]),
    )


def terms_of_long_text(raw: np.ndarray, most: int) -> Terms:
    """Distinct terms of one text, counted piece by piece; pieces end between terms."""
    parts, start = [], 0
    while start < len(raw):
        end = start + most
        while end < len(raw):  # to the next byte that is in no term
            gap = np.flatnonzero(~TERM[raw[end : end + most]])
            end += int(gap[0]) if len(gap) else most
            if len(gap):
                break
        piece = raw[start : min(end, len(raw))]
        parts.append(Terms.of_texts(piece, np.array([0, len(piece)])).merged_text())
        start = end
    return joined(parts).merged_text()


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow text column without nulls."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data or b"", np.uint8)[: offsets[-1] if len(offsets) else 0], offsets


def count_batch(batch: pa.RecordBatch, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Terms of a batch of (lang, source, text) by language and source, with counts."""
    lang = batch.column(0).dictionary_encode()
    source = batch.column(1).dictionary_encode()
    code = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    raw, offsets = _texts(batch.column(2).take(pa.array(order)))
    code = code[order]
    sizes = np.diff(offsets)
    for a, b in blocks(sizes.tolist(), most):
        for a, b in ((i, min(i + BLOCK_TEXTS, b)) for i in range(a, b, BLOCK_TEXTS)):
            piece = raw[offsets[a] : offsets[b]]
            if b == a + 1 and len(piece) > most:
                terms = terms_of_long_text(piece, most)
            else:
                terms = Terms.of_texts(piece, offsets[a : b + 1] - offsets[a])
            for found, group, docs in terms.counted(code[a:b]):
                data, ends = found.bytes_of(np.arange(len(found.starts)))
                text = pa.LargeStringArray.from_buffers(
                    len(ends) - 1, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        lang.dictionary.take(pa.array(group // len(source.dictionary))).cast(pa.string()),
                        source.dictionary.take(pa.array(group % len(source.dictionary))).cast(pa.string()),
                        text.cast(pa.string()),
                        pa.array(found.weights),
                        pa.array(docs),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield from count_batch(batch)


def term_counts(docs: DataFrame) -> DataFrame:
    """Occurrences and documents of every term, for each language and source; null is ''."""
    texts = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    found = texts.mapInArrow(_count, COUNTS)
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + kept)), exact for any counts."""
    return (F.lit(1) + F.call_function("div", _whole(n + 1) * _whole(F.lit(SCALE)), _whole(total + kept))).cast("long")


def _whole(x: Column) -> Column:
    return x.cast("decimal(19,0)")


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q): both are at most SCALE + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def pair_sums(frame: pd.DataFrame) -> pd.DataFrame:
    """Sums of gaps over the terms of a block that at least one of two sources has.

    Rows without a term carry the share of each source's missing terms.
    """
    lang, a, b = frame[["lang", "tile_a", "tile_b"]].iloc[0]
    marks = frame[frame.term.isna()].sort_values("number")
    numbers, missing = marks.number.to_numpy(), marks.p.to_numpy(np.int64)
    rows = frame[frame.term.notna()]
    column, terms = pd.factorize(rows.term)
    line = np.searchsorted(numbers, rows.number.to_numpy())
    has = np.zeros((len(numbers), len(terms)), bool)
    p = np.repeat(missing[:, None], len(terms), 1)
    has[line, column] = True
    p[line, column] = rows.p.to_numpy(np.int64)
    tile = marks.tile.to_numpy()
    out = []
    for i in range(len(numbers)):
        others = np.flatnonzero(tile == (b if tile[i] == a else a))
        others = others[others != i]
        if len(others) == 0:
            continue
        own = np.flatnonzero(has[i])
        q = p[np.ix_(others, own)]
        value = ((p[i, own] - q) ** 2 // q).sum(axis=1)
        only = has[others] & ~has[i]  # terms the other source alone has
        r, c = np.nonzero(only)
        q = p[others[r], c]
        value += _sums(r, (missing[i] - q) ** 2 // q, len(others))
        seen = len(own) + only.sum(axis=1)
        out.append(pd.DataFrame({"number": numbers[i], "other": numbers[others], "value": value, "seen": seen}))
    found = pd.concat(out) if out else pd.DataFrame({"number": [], "other": [], "value": [], "seen": []}, dtype=np.int64)
    return found.assign(lang=np.full(len(found), lang, object))


def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Whole-number sums of values by place."""
    out = np.zeros(n, np.int64)
    np.add.at(out, at, values)
    return out


def source_divergence(
    docs: DataFrame, min_docs: int = 3, top: int = 200, block_terms: int = 4096, tile: int = 128
) -> DataFrame:
    """How each source of a language differs from its others, and in which terms.

    Terms are runs of letters and non-ASCII characters with A-Z lower-cased. A language keeps
    the V terms in at least ``min_docs`` of its documents; a source gives each the share
    p = 1 + floor(10^9 * (count + 1) / (N + V)), N its kept terms' occurrences, and f(p, q) =
    floor((p - q)^2 / q). Returns lang, source, part, item, value, rank: for part ``pair``
    each other source of the language and the sum of f against its shares over all kept
    terms; for part ``term`` the ``top`` terms of the source with p above the language's
    share and their f. Ranks go by value, then by item. Rows are documents, whatever their
    ids; nulls are ''; other columns have no say. An empty table gives no row.

    Pairs are summed for blocks of ``block_terms`` terms and tiles of ``tile`` sources, so
    no task holds a language; terms that neither source has enter as one product.
    """
    by_group = ["lang", "source"]
    texts = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in by_group))
    of_term = Window.partitionBy("lang", "term")
    counts = term_counts(docs).select(
        *by_group,
        "term",
        "n",
        F.sum("docs").over(of_term).alias("in_docs"),
        F.sum("n").over(of_term).alias("lang_n"),
        (F.col("source") == F.min("source").over(of_term)).alias("is_first"),
    )
    kept = keep(counts.filter(F.col("in_docs") >= min_docs).drop("in_docs"))
    sums = kept.groupBy(*by_group).agg(F.sum("n").alias("total"), F.sum(F.col("is_first").cast("long")).alias("firsts"))
    of_lang = Window.partitionBy("lang")
    groups = keep(
        texts.distinct()
        .join(sums, by_group, "left")
        .fillna(0, ["total", "firsts"])
        .select(
            *by_group,
            "total",
            F.sum("firsts").over(of_lang).alias("v"),
            F.sum("total").over(of_lang).alias("lang_total"),
            (F.row_number().over(of_lang.orderBy("source")) - 1).alias("number"),
            F.count("*").over(of_lang).alias("sources"),
        )
    )
    groups = groups.withColumn("tile", (F.col("number") / F.lit(tile)).cast("int"))
    groups = groups.withColumn("tiles", F.ceil(F.col("sources") / F.lit(tile)).cast("int"))
    shares = keep(
        kept.join(groups, by_group).select(
            *by_group, "number", "tile", "tiles", "term",
            F.pmod(F.xxhash64("term"), F.greatest(F.ceil(F.col("v") / F.lit(block_terms)), F.lit(1))).alias("block"),
            share(F.col("n"), F.col("total"), F.col("v")).alias("p"),
            share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q"),
        )
    )
    terms = shares.filter("p > q").select(
        *by_group, F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value")
    )
    ranked = Window.partitionBy(*by_group, "part").orderBy(F.desc("value"), "item")
    best = terms.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)
    pairs = source_pairs(groups, shares, block_terms)
    return pairs.withColumn("rank", F.row_number().over(ranked)).unionByName(best)


def source_pairs(groups: DataFrame, shares: DataFrame, block_terms: int) -> DataFrame:
    """Every ordered pair of a language's sources with its sum over all kept terms."""
    missing = F.when(F.col("v") > 0, share(F.lit(0), F.col("total"), F.col("v")))
    groups = groups.withColumn("missing", missing)
    # every block and pair of tiles has a row for each source, which carries its missing share
    last = F.greatest(F.ceil(F.col("v") / F.lit(block_terms)), F.lit(1)) - 1
    block = F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long")))
    marks = groups.filter("v > 0").select(
        "lang", "number", "tile", "tiles", block.alias("block"),
        F.lit(None).cast("string").alias("term"), F.col("missing").alias("p"),
    )
    rows = shares.select("lang", "number", "tile", "tiles", "block", "term", "p").unionByName(marks)
    other = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = other.select(
        "lang", "number", "tile", "block", "term", "p",
        F.least("tile", "o").alias("tile_a"), F.greatest("tile", "o").alias("tile_b"),
    )
    sums = dealt.groupBy("lang", "block", "tile_a", "tile_b").applyInPandas(
        pair_sums, "lang string, number long, other long, value long, seen long"
    )
    sums = sums.groupBy("lang", "number", "other").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    one = groups.select("lang", "source", "number", "v", "missing")
    two = groups.select("lang", F.col("source").alias("item"), F.col("number").alias("other"), F.col("missing").alias("q"))
    # the result itself has a row for each pair
    both = one.join(two, "lang").filter(F.col("number") != F.col("other"))
    neither = (F.col("v") - F.coalesce("seen", F.lit(0))) * gap(F.col("missing"), F.col("q"))
    return both.join(sums, ["lang", "number", "other"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item",
        F.when(F.col("v") > 0, F.coalesce("value", F.lit(0)) + neither).otherwise(F.lit(0)).alias("value"),
    )
