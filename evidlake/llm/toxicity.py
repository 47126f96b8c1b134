"""Toxicity: character n-grams scaled by naive Bayes log-count ratios, then a linear model."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidlake.llm import linear
from evidlake.llm.common import column_of, holds_out

BITS = 18
SIZES = (4, 5)


@dataclass
class Model:
    weights: np.ndarray
    intercept: float
    bits: int = BITS
    sizes: tuple[int, ...] = SIZES


class Ngrams:
    """Distinct hashed character n-grams of a whole text."""

    def __init__(self, bits: int = BITS, sizes: tuple[int, ...] = SIZES):
        self.bits, self.sizes = bits, sizes
        self.last = np.zeros(1 << bits, np.int32)

    def __call__(self, text: str | None) -> np.ndarray:
        padded = f" {(text or '').lower()} "
        chars = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), np.uint32)
        found = []
        h, n = chars.copy(), 1
        for size in range(2, max(self.sizes) + 1):
            if len(chars) < size:
                break
            h = h[:-1] * np.uint32(0x01000193) + chars[size - 1 :]
            if size in self.sizes:
                salted = (h ^ np.uint32(size * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
                salted ^= salted >> np.uint32(15)
                found.append((salted * np.uint32(0xC2B2AE35)) >> np.uint32(32 - self.bits))
        if not found:
            return np.zeros(0, np.int32)
        at = np.concatenate(found).view(np.int32)
        order = np.arange(len(at), dtype=np.int32)
        self.last[at] = order  # of a repeated n-gram the last place stays
        return at[self.last[at] == order]


def log_count_ratios(rows: linear.SparseRows, y: np.ndarray, smooth: float, least: int, sure: float) -> np.ndarray:
    """log(share in positives / share in negatives) of each n-gram; 0 for rare and unsure ones.

    The smoothing of each class is in proportion to its rows, so an n-gram that is as
    common in both has ratio 0 whatever the balance of the classes.
    """
    up = rows.add_up(y.astype(float))
    down = rows.add_up(1.0 - y)
    total, ups, downs = max(len(y), 1), max(y.sum(), 1), max((1 - y).sum(), 1)
    ratio = np.log((up + smooth * ups / total) / (ups * (1 + smooth / total)))
    ratio -= np.log((down + smooth * downs / total) / (downs * (1 + smooth / total)))
    # sampling error of the ratio: n-grams that may differ by chance have no say
    error = np.sqrt(1 / (up + smooth * ups / total) + 1 / (down + smooth * downs / total))
    ratio[(up + down < least) | (np.abs(ratio) < sure * error)] = 0.0
    return ratio


def train(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 2000,
    longest: int = 50_000, smooth: float = 1.0, least: int = 3,
    sure: float = 3.0,
) -> Model:
    """Fit on at most ``per_class`` labelled rows of each class that are not held out.

    The sample is bounded (rows and, by ``longest`` code points, their texts) and chosen
    by a hash of the id, so reruns agree. The shift of the intercept brings the sample's
    balance back to that of all labels. Without labels of both classes every text gets
    the share of positive labels (0.0 where there is none).
    """
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .filter(~holds_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("_y"))
    )
    counts = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        share = 1.0 - 1e-6 if counts.get(1) else 1e-6
        return Model(np.zeros(1 << BITS), float(np.log(share / (1 - share))))
    picked = None
    for value in (0, 1):
        part = known.filter(F.col("_y") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    sample = (
        docs.select("doc_id", "text").filter(F.length("text") <= longest)
        .join(F.broadcast(picked), "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * per_class).toPandas()
    )
    grams = Ngrams()
    y = sample["_y"].to_numpy(np.float64)
    rows = linear.SparseRows([grams(t) for t in column_of(sample, "text")], None, 1 << BITS)
    if not 0 < y.sum() < len(y):
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6))
        return Model(np.zeros(1 << BITS), float(np.log(share / (1 - share))))
    ratios = log_count_ratios(rows, y, smooth, least, sure)
    weights, intercept = linear.fit(rows, y, ratios, steps=60)
    drawn = np.log(y.sum() / (1 - y).sum())
    whole = np.log(counts[1] / counts[0])
    return Model(weights, float(intercept + whole - drawn))


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """Add the probability of label 1 to every row; all columns are kept.

    Null and empty texts have no n-grams and get the intercept's probability. Repeated
    rows get equal scores; an existing column of the name ``out`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        m = shared.value
        grams = Ngrams(m.bits, m.sizes)
        z = [m.weights[grams(t)].sum() + m.intercept for t in texts]
        return pd.Series(linear.sigmoid(np.array(z, np.float64)))

    return docs.withColumn(out, probability(F.col("text")))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **fit) -> DataFrame:
    """Documents with ``held_out``, ``score`` and ``predicted`` (1 at or over ``threshold``)."""
    scored = score(docs, train(docs, labels, **fit))
    return scored.withColumns({
        "held_out": holds_out(F.col("doc_id")),
        "predicted": (F.col("score") >= threshold).cast("int"),
    })
