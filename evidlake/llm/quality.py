"""Quality of documents by co-training a text classifier and a metadata classifier."""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidlake.llm import linear
from evidlake.llm.common import column_of, holds_out
from evidlake.llm.toxicity import Ngrams

TEXT_BITS, META_BITS = 16, 10
GRAMS = (2, 4)


def text_features(grams: Ngrams, text: str | None) -> np.ndarray:
    """Hashed character n-grams and coarse shares of kinds of characters and of repetition."""
    text = text or ""
    words = text.split()
    n = max(len(text), 1)
    lines = [x for x in text.split("\n") if x]
    shares = {
        "symbols": sum(text.count(c) for c in "#$%&*@{}[]<>|\\^~=_") / n,
        "digits": sum(text.count(c) for c in "0123456789") / n,
        "distinct words": len(set(words)) / max(len(words), 1),
        "distinct lines": len(set(lines)) / max(len(lines), 1),
        "stops": sum(text.count(c) for c in ".!?") / max(len(words), 1),
        "long words": len(text) / max(len(words), 1) / 20,
    }
    made = [crc32(f"{k} {min(int(v * 20), 40)}".encode()) >> (32 - TEXT_BITS) for k, v in shares.items()]
    made.append(crc32(f"words {len(words).bit_length()}".encode()) >> (32 - TEXT_BITS))
    return np.concatenate([grams(text), np.array(made, np.int32)])


def meta_features(lang, source, n_chars) -> np.ndarray:
    size = "none" if n_chars is None or n_chars != n_chars else str(int(2 * np.log2(max(float(n_chars), 1.0))))
    names = {f"lang {lang}", f"source {source}", f"size {size}", f"lang {lang} size {size}", f"source {source} lang {lang}"}
    return np.array(sorted({crc32(x.encode()) >> (32 - META_BITS) for x in names}), np.int32)


@dataclass
class View:
    weights: np.ndarray
    intercept: float
    slope: float = 1.0
    shift: float = 0.0

    def logit(self, rows: linear.SparseRows) -> np.ndarray:
        return self.slope * (rows.dot(self.weights) + self.intercept) + self.shift


@dataclass
class Model:
    text: View
    meta: View
    #: Share of each view in the combined logit, and its shift.
    text_share: float
    meta_share: float
    shift: float


def _fit_view(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, bits: int) -> View:
    sparse = linear.SparseRows(rows, None, 1 << bits)
    w, b = linear.fit(sparse, y, steps=60, rate=0.03, penalty=1e-4, weight=weight)
    return View(w, b)


def co_train(
    text: list[np.ndarray], meta: list[np.ndarray], y: np.ndarray, rounds: int, share: float, trust: float
) -> Model:
    """``y`` is 1, 0, or NaN for rows without a label.

    Every fourth labelled row is kept for calibration. In each round both views are fitted;
    each then labels the pool's rows of which it is surest (``share`` of the pool for each
    class, of probability ``trust`` or more), and these go to the other view's training set.
    """
    labelled = np.flatnonzero(~np.isnan(y))
    held, learnt = labelled[::4], np.setdiff1d(labelled, labelled[::4])
    pool = np.flatnonzero(np.isnan(y))
    views, given = [None, None], [{}, {}]
    data, bits = [text, meta], [TEXT_BITS, META_BITS]
    for turn in range(rounds + 1):
        for v in (0, 1):
            extra = np.array(sorted(given[v]), np.int64)
            rows = np.concatenate([learnt, extra])
            label = np.concatenate([y[learnt], np.array([given[v][i] for i in extra], float)])
            weight = np.concatenate([np.ones(len(learnt)), np.full(len(extra), 0.3)])
            views[v] = _fit_view([data[v][i] for i in rows], label, weight, bits[v])
        if turn == rounds or not len(pool):
            break
        most = max(1, int(share * len(pool)))
        for v in (0, 1):
            p = linear.sigmoid(views[v].logit(linear.SparseRows([data[v][i] for i in pool], None, 1 << bits[v])))
            order = np.argsort(p, kind="stable")
            for i in order[:most]:
                if p[i] <= 1 - trust:
                    given[1 - v][int(pool[i])] = 0.0
            for i in order[::-1][:most]:
                if p[i] >= trust:
                    given[1 - v][int(pool[i])] = 1.0
    logits = []
    for v in (0, 1):
        sparse = linear.SparseRows([data[v][i] for i in held], None, 1 << bits[v])
        views[v].slope, views[v].shift = linear.calibrate(views[v].logit(sparse), y[held])
        logits.append(views[v].logit(sparse))
    both = linear.SparseRows([np.array([0, 1], np.int32)] * len(held), [np.array(z) for z in zip(*logits)], 2)
    w, b = linear.fit(both, y[held], steps=300, rate=0.05, penalty=1e-3)
    return Model(views[0], views[1], float(max(w[0], 0)), float(max(w[1], 0)), float(b))


def train(
    docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 1000, pool: int = 2000,
    longest: int = 50_000, rounds: int = 3, share: float = 0.05, trust: float = 0.9,
) -> Model | float:
    """Fit on at most ``per_class`` labelled rows of each class and ``pool`` rows without label.

    The sample is bounded and chosen by a hash of the id; labels of held-out rows are never
    read, and these rows are not in the pool either. Without labels of both classes the
    share of label 1 (0.5 where there is no label) is returned instead of a model.
    """
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("_y"))
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    open_labels = known.filter(~holds_out(F.col("doc_id")))
    counts = {r["_y"]: r["n"] for r in open_labels.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return float(bool(counts.get(1))) if counts else 0.5
    picked = None
    for value in (0, 1):
        part = open_labels.filter(F.col("_y") == value).orderBy(*order).limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    short = docs.select(*columns).filter(F.coalesce(F.length("text"), F.lit(0)) <= longest)
    sample = short.join(F.broadcast(picked), "doc_id").orderBy(*order).limit(2 * per_class).toPandas()
    free = (
        short.filter(F.col("doc_id").isNotNull() & ~holds_out(F.col("doc_id")))
        .select("doc_id").join(known, "doc_id", "left_anti").orderBy(*order).limit(pool)
    )
    rest = short.join(F.broadcast(free), "doc_id").orderBy(*order).limit(pool).toPandas()
    frame = pd.concat([sample, rest.assign(_y=np.nan)], ignore_index=True)
    y = frame["_y"].to_numpy(np.float64)
    if not 0 < np.nansum(y) < (~np.isnan(y)).sum() or len(np.unique(y[~np.isnan(y)][::4])) < 2:
        return float(np.nanmean(y)) if (~np.isnan(y)).any() else 0.5
    grams = Ngrams(TEXT_BITS, GRAMS)
    text = [text_features(grams, t) for t in column_of(frame, "text")]
    meta = [meta_features(*m) for m in zip(column_of(frame, "lang"), column_of(frame, "source"), frame["n_chars"])]
    return co_train(text, meta, y, rounds, share, trust)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **fit) -> DataFrame:
    """Every row of ``docs`` with ``held_out``, ``text_score``, ``meta_score``, ``score``, ``predicted``.

    Scores are probabilities of label 1. Null text is empty and null metadata is a value of
    its own; repeated rows get equal scores; existing columns of these names are replaced.
    """
    model = train(docs, labels, **fit)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("text_score double, meta_score double, score double")
    def run(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        m = shared.value
        if isinstance(m, float):
            return pd.DataFrame({c: np.full(len(text), m) for c in ("text_score", "meta_score", "score")})
        frame = pd.DataFrame({"text": text, "lang": lang, "source": source})
        grams = Ngrams(TEXT_BITS, GRAMS)
        words = np.array([m.text.weights[text_features(grams, t)].sum() for t in column_of(frame, "text")])
        about = np.array([
            m.meta.weights[meta_features(*x)].sum()
            for x in zip(column_of(frame, "lang"), column_of(frame, "source"), n_chars)
        ])
        a = m.text.slope * (words + m.text.intercept) + m.text.shift
        b = m.meta.slope * (about + m.meta.intercept) + m.meta.shift
        return pd.DataFrame({
            "text_score": linear.sigmoid(a), "meta_score": linear.sigmoid(b),
            "score": linear.sigmoid(m.text_share * a + m.meta_share * b + m.shift),
        })

    made = ["text_score", "meta_score", "score", "held_out", "predicted", "_q"]
    scored = docs.drop(*made).withColumn("_q", run("text", "lang", "source", F.col("n_chars").cast("double")))
    return scored.withColumns({
        "text_score": F.col("_q.text_score"), "meta_score": F.col("_q.meta_score"), "score": F.col("_q.score"),
        "held_out": holds_out(F.col("doc_id")),
        "predicted": (F.col("_q.score") >= threshold).cast("int"),
    }).drop("_q")
