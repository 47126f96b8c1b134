"""Language of a text by a bidirectional gated recurrent network over its bytes.

The network reads windows of consecutive bytes, which cover the whole text, forwards and
backwards, and gives every byte the probabilities of the languages; a document's
probabilities are the mean over all its bytes. It is trained here, in numpy, by
backpropagation through time on windows of a bounded labelled sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidlake.llm.common import blocks, column_of

UNKNOWN = "und"
WINDOW = 128
BATCH = 2048


def cell(h: np.ndarray, x: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step of gated recurrent units: new state, gates, candidate, and its recurrent part.

    Units are rows and windows are columns, so every operation runs over long rows. ``x`` is
    the input's share of the three gates, which lie one below the other: reset, update,
    candidate. A gate is (1 + tanh a) / 2, the logistic function of 2 a.
    """
    size = h.shape[0]
    s = u @ h
    gates, part = s[: 2 * size], s[2 * size :]
    gates += x[: 2 * size]
    np.tanh(gates, out=gates)
    gates += 1.0
    gates *= 0.5
    new = gates[:size] * part
    new += x[2 * size :]
    np.tanh(new, out=new)
    state = h - new
    state *= gates[size:]
    state += new
    return state, gates, new, part


def back_cell(ds, h, gates, new, part, u):
    """Gradients of a step: of the former state, of the input's share, of the recurrent weights."""
    size = h.shape[0]
    reset, update = gates[:size], gates[size:]
    da = ds * (1 - update) * (1 - new * new)
    dx = np.concatenate([2 * da * part * reset * (1 - reset), 2 * ds * (h - new) * update * (1 - update), da])
    dr = dx.copy()
    dr[2 * size :] *= reset
    return ds * update + u.T @ dr, dx, dr @ h.T


def still_open(lengths: np.ndarray) -> list[int]:
    """For each step, how many windows reach it; windows come longest first."""
    return [int(x) for x in np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left")]


@dataclass
class Network:
    """Weights: the bytes' share of the gates, the recurrent ones, and the output layer."""

    names: list[str]
    weights: dict[str, np.ndarray]

    @classmethod
    def start(cls, names: list[str], size: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        weights = {}
        for way in "fb":
            weights[f"x{way}"] = rng.normal(0, 0.3, (3 * size, 256))
            weights[f"x{way}"][size : 2 * size] += 0.5  # remember at first
            weights[f"u{way}"] = rng.normal(0, 1 / np.sqrt(size), (3 * size, size))
            weights[f"o{way}"] = rng.normal(0, 0.3, (len(names), size))
        weights["o"] = np.zeros((len(names), 1))
        return cls(names, {k: v.astype(np.float32) for k, v in weights.items()})

    def label(self, bytes_: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sums of the probabilities of each window's bytes, a row for each language."""
        w, size = self.weights, self.weights["uf"].shape[1]
        reach = still_open(lengths)
        states = []
        h = np.zeros((size, len(lengths)), np.float32)
        for t, m in enumerate(reach):
            h = cell(h[:, :m], w["xf"][:, bytes_[t, :m]], w["uf"])[0]
            states.append(h)
        sums = np.zeros((len(self.names), len(lengths)), np.float32)
        h = h[:, :0]
        for t in range(len(reach) - 1, -1, -1):
            m = reach[t]
            if m > h.shape[1]:  # further windows end here
                h = np.concatenate([h, np.zeros((size, m - h.shape[1]), np.float32)], axis=1)
            h = cell(h, w["xb"][:, bytes_[t, :m]], w["ub"])[0]
            z = w["of"] @ states.pop()
            z += w["ob"] @ h
            z += w["o"]
            z -= z.max(axis=0)
            np.exp(z, out=z)
            z /= z.sum(axis=0)
            sums[:, :m] += z
        return sums

    def gradients(self, bytes_: np.ndarray, lengths: np.ndarray, target: np.ndarray, weight: np.ndarray):
        """Loss and gradients over a batch, every byte labelled with its window's language."""
        w, size = self.weights, self.weights["uf"].shape[1]
        reach = still_open(lengths)
        steps, n = len(reach), len(lengths)
        trail, states = {}, {}
        for way in "fb":
            h, hs = np.zeros((size, n), w["uf"].dtype), np.zeros((steps, size, n), w["uf"].dtype)
            for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
                m = reach[t]
                before = h[:, :m].copy()
                step = cell(before, w[f"x{way}"][:, bytes_[t, :m]], w[f"u{way}"])
                h[:, :m] = hs[t, :, :m] = step[0]
                trail[way, t] = before, *step[1:]
            states[way] = hs
        z = np.einsum("ch,thn->tcn", w["of"], states["f"]) + np.einsum("ch,thn->tcn", w["ob"], states["b"]) + w["o"]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        share = (np.arange(steps)[:, None] < lengths[None, :]) * (weight / lengths)[None, :]
        at = np.arange(n)
        loss = float(-(share * np.log(np.maximum(p[:, target, at], 1e-9))).sum())
        p[:, target, at] -= 1
        p *= share[:, None, :]
        out = {"o": p.sum(axis=(0, 2))[:, None]}
        for way in "fb":
            out[f"o{way}"] = np.einsum("tcn,thn->ch", p, states[way])
            du, dx = np.zeros_like(w[f"u{way}"]), np.zeros_like(w[f"x{way}"])
            dh = np.zeros((size, n), w["uf"].dtype)
            for t in range(steps - 1, -1, -1) if way == "f" else range(steps):
                m = reach[t]
                ds = dh[:, :m] + w[f"o{way}"].T @ p[t, :, :m]
                dh[:, :m], share_x, step_u = back_cell(ds, *trail[way, t], w[f"u{way}"])
                du += step_u
                order = np.argsort(bytes_[t, :m], kind="stable")
                byte = bytes_[t, order]
                firsts = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
                dx[:, byte[firsts]] += np.add.reduceat(share_x[:, order], firsts, axis=1)
            out[f"u{way}"], out[f"x{way}"] = du, dx
        return loss, out


def train(names: list[str], bytes_: np.ndarray, lengths: np.ndarray, target: np.ndarray,
          size: int = 12, epochs: int = 8, batch: int = 96, rate: float = 0.01, seed: int = 0) -> Network:
    """Adam over shuffled batches; languages weigh the same, however many windows they have."""
    net = Network.start(names, size, seed)
    rng = np.random.default_rng(seed)
    counts = np.bincount(target, minlength=len(names))
    weight = (len(target) / (len(names) * np.maximum(counts, 1)))[target].astype(np.float32)
    m = {k: np.zeros_like(v) for k, v in net.weights.items()}
    v = {k: np.zeros_like(x) for k, x in net.weights.items()}
    step, total = 0, epochs * -(-len(target) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(target))
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            rows = rows[np.argsort(-lengths[rows], kind="stable")]
            _, grads = net.gradients(bytes_[:, rows], lengths[rows], target[rows], weight[rows] / len(rows))
            step += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            now = rate * (1 - 0.9 * step / total)
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / max(norm, 1e-9))
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                hat = m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
                net.weights[k] = (net.weights[k] - now * hat).astype(np.float32)
    return net


def windows(texts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes one after another, and each window's start, length and text, longest first."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = -(-sizes // window)
    text = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = np.repeat(np.cumsum(sizes) - sizes, counts) + place * window
    lengths = np.minimum(window, sizes[text] - place * window)
    order = np.argsort(-lengths, kind="stable")
    return raw, starts[order], lengths[order], text[order]


def laid_out(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A row for each step and a column for each window; beyond a window's end, any byte."""
    at = np.arange(int(lengths.max()))[:, None] + starts[None, :]
    return raw[np.minimum(at, len(raw) - 1)]


def text_probabilities(net: Network, texts: list[bytes], batch: int = BATCH) -> np.ndarray:
    """Mean probabilities of all bytes of each text."""
    sums = np.zeros((len(texts), len(net.names)))
    raw, starts, lengths, text = windows(texts)
    for i in range(0, len(starts), batch):
        s, n = starts[i : i + batch], lengths[i : i + batch]
        np.add.at(sums, text[i : i + batch], net.label(laid_out(raw, s, n), n).T)
    return sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-9)


def held_out(doc_id: Column) -> Column:
    """True for documents whose language is never learnt from; without an id, neither is it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def training_windows(docs: DataFrame, sample_rows: int, windows_of_each: int) -> pd.DataFrame:
    """Windows (lang, piece) of at most ``sample_rows`` documents, as many of each language.

    Documents and windows are picked by hash from whole texts; only the windows reach the
    driver.
    """
    usable = docs.filter(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & has_letter(F.col("text"))
    ).select("doc_id", "lang", "text")
    languages = usable.select("lang").distinct().count()
    if not languages:
        return pd.DataFrame({"lang": [], "piece": []})
    ids = usable.select("lang", F.xxhash64("doc_id", "text").alias("key"))
    ids = ids.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("key")))
    edges = ids.filter(F.col("place") <= max(2, sample_rows // languages)).groupBy("lang").agg(F.max("key").alias("edge"))
    # the hashes alone were sorted; a number for each of the network's outputs says how far its sample goes
    ends = F.create_map(*(F.lit(x) for r in edges.collect() for x in (r.lang, r.edge)))
    rows = usable.filter(F.xxhash64("doc_id", "text") <= F.element_at(ends, F.col("lang")))
    count = F.ceil(F.octet_length("text") / F.lit(WINDOW))
    pieces = rows.select(
        "lang", "text", F.explode(F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.lit(windows_of_each)),
            lambda k: F.pmod(F.xxhash64("doc_id", "text", k), count).cast("int"),
        ))).alias("at"),
    )
    piece = F.substring(F.col("text").cast("binary"), F.col("at") * WINDOW + 1, F.lit(WINDOW))
    return pieces.select("lang", piece.alias("piece")).orderBy("lang", "piece").toPandas()


def learn(docs: DataFrame, sample_rows: int = 1000, windows_of_each: int = 4, size: int = 12, epochs: int = 8) -> Network | None:
    """A network trained on a bounded sample; None where no language can be learnt."""
    sample = training_windows(docs, sample_rows, windows_of_each)
    if len(sample) == 0:
        return None
    names = sorted(sample["lang"].unique())
    pieces = [bytes(p) for p in sample["piece"]]
    raw, starts, lengths, row = windows(pieces)
    target = sample["lang"].map({n: i for i, n in enumerate(names)}).to_numpy()[row]
    return train(names, laid_out(raw, starts, lengths), lengths, target, size, epochs)


def languages(docs: DataFrame, network: Network | None = None, block_bytes: int = 8 << 20, **fit) -> DataFrame:
    """The language of every whole text.

    Adds held_out (crc32 of the id as text is a multiple of 5; such rows and rows without id or
    ``lang`` are never learnt from), lang_pred (a learned value of ``lang``; ``und`` for a text
    that is null or has no letter, and where nothing could be learnt) and score, the mean
    probability of that language over the text's bytes (0 for ``und``). Columns of these names
    are replaced, others stay. ``lang``, ``source`` and ``doc_id`` are never inputs of a
    prediction, so equal texts are told alike, up to rounding. Equal probabilities go to the
    first name. ``fit`` bounds the sample: ``sample_rows`` documents in all, at least two of
    each language, with ``windows_of_each`` windows of 128 bytes.
    """
    network = network or learn(docs, **fit)
    told = "struct<lang_pred: string, score: double>"

    @F.pandas_udf(told)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in column_of(batch.to_frame("text"), "text")]
            parts = [
                text_probabilities(network, texts[a:b]) for a, b in blocks([len(t) for t in texts], block_bytes)
            ]
            p = np.concatenate(parts) if parts else np.zeros((0, len(network.names)))
            yield pd.DataFrame({"lang_pred": [network.names[i] for i in p.argmax(1)], "score": p.max(axis=1).round(6)})

    out = docs.withColumn("held_out", held_out(F.col("doc_id")))
    nothing = F.lit(None).cast(told)
    # the call stays outside the condition: only texts with letters reach the network
    found = predict(F.when(has_letter(F.col("text")), F.col("text"))) if network else nothing
    out = out.withColumn("lang_pred", found)
    result = F.col("lang_pred")
    return out.withColumns({
        "score": F.when(has_letter(F.col("text")), F.coalesce(result["score"], F.lit(0.0))).otherwise(F.lit(0.0)),
        "lang_pred": F.when(has_letter(F.col("text")), F.coalesce(result["lang_pred"], F.lit(UNKNOWN))).otherwise(F.lit(UNKNOWN)),
    })
