"""Source divergence, filter orders and languages against brute force, gradients and held-out rows."""

import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import empty, texts

from evidlake.llm import divergence, filter_audit, language

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, score double, mask int, part string, term string, n long, v long"


def table(spark, rows):
    """Rows of (doc_id, text, lang, source), with columns whose names the operators use themselves."""
    full = [(i, t, lang, source, 1, f"x{k}", 1.5, 7, "p", "t", 3, 4) for k, (i, t, lang, source) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def some_rows():
    langs, sources = ["en", None, "", "fr"], ["b", "a", None, "ä", "c", ""]
    values = texts() + ["The the THE cat", "Ünder ünder cat", "x" * 9 + " " + "y" * 17 + " " + "z" * 3000 + " " + "z" * 2999, "a\x00b#c"]
    rows = [(k, t, langs[k % 4], sources[(k // 3) % 6]) for k, t in enumerate(values)]
    return rows + rows[5:9] + [(None, rows[0][1], "en", "a"), (None, None, None, None), (-3, rows[1][1], "fr", "q")]


def brute_divergence(rows, min_docs=3, top=200):
    groups, docs, lang_n = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low)
        groups[lang, source].update(found)
        lang_n[lang].update(found)
        docs[lang].update(set(found))
    out = []
    for (lang, source), count in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        p, whole = shares(count), shares(lang_n[lang])
        pairs = []
        for (lang2, other), c in groups.items():
            if lang2 == lang and other != source:
                q = shares(c)
                pairs.append((sum((p[t] - q[t]) ** 2 // q[t] for t in kept), other))
        terms = [((p[t] - whole[t]) ** 2 // whole[t], t) for t in kept if count[t] > 0 and p[t] > whole[t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, top)):
            ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
            out += [(lang, source, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"tile": 2, "block_terms": 7}, {"top": 3, "min_docs": 1}])
def test_divergence(spark, rows, options):
    got = rows(divergence.source_divergence(table(spark, some_rows()), **options))
    want = brute_divergence(some_rows(), options.get("min_docs", 3), options.get("top", 200))
    assert got == want and {r[2] for r in got} == {"pair", "term"}


def test_divergence_without_terms_or_rows(spark, rows):
    assert divergence.source_divergence(empty(table(spark, some_rows()))).count() == 0
    few = [(1, "a b", "en", "x"), (2, None, "en", "y"), (3, "7 8", "fr", "z")]
    assert rows(divergence.source_divergence(table(spark, few))) == brute_divergence(few)


def test_terms_are_counted_by_length_and_long_texts_in_pieces():
    rng = np.random.default_rng(3)
    pool = ["".join(rng.choice(list("abé"), n)) for n in [*range(1, 40), 63, 64, 65, 500] for _ in range(3)]
    values = [" ".join(rng.choice(pool, int(rng.integers(0, 200)))) for _ in range(30)] + ["", "ab" * 4000]
    import pyarrow as pa

    langs = ["en" if k % 3 else "de" for k in range(len(values))]
    batch = pa.RecordBatch.from_arrays([pa.array(langs), pa.array(["s"] * len(values)), pa.array(values)], ["l", "s", "t"])
    for most in (1 << 20, 300):  # at 300 bytes most texts are longer than a block
        n, docs = Counter(), Counter()
        for found in divergence.count_batch(batch, most):
            for r in found.to_pylist():
                n[r["lang"], r["term"]] += r["n"]
                docs[r["lang"], r["term"]] += r["docs"]
        want_n, want_docs = Counter(), Counter()
        for lang, text in zip(langs, values):
            want_n.update((lang, w) for w in text.split())
            want_docs.update({(lang, w) for w in text.split()})
        assert n == want_n and docs == want_docs


def test_shares_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    n, total, v = 9 * 10**17, 4 * 10**18 + 12345, 10**9 + 7
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(v))).first()[0]
    assert got == 1 + 10**9 * (n + 1) // (total + v)


def brute_orders(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, *_ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    parts = defaultdict(list)
    for i, text, lang, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and least[text] < i,
        }
        parts[lang or ""].append((fails, i in good, i in toxic))
    out, shapley = [], Counter()
    for part, docs in parts.items():
        for order in itertools.permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                before = order[: step - 1]
                alive = [d for d in docs if not any(d[0][x] for x in before)]
                hit = [d for d in alive if d[0][letter]]
                shapley[part, letter] += len(hit)
                out.append((
                    part, "".join(order), step, len(alive) - len(hit), len(hit),
                    sum(d[0][letter] and any(d[0][x] for x in before) for d in docs),
                    sum(d[0][letter] and sum(d[0].values()) == 1 for d in docs),
                    sum(d[1] for d in hit), sum(d[2] for d in hit),
                ))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_filter_orders(spark, rows):
    docs = some_rows() + [(100, "ABC DEF", "en", "a"), (101, "50% off " * 60, "fr", "a"), (99, "50% off " * 60, "", "a")]
    labels = [(k, k % 2, k % 3 == 0) for k in range(0, 110)] + [(4, 0, 1), (None, 1, 1), (2, None, None)]
    marks = spark.createDataFrame([(i, q, None if t is None else int(t)) for i, q, t in labels], "doc_id long, quality int, toxic int")
    found = filter_audit.filter_orders(table(spark, docs), marks)
    assert found.columns[:3] == ["part", "filter_order", "step"] and found.columns[-1] == "shapley"
    assert rows(found) == brute_orders(docs, labels)
    assert filter_audit.filter_orders(empty(table(spark, docs)), marks).count() == 0


def test_many_parts_pass_the_row_limit_of_recursive_queries(spark):
    limit = spark.conf.get(filter_audit.ROW_LIMIT)
    spark.conf.set(filter_audit.ROW_LIMIT, "1000")
    try:
        docs = table(spark, [(k, "a b", f"lang{k}", "s") for k in range(8)])
        marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
        assert filter_audit.filter_orders(docs, marks).count() == 8 * 600
        assert spark.conf.get(filter_audit.ROW_LIMIT) == "1000"
    finally:
        spark.conf.set(filter_audit.ROW_LIMIT, limit)


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    net = language.Network.start(["a", "b", "c"], 3, 1)
    net.weights = {k: v.astype(float) for k, v in net.weights.items()}
    lengths = np.array([6, 5, 5, 2, 1])
    bytes_ = rng.integers(97, 101, (6, 5)).astype(np.uint8)
    target, weight = np.array([0, 1, 2, 1, 0]), rng.random(5)
    _, grads = net.gradients(bytes_, lengths, target, weight)
    for name, g in grads.items():
        for at in [tuple(rng.integers(0, n) for n in g.shape) for _ in range(6)] + [np.unravel_index(np.abs(g).argmax(), g.shape)]:
            old, loss = net.weights[name][at], []
            for step in (1e-5, -1e-5):
                net.weights[name][at] = old + step
                loss.append(net.gradients(bytes_, lengths, target, weight)[0])
            net.weights[name][at] = old
            assert abs((loss[0] - loss[1]) / 2e-5 - g[at]) < 1e-6


def plain_gru(net, text):
    """Mean probabilities of one window, unit by unit in doubles."""
    w = {k: v.astype(float) for k, v in net.weights.items()}
    size = w["uf"].shape[1]

    def run(way, data):
        h, out = np.zeros(size), []
        for byte in data:
            x, s = w[f"x{way}"][:, byte], w[f"u{way}"] @ h
            r = 1 / (1 + np.exp(-2 * (x[:size] + s[:size])))
            z = 1 / (1 + np.exp(-2 * (x[size : 2 * size] + s[size : 2 * size])))
            n = np.tanh(x[2 * size :] + r * s[2 * size :])
            h = (1 - z) * n + z * h
            out.append(h)
        return out

    total = np.zeros(len(net.names))
    for start in range(0, len(text), language.WINDOW):
        data = text[start : start + language.WINDOW]
        for f, b in zip(run("f", data), run("b", data[::-1])[::-1]):
            e = np.exp(w["of"] @ f + w["ob"] @ b + w["o"][:, 0])
            total += e / e.sum()
    return total / max(total.sum(), 1e-9)


def test_every_byte_of_whole_texts_is_labelled():
    net = language.Network.start(["a", "b", "c"], 5, 2)
    values = [t.encode() for t in ["", "x", "déjà vu " * 9, "word " * 111, "ab" * 64, "the end " * 400]]
    got = language.text_probabilities(net, values, batch=7)
    assert np.allclose(got, [plain_gru(net, t) for t in values], atol=1e-4)


def crc(i):
    return zlib.crc32(str(i).encode())


def test_languages_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.languages(docs).select("doc_id", "lang", "held_out", "lang_pred", "score", "text").collect()
    assert len(got) == docs.count() and all(r.held_out == (crc(r.doc_id) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_languages_of_odd_rows(spark):
    words = {"xx": "la lo lu le li", "yy": "kra kru krit krok"}
    rng = np.random.default_rng(0)
    docs = []
    for k in range(120):
        lang = "xx" if k % 2 else "yy"
        text = " ".join(rng.choice(words[lang].split(), 30))
        docs.append((k, text, "zz" if crc(k) % 5 == 0 else lang, "s"))  # held-out labels are wrong
    odd = [(500, None, "xx", "s"), (501, "", "xx", "s"), (502, " 12 .,;", "yy", "s"), (503, "la " * 9000, None, "s"),
           (None, "krok kra krit", "ww", "s"), (0, docs[0][1], "yy", "t")]
    got = language.languages(table(spark, docs + odd), sample_rows=90, epochs=30).collect()
    assert len(got) == 126 and got[0].key == "x0"
    told = {(r.doc_id, r.text): r.lang_pred for r in got}
    assert {r.lang_pred for r in got} == {"xx", "yy", "und"}  # nothing of held-out rows or rows without id is learnt
    assert all(told[i, t] == ("xx" if i % 2 else "yy") for i, t, *_ in docs)
    assert [(r.lang_pred, r.score) for r in got if r.doc_id in (500, 501, 502)] == [("und", 0.0)] * 3
    assert told[503, "la " * 9000] == "xx" and told[None, "krok kra krit"] == "yy"
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 0}) == 1
    nothing = language.languages(table(spark, [(1, "abc", None, "s"), (2, None, None, None)])).collect()
    assert [(r.lang_pred, r.score) for r in nothing] == [("und", 0.0)] * 2
    assert language.languages(empty(table(spark, docs))).count() == 0
