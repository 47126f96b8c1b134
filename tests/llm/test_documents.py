"""Operators on documents against brute-force versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import documents, empty, texts

from evidlake.llm import mixing, near_dedup, packing, personal, quality, suffix_dedup, toxicity
from evidlake.llm.components import components
from evidlake.llm.queries import op1_suffix_dedup, tokenizer_path
from evidlake.llm.shingles import shingle_sets


def brute_repeats(values, length):
    data = [(t or "").encode() for t in values]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        out.append((int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("ids", [None, "same", "null"])
def test_repeats(spark, ids):
    values = texts()
    numbers = {None: None, "same": [7] * len(values), "null": [None] * len(values)}[ids]
    done = suffix_dedup.without_repeats(documents(spark, values, numbers), 200, shard_bytes=5000)
    assert "key" in done.columns
    got = [
        tuple(r) for r in done.orderBy(F_len("key"), "key")
        .select("deduplicated.n_removed", "deduplicated.n_spans", "deduplicated.kept_sha256").collect()
    ]
    assert got == brute_repeats(values, 200)
    assert sum(g[0] for g in got) > 0


def F_len(name):
    from pyspark.sql import functions as F

    return F.length(name)


def test_repeats_in_an_empty_table(spark):
    assert suffix_dedup.without_repeats(empty(documents(spark))).count() == 0


def test_a_hash_with_many_texts_goes_to_bounded_shards(spark, monkeypatch):
    rng = np.random.default_rng(5)

    def text(n):
        return bytes(rng.integers(97, 123, n, np.uint8))

    # the line's gram has the least hash of every window around it
    line = min((text(60) for _ in range(20_000)), key=lambda x: suffix_dedup.gram_hashes(np.frombuffer(x, np.uint8), 32).min())
    values = [text(250) + line + text(250) for _ in range(150)]
    for i in range(0, 20, 2):  # repeats across the line, and one text twice
        values[i] = values[i][:250] + line + values[i + 1][310:330 + 20 * i] + text(40)
        values[i + 1] = text(30) + values[i][150:430]
    values += [values[30], line * 8, b"a" * 700]
    values = [v.decode() for v in values]
    plain = suffix_dedup.repeated_in

    def bounded(most):
        def repeated_in(texts, copies, length):
            assert sum(map(len, texts)) <= most
            return plain(texts, copies, length)

        return repeated_in

    want = brute_repeats(values, 200)
    for shard_bytes in (8000, 300):
        monkeypatch.setattr(suffix_dedup, "repeated_in", bounded(4 * shard_bytes + 2200))
        done = suffix_dedup.without_repeats(documents(spark, values), 200, shard_bytes=shard_bytes)
        got = {r.doc_id: tuple(r.deduplicated[k] for k in ("n_removed", "n_spans", "kept_sha256")) for r in done.select("doc_id", "deduplicated").collect()}
        assert [got[i] for i in range(len(values))] == want
    assert sum(w[0] > 0 for w in want) > 20


def test_columns_of_the_repeats_query(spark, tmp_path):
    values = [*texts(n=5), "é"]
    documents(spark, values).write.parquet(f"{tmp_path}/documents.parquet")
    got = op1_suffix_dedup(spark, str(tmp_path))
    assert got.dtypes == [
        ("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")
    ]
    assert {r.doc_id: r.n_bytes for r in got.collect()} == {i: len((t or "").encode()) for i, t in enumerate(values)}


def test_windows_are_covered_once_and_segments_agree(monkeypatch):
    data = [(t or "").encode() for t in texts(3)]
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 300)
    seen = defaultdict(Counter)
    for which, _, start, count, _ in suffix_dedup.text_runs(data, 200):
        for w, s, c in zip(which, start, count):
            seen[int(w)].update(range(int(s), int(s + c)))
    for i, d in enumerate(data):
        assert seen[i] == Counter(range(max(0, len(d) - 199)))


def brute_components(values, percent=75):
    sets = []
    for t in values:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    label = list(range(len(values)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return [(i, len(s), label[i], label[i] == i) for i, s in enumerate(sets)]


@pytest.mark.parametrize("block", [256, 2])
def test_near_duplicates(spark, rows, block):
    values = texts() + texts(5)
    got = rows(near_dedup.near_duplicates(documents(spark, values), block=block))
    assert got == brute_components(values)


def test_near_duplicates_with_null_and_repeated_ids(spark, rows):
    df = documents(spark, ["a b c d e f", "a b c d e f", "x y", "x y", None], [3, 3, None, 1, 2])
    assert rows(near_dedup.near_duplicates(df).fillna(-1)) == [
        (-1, 1, -1, True), (1, 1, 1, True), (2, 0, 2, True), (3, 2, 3, True), (3, 2, 3, True)
    ]
    assert near_dedup.without_near_duplicates(df).count() == 4
    assert near_dedup.near_duplicates(empty(df)).count() == 0


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(60):
        u = rng.integers(0, 2**63, 500, dtype=np.uint64)
        a, b = np.unique(u[:400]), np.unique(u[100:])
        g = near_dedup.super_minhash([a, b], 128)
        errors.append((g[0] == g[1]).mean() - 300 / 500)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06
    assert np.isfinite(near_dedup.super_minhash([np.array([3], np.uint64)], 64)).all()


def test_linked_pairs_connect_all_that_is_linked():
    sets = [s for s in shingle_sets(texts()) if len(s)]
    pairs = near_dedup.linked_pairs(sets, list(range(len(sets))), 75, stripe=64)
    assert len(pairs) < len(sets)
    want = {
        (i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))
        if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))
    }
    assert set(pairs) <= want and pairs


def test_components(spark, rows):
    links = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 140)] + [(5, 5), (20, 0)]
    got = rows(components(spark.createDataFrame(links, "a long, b long")))
    assert got == [(i, 0) for i in range(1, 21)] + [(i, 100) for i in range(101, 140)]


def test_mix(spark):
    values = texts() * 3
    df = documents(spark, values)
    got = mixing.mix(df, per_bucket=7).toPandas()
    again = mixing.mix(df.repartition(3), per_bucket=1000).toPandas()
    assert dict(zip(got.doc_id, got.taken)) == dict(zip(again.doc_id, again.taken))
    count = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in values]
    assert list(got.sort_values("doc_id")["size"]) == count
    for _, part in got.groupby(got.source.fillna("~")):
        assert part["size"].sum() == part.source_size.iloc[0]
        assert abs(part.taken.sum() - part.target.iloc[0]) <= part["size"].max()
        epochs = int(part.target.iloc[0] // part.source_size.iloc[0])
        assert set((part.taken / part["size"].where(part["size"] > 0)).dropna()) <= {epochs, epochs + 1}
    assert (got.taken <= 3 * got["size"]).all()
    assert mixing.mix(empty(df)).count() == 0
    assert mixing.mixed_rows(df).groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 3


def test_targets_by_water_filling(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, "d": 3, "é": 700, None: 50, "z": 0}
    df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n long")
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full: dict = {}
    while True:
        left = sum(sizes.values()) - sum(full.values())
        share = {s: left * weight[s] / sum(weight[x] for x in sizes if x not in full) for s in sizes if s not in full}
        over = {s: 3.0 * sizes[s] for s in share if share[s] > 3.0 * sizes[s]}
        if not over:
            break
        full |= over
    want = full | share
    for r in mixing.source_targets(df).collect():
        assert r.target == pytest.approx(want[r.source])


def test_packing_is_a_round_trip(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    tok = Tokenizer.from_file(path)
    values = [*texts(), "Ça va? 123 I'll <b>go</b>　 \n\n  x"]
    got = packing.pack(documents(spark, values), path, 64, per_group=50).toPandas()
    for i, text in enumerate(values):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        pieces = got[got.doc_id == i].sort_values("piece")
        assert pieces.start.iloc[0] == 0 and pieces.length.sum() == len(ids)
        assert (pieces.length.iloc[1:] == 64).all()
        for p in pieces.itertuples():
            part = np.array(ids[p.start : p.start + p.length], "<u4").tobytes()
            assert zlib.crc32(part) == p.ids_crc32
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 64
    assert packing.pack(empty(documents(spark)), path).count() == 0
    assert packing.pack(documents(spark, ["a", "a"], [None, None]), path).count() == 2


def test_bin_completion_beats_or_equals_best_fit():
    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths = rng.integers(1, 100, 60)
        bins, offsets = packing.pack_lengths(lengths, 100)
        filled = np.bincount(bins, lengths)
        assert filled.max() <= 100
        free: list[int] = []
        for x in sorted(lengths, reverse=True):
            fits = [r for r in free if r >= x]
            if fits:
                free.remove(min(fits))
                free.append(min(fits) - x)
            else:
                free.append(100 - x)
        assert len(filled) <= len(free)


def test_short_pieces_fill_sequences(spark):
    for lengths, capacity in (([1] * 5000, 2048), ([3] * 1500 + [1] * 600, 2048), ([2] * 900 + [1], 1000)):
        lengths = np.array(lengths)
        for nodes in (0, 400):
            bins, offsets = packing.pack_lengths(lengths, capacity, nodes)
            filled = np.bincount(bins, lengths)
            assert filled.max() <= capacity and len(filled) == -(-lengths.sum() // capacity)
            assert len(set(zip(bins, offsets))) == len(lengths)
    got = packing.pack(documents(spark, ["", None] * 2500), tokenizer_path()).toPandas()
    assert len(got) == 5000 and got.sequence_id.nunique() == 3


def test_added_tokens_have_their_ids(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    tok = Tokenizer.from_file(path)
    end = "<|endoftext|>"
    values = [f"a {end} b", end, f"{end}{end}", f"x  {end}  y\n\n{end}", f"<|{end}|>", "<|endoftext|", f"don't{end}'t  ", f" é{end}é 1"]
    got = packing.pack(documents(spark, values), path, 64).toPandas().set_index("doc_id")
    assert 50256 in tok.encode(values[0], add_special_tokens=False).ids
    for i, text in enumerate(values):
        ids = [*tok.encode(text, add_special_tokens=False).ids, 0]
        assert got.length[i] == len(ids) and got.ids_crc32[i] == zlib.crc32(np.array(ids, "<u4").tobytes())


BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def brute_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False,
                "card": 12 <= len(digits) <= 19 and personal.luhn(digits), "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), rank, kind, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


def test_base_spans_against_expressions():
    import random

    rng = random.Random(2)
    for _ in range(20_000):
        text = "".join(rng.choice("0123456789 .-+@a()%é") for _ in range(rng.randrange(50)))
        assert personal.base_spans(text) == brute_spans(text)
    for text in ("a" * 300_000 + "@", "a@" * 100_000, "1" * 300_000, "1 " * 100_000, "+1 " * 50_000, "1.2." * 50_000):
        personal.base_spans(text)
        personal.candidates(text)


def personal_texts():
    import random

    rng = random.Random(4)
    out = []
    for i in range(300):
        card = "".join(rng.choice("0123456789") for _ in range(15))
        card += next(d for d in "0123456789" if personal.luhn(card + d))
        value = [f"joe.{i}@mail{i}.example.com", f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", card,
                 f"10.{i % 256}.3.{i % 200}", f"in {rng.randint(1000, 2100)} about {rng.randint(1, 99)} items"][i % 5]
        out.append(f"some words before {value} and words after")
    return out


def test_personal_data(spark):
    values = [*personal_texts(), None, "", "write to joe [at] example [dot] com today"]
    got = personal.personal_spans(documents(spark, values)).orderBy("doc_id").collect()
    for text, r in zip(values, got):
        base = [(s.kind, s.start, s.end) for s in r.personal.base]
        spans = [(s.kind, s.start, s.end) for s in r.personal.spans]
        assert base == brute_spans(text or "") and set(base) <= set(spans)
        assert r.personal.n_email == sum(k == "email" for k, _, _ in base)
        if text and spans:
            assert text[spans[0][1] : spans[0][2]] not in r.personal.redacted
    assert all(len(r.personal.spans) == 0 for r in got[4:300:5])  # years and small numbers stay
    assert got[300].personal.redacted is None
    assert [s.kind for s in got[-1].personal.spans] == ["contact"]
    assert personal.personal_spans(empty(documents(spark))).count() == 0


def labelled(spark, seed=0, n=400):
    import random

    from fixtures import words

    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        w = words(rng, rng.randint(20, 80)).split()
        for _ in range(6 * bad):
            w[rng.randrange(len(w))] = rng.choice(["grumblefrob", "xyzzyplugh", "quuxify"])
        docs.append(" ".join(w))
        labels.append((i, int(not bad), int(bad)))
    sources = ["good", "bad"]
    df = spark.createDataFrame(
        [(i, t, "en", sources[int(i % 4 == 0)], len(t)) for i, t in enumerate(docs)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    return df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("operator, label", [(toxicity.toxicity, "toxic"), (quality.quality, "quality")])
def test_classifiers_on_held_out_rows(spark, operator, label):
    docs, labels = labelled(spark)
    got = operator(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id)
    assert (got.predicted == got[label]).mean() > 0.9
    assert got.score.between(0, 1).all()


@pytest.mark.parametrize("operator", [toxicity.toxicity, quality.quality])
def test_classifiers_on_odd_rows(spark, operator):
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 1, 1), (2, 1, 1)], none.schema)
    for labels in (none, odd):
        got = operator(docs, labels).toPandas()
        assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert operator(empty(docs), none).count() == 0
