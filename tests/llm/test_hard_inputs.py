"""Inputs that once ended a task or lost rows."""

import math
import time

import numpy as np
import pytest
from fixtures import documents, texts
from pyspark.sql import functions as F

from evidlake.llm import ann, html_crf, mixing, packing
from evidlake.llm.queries import tokenizer_path


@pytest.mark.parametrize("text", [" " * 1_200_000, "\n" * 1_100_000 + "word", "a" + " \n" * 600_000 + "word <|endoftext|>"])
def test_long_white_space_has_the_ids_of_tokenizers(text):
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids
    assert packing.token_ids(tokenizer_path(), text) == want


def test_long_white_space_is_packed(spark):
    df = documents(spark, [" " * 1_100_000, "a b"])
    got = packing.pack(df, tokenizer_path()).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n > 0 for r in got} == {0: True, 1: True}


def texts_of(html):
    return [b.text for b in html_crf.leaf_blocks(html)]


def test_unknown_sections_and_open_comments_are_markup():
    for section in ("<![foo[bar]]>", "<![ if x]>", "<![%s]>", "<![]]>", "<![endif]-->", "<![if !IE]>", "<![CDATA[a > b]]>", "<!-->"):
        assert texts_of(f"<p>one</p>{section}<p>two</p>") == ["one", "two"], section
    assert texts_of("<p>one</p><!-- <p>two</p>") == ["one"]
    assert texts_of("<p>one</p><![CDATA[ <p>two</p>") == ["one", "two"]
    assert texts_of("<p>one</p><![never closed") == ["one"]


def test_deep_nesting_takes_linear_time():
    def seconds(depth):
        begun = time.perf_counter()
        blocks = html_crf.leaf_blocks("<div class='content'>x" * depth + "</section></div>" * depth)
        names = html_crf.block_features(blocks)
        assert len(blocks) == depth and len(names[-1]) < 12
        return time.perf_counter() - begun

    seconds(100)
    assert seconds(50_000) < 20 * max(seconds(5_000), 0.05)


def test_every_query_finds_k_in_tight_clusters(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16)) * 9
    x = centres[np.arange(400) % 12] + rng.normal(size=(400, 16)) * 0.01
    x[::50] = rng.normal(size=(8, 16)) * 30  # the queries lie apart
    rows = [(int(i), [float(a) for a in v]) for i, v in enumerate(x)] + [(450, [1.0, 2.0]), (451, [2.0, 1.0]), (500, [3.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.approximate_search(df, sample=300).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = 0
    for q in range(0, 400, 50):
        s = unit @ unit[q]
        s[q] = -9
        best = np.sort(s)[-5:]
        mine = [r.score for r in got if r.query_id == q]
        assert len(mine) == 5
        found += sum(m >= best[0] - 1e-9 for m in mine)
    assert found >= 0.9 * 40
    assert sorted(r.vec_id for r in got if r.query_id == 450) == [451, 500]
    few = df.filter("vec_id in (0, 1, 2, 3)")
    assert len(ann.approximate_search(few).collect()) == 3


HELPERS = ["n", "_s", "_key", "_tie", "_bucket", "_cap", "_w", "_bands", "size", "target", "own 0", "kept 0", "copy", "_ahead", "words", "weight"]


def test_mix_with_columns_of_any_name(spark):
    plain = documents(spark)
    clashing = plain.withColumns({name: F.lit(7) for name in HELPERS})
    want = {(r.key, r.taken) for r in mixing.mix(plain).collect()}
    got = mixing.mix(clashing)
    assert {(r.key, r.taken) for r in got.collect()} == want
    mixed = mixing.mixed_rows(clashing)
    assert mixed.columns == clashing.columns
    assert mixed.count() == mixing.mixed_rows(plain).count()
    assert {r["size"] for r in mixed.select("size").collect()} == {7}


def brute_draw(rows):
    """Words taken of each row, drawn by hand from the keys that Spark's hashes give."""
    taken = {}
    for source in {r.source for r in rows}:
        mine = sorted((r for r in rows if r.source == source), key=lambda r: (r.draw, r.doc_id))
        total, target = sum(r.size for r in mine), mine[0].target
        epochs = math.floor(target / total) if total else 0
        before, rest = 0, target - epochs * total
        for r in mine:
            taken[r.key] = (epochs + (before + r.size / 2 <= rest)) * r.size
            before += r.size
    return taken


@pytest.mark.parametrize("per_bucket", [3, 2000])
def test_the_draw_against_brute_force(spark, per_bucket):
    df = documents(spark, texts(3, 120))
    uniform = (F.pmod(F.xxhash64(F.lit(0), "doc_id", "text"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    made = mixing.mix(df, per_bucket=per_bucket)
    rows = made.withColumn("draw", -F.log(uniform) / mixing.quality_weight(F.col("text"))).collect()
    assert {r.key: r.taken for r in rows} == brute_draw(rows)


def test_a_source_of_symbols_has_no_large_bucket(spark):
    docs = spark.range(40_000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("?!%%%&&&&&"), F.chr(F.col("id") % 7 + 33)).alias("text"),
        F.lit("hot").alias("source"),
    )
    assert docs.agg(F.max(mixing.quality_weight(F.col("text")))).first()[0] < 0.2
    assert mixing.bucket_sizes(docs, 400).agg(F.max("count")).first()[0] < 2 * 400


def test_rows_of_one_id_with_two_texts(spark):
    from evidlake.llm import near_dedup

    rng = np.random.default_rng(4)

    def words(n):
        return [f"w{int(x)}" for x in rng.integers(0, 10**6, n)]

    a, b = words(60), words(60)
    rows = [(1, a), (5, a), (5, b), (9, [*b, "z"]), (5, b), (7, words(60))]
    df = spark.createDataFrame([(i, " ".join(t), n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, first int")
    kept = near_dedup.without_near_duplicates(df).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(1, " ".join(a)), (5, " ".join(b)), (7, " ".join(rows[5][1]))])
    again = near_dedup.without_near_duplicates(df.repartition(3)).collect()
    assert sorted(r.first for r in kept) == sorted(r.first for r in again)
    found = sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect())
    assert found == [(1, 1, True), (5, 1, False), (5, 5, True), (5, 5, True), (7, 7, True), (9, 5, False)]


def test_texts_of_one_template_do_not_meet(spark):
    """Similarity 0.45, no link: buckets are mixed, and counts of shingles clear them."""
    from evidlake.llm import near_dedup

    rng = np.random.default_rng(5)
    template = [f"t{i}" for i in range(62)]
    sets = []
    for n in range(300):
        own = [f"o{int(x)}" for x in rng.integers(0, 10**9, 38)]
        sets.append((n, " ".join(template + own)))
    near = sets[0][1].split()
    near[-1] = "other"
    sets.append((900, " ".join(near)))
    from evidlake.llm.shingles import shingle_sets

    arrays = [s.view(np.int64).tolist() for s in shingle_sets([t for _, t in sets])]
    df = spark.createDataFrame(
        [(i, i, s) for (i, _), s in zip(sets, arrays)], "id long, component long, shingles array<long>"
    )
    able = sorted(r.id for r in near_dedup.able_to_link(df, 75).collect())
    assert able == [0, 900]


def test_counts_of_shingles_lose_no_link(spark):
    from evidlake.llm import near_dedup

    rng = np.random.default_rng(6)
    base = [rng.integers(0, 10**6, 40) for _ in range(12)]
    sets = []
    for n in range(250):
        s = base[n % 12].copy()
        change = rng.random(40) < rng.choice([0.02, 0.1, 0.15, 0.3])
        s[change] = rng.integers(0, 10**6, int(change.sum()))
        sets.append(set(s.tolist()))
    component = [int(x) for x in rng.integers(0, 60, 250)]
    df = spark.createDataFrame([(i, c, sorted(s)) for i, (c, s) in enumerate(zip(component, sets))], "id long, component long, shingles array<long>")
    able = {r.id for r in near_dedup.able_to_link(df, 75).collect()}
    linked = {
        i for i in range(250) for j in range(250)
        if component[i] != component[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    }
    assert linked and linked <= able < set(range(250))
