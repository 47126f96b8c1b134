"""Page extraction on unseen layouts; searches against brute force."""

import random

import numpy as np
import pytest

from evidlake.llm import ann, html_crf, topk


@pytest.fixture(scope="module")
def model():
    rng = random.Random(7)
    return html_crf.fit([html_crf.labelled(html_crf.drawn_page(rng)) for _ in range(250)], steps=80)


def test_crf_on_held_out_pages(model):
    rng = random.Random(123)
    right = total = 0
    for _ in range(200):
        blocks, labels = html_crf.labelled(html_crf.drawn_page(rng))
        right += sum(a == b for a, b in zip(model.labels(blocks), labels))
        total += len(labels)
    assert right / total > 0.97


def test_viterbi_finds_the_best_sequence():
    rng = np.random.default_rng(0)
    for _ in range(50):
        scores, moves = rng.normal(size=6), rng.normal(size=(2, 2))
        def value(y):
            return sum(s for s, a in zip(scores, y) if a) + sum(moves[a, b] for a, b in zip(y, y[1:]))
        best = max((tuple(map(int, np.binary_repr(i, 6))) for i in range(64)), key=value)
        assert tuple(html_crf.viterbi(list(scores), moves)) == best


def test_blocks_of_malformed_pages():
    html = "<html><head><title>t</title><style>p{}</style><script>var t='</p>';</script></head><body><p><b>one &amp; two<br>  three<p>four<div>five</body>"
    assert [b.text for b in html_crf.leaf_blocks(html)] == ["one & two three", "four", "five"]
    assert html_crf.leaf_blocks(None) == [] and html_crf.leaf_blocks("<<<>>") is not None


def test_main_text(spark):
    page = (
        '<html><body><nav><ul><li><a href="/">home</a></li></ul></nav><div class="ad">Buy now.</div><article>'
        "<h1>A title of a page</h1><p>First paragraph with quite a few words of running text in it.</p>"
        "<p>Second&nbsp;paragraph, which is also   long enough to look like text.</p></article>"
        "<footer>&copy; someone</footer></body></html>"
    )
    rows = [(1, "u", page, "old"), (2, "u", None, "old"), (3, None, "", "old"), (1, "u", page, "old"), (4, "u", "<p>" * 3000, "old")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_crf.main_text(df).collect()}
    want = (
        "A title of a page\nFirst paragraph with quite a few words of running text in it.\n"
        "Second paragraph, which is also long enough to look like text."
    )
    assert got == {1: (want, len(want)), 2: ("", 0), 3: ("", 0), 4: ("", 0)}
    assert html_crf.main_text(df.limit(0)).count() == 0


def vectors(spark, n=700, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16))
    x[10:40] = x[5]  # ties
    rows = [(int(i), [float(v) for v in r], int(i % 3)) for i, r in enumerate(x)]
    rows += [(n, None, 0), (n + 1, [None] + [0.5] * 15, 0), (n + 2, [float("nan")] * 16, 0), (None, [1.0] * 16, 0)]
    rows += [(n + 3, [], 0), (n + 4, [float("inf")] * 16, 0), (750, [0.0] * 16, 1), (800, [1.0, 2.0], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int"), x


def brute(x, ids, score, k=5):
    out = []
    for q in ids[ids % 50 == 0]:
        s = score(x[ids == q][0], x)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out += [(int(q), r + 1, int(ids[j]), s[j]) for r, j in enumerate(order)]
    return sorted(out)


def test_exact_search(spark, rows):
    df, x = vectors(spark)
    x = np.vstack([x, np.zeros(16)])
    ids = np.append(np.arange(700), 750)
    got = rows(topk.exact_search(df))
    assert got == brute(np.floor(256 * x), ids, lambda q, m: (m @ q).astype(int))
    small = df.filter("vec_id in (0, 1, 2)")
    assert len(rows(topk.exact_search(small))) == 2 and topk.exact_search(df.limit(0)).count() == 0


def test_tiles_and_tree_give_the_same(spark, rows):
    from pyspark.sql import functions as F

    df, _ = vectors(spark)
    good = df.filter("vec_id < 700").select(F.col("vec_id").alias("id"), topk.floor_256(F.col("embedding")).alias("v"))
    asked = good.filter("id % 50 = 0")
    want = rows(topk.top_k(good, asked))
    assert rows(topk.top_k(good, asked, shard=60, block=4)) == want
    lists = topk.top_k(good, asked, k=9).withColumn("shard", F.pmod("vec_id", F.lit(7)).cast("long")).drop("rank")
    assert rows(topk.merge_tree(lists, 5, 7, fan_in=2)) == want


def test_inner_product_of_large_numbers():
    q = np.array([[2.0**40, 3.0]])
    assert topk.inner_product(q, np.array([[2.0**20, 1.0]])).tolist() == [[2**60 + 3]]


def test_nearest_recall_and_scores(spark, rows):
    df, x = vectors(spark, 3000, 1)
    got = rows(ann.approximate_search(df, sample=1500))
    ids = np.arange(3000)
    want = brute(x, ids, lambda q, m: (m @ q) / np.linalg.norm(m, axis=1) / np.linalg.norm(q))
    pairs = {(q, v) for q, _, v, _ in want if q < 3000}
    mine = [g for g in got if g[0] < 3000 and g[0] != 800]
    hits = sum((q, v) in pairs for q, _, v, _ in mine)
    assert hits / len([w for w in want if w[0] != 800]) >= 0.9
    for q, _, v, s in mine[:50]:
        assert s == pytest.approx(x[q] @ x[v] / np.linalg.norm(x[q]) / np.linalg.norm(x[v]), abs=1e-12)
    assert ann.approximate_search(df.limit(0)).count() == 0
    assert {g[2] for g in got if g[0] == 0}.isdisjoint({0, 3000, 3001, 3002})


def test_partitions_are_balanced():
    x = ann.unit_rows(np.random.default_rng(0).normal(size=(800, 8)))
    graph = ann.neighbour_graph(x, 8)
    part = ann.balanced_parts(x, graph, 8)
    assert np.bincount(part).max() <= int(np.ceil(1.05 * 100))
    cut = (part[graph] != part[:, None]).mean()
    assert cut < 0.75
