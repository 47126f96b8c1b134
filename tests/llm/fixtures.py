"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import random

LETTERS = "etaoinshrdlu"


def words(rng, n):
    return " ".join("".join(rng.choice(LETTERS) for _ in range(rng.randint(2, 8))) for _ in range(n))


def texts(seed=0, n=40):
    rng = random.Random(seed)
    out = [words(rng, rng.randint(1, 120)) for _ in range(n)]
    passage = words(rng, 60)
    out += [out[0], out[0], out[1] + " tail", f"{words(rng, 30)} {passage} {words(rng, 30)}"]
    out += [f"{words(rng, 5)} {passage} {words(rng, 9)}", "a" * 450, "ab" * 300, "", None, " \n\t ", "one two", "One TWO"]
    out += ["é" * 120 + " " + passage, words(rng, 6000), passage]
    base = words(rng, 80).split()
    for i in range(12):  # near copies at many distances
        copy = list(base)
        for _ in range(i // 2):
            copy[rng.randrange(len(copy))] = words(rng, 1)
        out.append(" ".join(copy))
    return out


def documents(spark, values=None, ids=None):
    values = texts() if values is None else values
    ids = list(range(len(values))) if ids is None else ids
    sources = ["b", "a", None, "ä", "c"]
    rows = [(i, t, "en", sources[k % 5], None if t is None else len(t), f"x{k}", 1.5) for k, (i, t) in enumerate(zip(ids, values))]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, key string, score double"
    )


def empty(df):
    return df.limit(0)
