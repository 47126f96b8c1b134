"""String carving against a plain scan of the whole image."""

import random
import re

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidlake.operators import image
from evidlake.sources.files import slice_images


def brute(data):
    out = {("ascii", m.start(), m.group().decode()) for m in re.finditer(rb"[ -~]{8,}", data)}
    pairs = [(data[i], data[i + 1]) for i in range(0, len(data) - 1, 2)]
    start = None
    for i, (low, high) in enumerate(pairs + [(0, 1)]):
        if high == 0 and 32 <= low <= 126:
            start = i if start is None else start
        elif start is not None:
            if i - start >= 8:
                out.add(("utf16", start * 2, "".join(chr(p[0]) for p in pairs[start:i])))
            start = None
    return out


def sample(seed):
    rng = random.Random(seed)
    parts = []
    for _ in range(60):
        word = "".join(rng.choice("abc XYZ09") for _ in range(rng.randrange(1, 60)))
        parts.append(rng.choice([word.encode(), word.encode("utf-16le"), b"\0" * rng.randrange(1, 5), bytes([200, 7])]))
    data = b"".join(parts)
    return data + b"\0" * (len(data) % 2)


def carve(spark, images, chunk):
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in images.items()], "image string, content binary")
    rows = image.carve_strings(slice_images(df, chunk)).collect()
    return {k: {(r.encoding, r.offset, r.value) for r in rows if r.image == k} for k in images}


def test_pieces_leave_in_small_frames():
    data = b"printable\0" * 400
    batch = pd.DataFrame([("i", k, k * len(data), data) for k in range(60)])
    frames = list(image._carve(iter([batch])))
    assert max(len(f) for f in frames) <= image.HAND_ON
    assert sum(len(f) for f in frames) == 60 * 402  # two edges of UTF-16 pairs, none found, and 400 words


def test_a_batch_is_not_copied_whole():
    data = b"printable\0" * 400
    batch = pa.RecordBatch.from_pydict({"image": ["i"] * 5000, "chunk_no": list(range(5000)), "offset": [k * 4000 for k in range(5000)], "bytes": [data] * 5000})
    frames = list(image._slices(iter([batch])))
    assert sum(len(f) for f in frames) == 5000
    assert max(sum(map(len, f["bytes"])) for f in frames) <= image.SLICE_BYTES
    found = pa.Table.from_batches(image._carve_batches(iter([batch.slice(0, 300)])))
    assert found.num_rows == 300 * 401 and max(b.num_rows for b in found.to_batches()) <= image.HAND_ON


@pytest.mark.parametrize("chunk", [8, 16, 64, 4096])
def test_carving_over_chunk_edges(spark, chunk):
    images = {f"i{s}": sample(s) for s in range(4)}
    images["text"] = b"x" * 700
    images["edges"] = b"\0" + b"a" * 7 + b"\0" + b"b" * 8 + b"\0"
    assert carve(spark, images, chunk) == {k: brute(v) for k, v in images.items()}


def test_string_over_many_segments(spark, monkeypatch):
    monkeypatch.setattr(image, "SEGMENT", 4)
    images = {"a": b"\0\0" + b"q" * 500 + b"\0\0" + b"r" * 90, "b": b"z" * 333 + b"\0"}
    assert carve(spark, images, 8) == {k: brute(v) for k, v in images.items()}


def test_distinct_per_stretch(spark):
    df = spark.createDataFrame([("i", 0, "v"), ("i", 5, "v"), ("i", 12, "v")], "image string, offset long, value string")
    got = sorted((r.offset, r.value) for r in image.distinct_strings(df, span=10).collect())
    assert got == [(0, "v"), (12, "v")]


def test_artifacts(spark):
    strings = [
        "see https://www.google.com/search?q=1", "http://facebook.com/x", "C:\\Users\\bob\\a.txt", "C:\\Windows\\x.dll",
        "HKLM\\Software\\X", "password=hunter22", "4111111111111111", "078-05-1120", "000-12-3456", "my account page",
        "10.1.2.3 host", "a.b@ex.com",
    ]
    df = spark.createDataFrame([("i", i, s) for i, s in enumerate(strings)], "image string, offset long, value string")
    got = {(r.offset, r.type): (r.category, r.is_sensitive) for r in image.artifacts(df).collect()}
    assert got[(0, "url")] == ("search_engine", False) and got[(1, "url")][0] == "social_media"
    assert got[(2, "file_path")][0] == "user_documents" and got[(3, "file_path")][0] == "system"
    assert (4, "registry_key") in got and got[(5, "password")] == ("credentials", True)
    assert got[(6, "credit_card")][1] and (7, "ssn") in got and (8, "ssn") not in got
    assert not any(o == 9 for o, _ in got) and (10, "ip_address") in got and (11, "email") in got
    counts = {r.type: (r.artifacts, r.sensitive) for r in image.artifact_counts(image.artifacts(df)).collect()}
    assert counts["ssn"] == (1, 1) and counts["url"] == (2, 0)


def test_top_artifacts_break_ties_by_first_seen(spark):
    df = spark.createDataFrame(
        [("i", 9, "http://b.com"), ("i", 1, "http://c.com"), ("i", 5, "http://a.com"), ("j", 0, "http://a.com")],
        "image string, offset long, value string",
    )
    top = image.top_artifacts(image.artifacts(df), "url", 2).collect()
    assert [(r.value, r["count"]) for r in top] == [("http://a.com", 2), ("http://c.com", 1)]


def test_new_locations(spark):
    a = spark.createDataFrame([("p",), ("q",)], "path string")
    assert [r.path for r in image.new_locations(a, a.filter(F.col("path") == "p")).collect()] == ["q"]
