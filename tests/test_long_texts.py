"""Texts scanned in pieces: equal to the scan of whole texts, wherever the cuts fall."""

import random
import re

import pytest
from pyspark.sql import functions as F

from evidlake.catalogs import Pattern, extract_catalog, indicator_catalog
from evidlake.operators import long_texts, scan
from evidlake.sources import files, stored
from tests.corpus import LINES


def write(tmp_path, **contents):
    for name, content in contents.items():
        (tmp_path / f"{name}.txt").write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(tmp_path)


def places(spark, folder, catalog, piece_bytes, reach):
    listed = stored.stored_files(spark, folder)
    rows = long_texts.stored_matches(spark, listed, catalog, piece_bytes, reach).collect()
    return sorted((r.path.rsplit("/", 1)[1], r.pattern, r.offset, r.match) for r in rows if r.error is None)


def corpus(seed):
    rng = random.Random(seed)
    lines = LINES * 3
    rng.shuffle(lines)
    return "\n".join(lines)


@pytest.mark.parametrize("piece_bytes,reach", [(512, 128), (1024, 1024), (333, 2000)])
def test_pieces_give_the_whole_scan(spark, tmp_path, piece_bytes, reach):
    dirty = corpus(1).encode()
    dirty = dirty[:700] + b"\x80\xbf\x80\x80\x80\xff\xe0\x80" + dirty[700:] + "�\U0001f600".encode() * 9
    folder = write(tmp_path, a=corpus(0), dirty=dirty, empty="", one="a@b.com")
    catalog = indicator_catalog() + extract_catalog()
    want = places(spark, folder, catalog, 1 << 30, 0)
    assert len(want) > 500
    assert places(spark, folder, catalog, piece_bytes, reach) == want


def test_findings_are_those_of_whole_texts(spark, tmp_path):
    folder = write(tmp_path, a=corpus(0), b=corpus(2))
    found = long_texts.scan_stored(spark, folder, indicator_catalog(), piece_bytes=700, reach=200)
    whole = scan.scan(files.evidence_text(spark, folder), indicator_catalog())
    got = found.groupBy("path", "name").agg(F.sort_array(F.collect_list(F.struct("offset", "match"))).alias("m"))
    got = {(r.path.split(":")[1].lstrip("/"), r.name): [x.match for x in r.m] for r in got.collect()}
    rows = scan.explode_findings(whole).collect()
    want = {(r.path.split(":")[1].lstrip("/"), r.name): r.matches for r in rows}
    assert got == want  # distinct matches in the order in which they are seen first
    scores = {r.path.split("/")[-1]: r.threat_score for r in long_texts.stored_scores(found).collect()}
    assert scores == {r.path.split("/")[-1]: r.threat_score for r in scan.summarize(whole).collect()}


def test_matches_longer_than_pieces_and_scans_that_start_out_of_step(spark, tmp_path):
    texts = {
        "run": "x " + "Q" * 9_000 + " y " + "Z" * 50 + " end",
        "only": "A" * 5_000,
        "pairs": "ab" * 1 + "a" * 4_001 + "b tail " + "aa" * 3,
        "back": "1" + "23" * 2_000,
    }
    rules = {"run": "[A-Z]{40,}", "triple": "aaa", "pair": r"\d\d\d", "gap": r"x[^y]*y", "word": r"\b\w+\b", "end": r"end$"}
    catalog = [Pattern("custom", "custom", n, r) for n, r in rules.items()]
    folder = write(tmp_path, **texts)
    want = sorted(
        (f"{name}.txt", i, m.start(), m.group())
        for name, text in texts.items() for i, rx in enumerate(rules.values()) for m in re.finditer(rx, text, re.I)
    )
    for piece_bytes, reach in ((256, 32), (100, 300)):
        assert places(spark, folder, catalog, piece_bytes, reach) == want


def test_empty_matches_unreadable_files_and_no_patterns(spark, tmp_path):
    folder = write(tmp_path, a="baab", b="")
    catalog = [Pattern("custom", "custom", "star", "a*")]
    got = [r[2:] for r in places(spark, folder, catalog, 1 << 20, 64)]
    assert got == [(m.start(), m.group()) for m in re.finditer("a*", "baab")][: len(got)] and (1, "aa") in got
    assert places(spark, folder, [], 1 << 20, 64) == []
    listed = spark.createDataFrame([(f"file:{tmp_path}/gone.txt", 10)], "path string, size long")
    rows = long_texts.scan_stored(spark, folder, catalog, files=listed).collect()
    assert [(r.name, r.offset, r.occurrences, r.error) for r in rows] == [
        (None, None, 0, "Failed to read: No such file or directory")
    ]


def test_a_large_text_is_read_by_many_tasks(spark, tmp_path):
    line = "plain words and more of them in a line\n"
    body = line * 100_000
    at = [7, 1_000_003, 2_500_000]
    for i, place in enumerate(at):
        body = body[:place] + f" evil{i}@mailinator.com " + body[place:]
    folder = write(tmp_path, big=body)
    catalog = [p for p in extract_catalog() if p.name == "temp_email"]
    windows = stored.stored_files(spark, folder).withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(14).cast("long"))))
    sizes = stored.text_windows(windows.withColumn("reach", F.lit(1000).cast("long")), 1 << 18).select(F.max(F.char_length("text")))
    assert sizes.first()[0] <= (1 << 18) + 2_000
    found = long_texts.scan_stored(spark, folder, catalog, piece_bytes=1 << 18, reach=1000).collect()
    assert {r.match: body.index(r.match) for r in found} == {r.match: r.offset for r in found}
    assert {r.match for r in found} >= {f"evil{i}@mailinator.com" for i in range(3)}
