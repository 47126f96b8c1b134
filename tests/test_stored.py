"""Files of any size in pieces, long strings, cases in one pass, devices on a stream."""

import hashlib
import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidlake.operators import case, image
from evidlake.sources import files, sinks, stored
from evidlake.streaming import devices
from tests.corpus import LINES


def local(path):
    return "/" + path.partition(":")[2].lstrip("/")


def test_hashes_of_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    data = {"a.bin": rng.bytes(100_001), "sub/b b%20c.txt": b"x" * 64, "empty": b"", "sub/deep/ä": b"\0" * 9, ".hidden/_x": b"h", "sub/.dot": b""}
    for name, content in data.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    rows = stored.file_hashes(spark, str(tmp_path), ["md5", "sha1", "sha256", "sha512"]).collect()
    got = {os.path.relpath(local(r.path), tmp_path): r for r in rows}
    assert set(got) == set(data)
    for name, content in data.items():
        r = got[name]
        assert (r.size, r.error) == (len(content), None) and r.mtime is not None
        for a in ("md5", "sha1", "sha256", "sha512"):
            assert r[a] == hashlib.new(a, content).hexdigest()
    assert {os.path.basename(r.path) for r in stored.stored_files(spark, str(tmp_path), recursive=False).collect()} == {"a.bin", "empty"}
    assert stored.stored_files(spark, [f"file:{tmp_path}/a.bin", str(tmp_path / "sub")]).count() == 4
    assert stored.stored_files(spark, str(tmp_path / "*.bin")).count() == 1
    assert stored.stored_files(spark, str(tmp_path / "nowhere")).count() == 0
    few = stored.hash_stored(stored.stored_files(spark, str(tmp_path)), ["md5"], piece=7).collect()
    assert {r.md5 for r in few} == {hashlib.md5(c).hexdigest() for c in data.values()}


def test_a_file_that_cannot_be_read_is_an_error_row(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"abc")
    (tmp_path / "b").write_bytes(b"abc")
    listed = stored.stored_files(spark, str(tmp_path)).collect()
    gone = spark.createDataFrame(listed)
    (tmp_path / "b").unlink()
    got = {os.path.basename(r.path): (r.md5 is None, r.error) for r in stored.hash_stored(gone).collect()}
    assert got == {"a": (False, None), "b": (True, "Failed to hash: No such file or directory")}


def test_files_above_two_gigabytes(spark, tmp_path):
    """Sparse files: they take no room on the disk."""
    if shutil.disk_usage(tmp_path).free < 5 << 30:
        pytest.skip("little disk")
    size = (2 << 30) + 12_345
    with open(tmp_path / "large", "wb") as f:
        f.truncate(size)
        f.seek(size - 5)
        f.write(b"tail!")
    listed = stored.stored_files(spark, str(tmp_path))
    assert listed.first()["size"] == size
    state, left = hashlib.md5(), size - 5
    while left:
        state.update(bytes(min(left, 1 << 24)))
        left -= min(left, 1 << 24)
    state.update(b"tail!")
    assert stored.hash_stored(listed, ["md5"]).first()["md5"] == state.hexdigest()
    chunks = stored.stored_chunks(listed, 10 << 20).select("chunk_no", "offset", F.octet_length("bytes").alias("n"))
    total = chunks.agg(F.count("*"), F.sum("n"), F.max("n"), F.max("offset")).first()
    assert tuple(total) == (-(-size // (10 << 20)), size, 10 << 20, size // (10 << 20) * (10 << 20))


def test_memory_of_a_task_is_a_piece(monkeypatch, tmp_path):
    (tmp_path / "f").write_bytes(b"ab" * 50_000)
    seen = []
    real = stored.open_stored

    class Spy:
        def __init__(self, file):
            self.file = file

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def seek(self, at):
            self.file.seek(at)

        def read(self, n):
            seen.append(n)
            return self.file.read(min(n, 333))  # short reads are put together

    monkeypatch.setattr(stored, "open_stored", lambda path: Spy(real(path)))
    pieces = list(stored._pieces(str(tmp_path / "f"), 10, 70_000, 4096))
    assert max(seen) <= 4096 and b"".join(d for _, d in pieces) == (b"ab" * 50_000)[10:70_000]
    assert [o for o, _ in pieces] == list(range(10, 70_000, 4096))
    assert list(stored._pieces(str(tmp_path / "f"), 99_990, 200_000, 4096)) == [(99_990, b"ab" * 5)]


@pytest.mark.parametrize("size", [0, 1, 64, 65, 1000])
@pytest.mark.parametrize("ranges", [64, 200, 1 << 20])
def test_chunks(spark, tmp_path, size, ranges):
    data = np.random.default_rng(size).bytes(size)
    (tmp_path / "i").write_bytes(data)
    rows = sorted(stored.stored_chunks(stored.stored_files(spark, str(tmp_path)), 64, ranges).collect(), key=lambda r: r.offset)
    assert b"".join(bytes(r.bytes) for r in rows) == data
    assert [(r.chunk_no, r.offset) for r in rows] == [(i, 64 * i) for i in range(-(-size // 64))]


def test_images_keep_or_drop_a_short_tail(spark, tmp_path):
    (tmp_path / "image").write_bytes(bytes(range(256)) * 9)
    assert files.mft_image(spark, str(tmp_path / "image"), "C:").count() == 2
    assert [len(r.bytes) for r in files.page_image(spark, str(tmp_path / "image"), "p", 1000).orderBy("offset").collect()] == [1000, 1000, 304]
    assert files.image_records(spark, str(tmp_path / "image"), 256, "x", max_records=3).count() == 3


def test_other_stores(spark):
    assert stored.streams("/a/b") and stored.streams("file:/a") and stored.streams("hdfs://n/a") and not stored.streams("viewfs://x/a")
    assert stored.resolved(spark, "/a/b") == "/a/b"


# -- long strings --------------------------------------------------------------------------


def test_long_strings_stay_in_pieces(spark):
    url = "http://example.com/very/long"
    for cut in range(20, 70, 7):
        text = "x" * cut + " " + url + " " + "y" * (300 - cut)
        data = b"\0\0" + text.encode() + b"\0\0" + b"short one" + b"\0" * 9 + ("w" * 90).encode("utf-16le") + b"\0\0"
        df = spark.createDataFrame([("i", bytearray(data + b"\0" * (len(data) % 2)))], "image string, content binary")
        rows = image.carve_strings(files.slice_images(df, 64), whole_chars=40)
        got = rows.orderBy("offset").collect()
        ascii_ = [r for r in got if r.encoding == "ascii"]
        assert "".join(r.value for r in ascii_ if r["head"] == 2) == text
        assert all(len(r.value) <= 64 for r in got) and ("short one", "") in {(r.value, r.rest) for r in got}
        place = 2
        for r in (r for r in ascii_ if r["head"] == 2):
            assert r.offset == place and r.rest == text[place - 2 + len(r.value):][: min(image.OVERLAP, 64)][: len(r.rest)]
            place += len(r.value)
        wide = [r for r in got if r.encoding == "utf16"]
        assert "".join(r.value for r in wide) == "w" * 90 and len({r["head"] for r in wide}) == 1
        found = image.artifacts(image.distinct_strings(rows)).collect()
        assert [r["head"] for r in found if r.type == "url"] == [2]  # once, though a border may cut it


def test_a_printable_image_is_no_single_value(spark):
    df = spark.createDataFrame([("i", bytearray(b"a1 " * (1 << 20)))], "image string, content binary")
    rows = image.carve_strings(files.slice_images(df, 1 << 18))
    assert rows.agg(F.count("*"), F.max(F.length("value")), F.sum(F.length("value")), F.countDistinct("head")).first()[:] == (
        12, 1 << 18, 3 << 20, 1,
    )


# -- cases and dashboard -------------------------------------------------------------------


def test_a_case_reads_its_evidence_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def spy(text):
        read.add(1)
        return text

    lines = [line for line in LINES if line]
    rows = [(f"/e/{i}.txt", "lab" if i % 2 else None, len(t), t) for i, t in enumerate(lines)]
    df = spark.createDataFrame(rows, "path string, label string, size long, text string")
    df = df.withColumn("mtime", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("size")))
    notes = spark.createDataFrame([("/e/0.txt", "look", None)], "path string, note string, ts timestamp")
    totals = sinks.write_case(df.withColumn("text", spy.asNondeterministic()("text")), "C1", str(tmp_path), notes=notes)
    assert read.value == len(lines)
    want = case.case_findings(df, "C1", hits_only=False)
    assert totals["total_files_scanned"] == len(lines)
    assert totals["files_with_iocs"] == want.filter("total_iocs > 0").count()
    assert {k: v for k, v in totals.items()} == case.case_totals(want).first().asDict()
    hits = spark.read.json(f"{tmp_path}/findings")
    assert hits.count() == totals["files_with_iocs"] and hits.filter("notes = 'look'").count() == 1
    assert spark.read.json(f"{tmp_path}/case_metadata").first()["total_iocs"] == totals["total_iocs"]
    assert len(spark.read.option("header", True).csv(f"{tmp_path}/summary").columns) == 15
    assert spark.read.parquet(f"{tmp_path}/report/severities").agg(F.sum("matches")).first()[0] == totals["total_iocs"]
    assert spark.read.option("header", True).csv(f"{tmp_path}/indicators").count() > 0
    empty = sinks.write_case(df.limit(0), "C2", str(tmp_path / "empty"))
    assert set(empty.values()) == {0}


def test_dashboard_has_modules_without_rows(spark):
    got = case.dashboard({"A": spark.range(7), "B": spark.range(0)}, {"A": 5, "B": 0})
    assert sorted(tuple(r) for r in got.collect()) == [("A", 7, True, True), ("B", 0, False, False)]


# -- devices -------------------------------------------------------------------------------


def brute(times, gap):
    out = []
    for t in sorted(times):
        if out and t - out[-1][1] <= gap:
            out[-1] = (out[-1][0], t, out[-1][2] + 1)
        else:
            out.append((t, t, 1))
    return out


def test_sightings_in_any_order():
    rng = np.random.default_rng(1)
    for _ in range(200):
        times = rng.integers(0, 300, int(rng.integers(1, 40)))
        known: list = []
        for part in np.array_split(rng.permutation(times), int(rng.integers(1, 5))):
            if len(part):
                known = devices.merge_sightings(known, part, 9)
        assert known == brute(times.tolist(), 9)


def test_devices_over_batches(spark, tmp_path):
    """Batches are files; a timer fires when later events of any kind move the watermark on."""
    schema = "host string, log string, ts timestamp, event_id int, strings array<string>"

    def minute(m):
        return f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"

    batches = [
        [("h", "system", 0, 20001, "stick"), ("h", "system", 20, 20003, "stick"), ("h", "system", 5, 6416, "disk"), (None, "system", 5, 6416, "x")],
        [("h", "system", 12, 6416, "stick"), ("h", "system", 100, 6416, "stick"), ("h", "security", 101, 4624, "no")],
        [("g", "system", 102, 6416, "stick"), ("h", "security", 200, 4624, "no")],
        [("h", "system", 150, 6416, "late"), ("h", "security", 201, 4624, "no")],
    ]
    source = tmp_path / "in"
    source.mkdir()
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for n, rows in enumerate(batches):
        df = spark.createDataFrame([(h, log, minute(m), e, [d]) for h, log, m, e, d in rows], "host string, log string, ts string, event_id int, strings array<string>")
        df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(source / f"b{n}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(source))
        found = devices.device_changes(stream, "10 minutes", "30 minutes")
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(devices.CHANGES).parquet(out).collect()
    seen = sorted((r.host, r.device, r.change, r.first_seen.strftime("%H:%M"), r.last_seen.strftime("%H:%M"), r.events) for r in got)
    assert seen == sorted([
        ("h", "stick", "attached", "00:00", "00:20", 2), ("h", "disk", "attached", "00:05", "00:05", 1),
        ("h", "disk", "gone", "00:05", "00:05", 1),
        ("h", "stick", "gone", "00:00", "00:20", 3),  # 00:12 came later and counts
        ("h", "stick", "attached", "01:40", "01:40", 1), ("h", "stick", "gone", "01:40", "01:40", 1),
        ("g", "stick", "attached", "01:42", "01:42", 1), ("g", "stick", "gone", "01:42", "01:42", 1),
    ])  # the event at 02:30 came behind the watermark of 03:10


@pytest.mark.parametrize("raw,size", [("-1", -1), ("10485760", 10485760), ("10485760b", 10485760), ("256k", 262144), ("10MB", 10485760), ("1g", 1 << 30)])
def test_broadcast_limit_in_any_unit(raw, size):
    from evidlake.operators.joins import broadcast_limit

    class Session:
        class conf:
            @staticmethod
            def get(name, default):
                return raw

    assert broadcast_limit(Session) == size
