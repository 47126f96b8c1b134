"""File records: decoding, paths, anomalies and recovery."""

import struct
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidlake.catalogs import lookups as L
from evidlake.operators import mft, mft_decode, recovery, registry
from evidlake.schemas import MFT_RECORDS

T0 = datetime(2024, 1, 1, 12, 0, 0)


def record(volume, entry, parent, name, **more):
    row = dict(
        volume=volume, entry_number=entry, sequence_number=1, is_directory=False, is_deleted=False,
        si_created=T0, si_modified=T0, si_accessed=T0, si_mft_modified=T0, fn_created=T0,
        fn_modified=T0, filename=name, parent_reference=parent, parent_sequence=1, logical_size=0,
        physical_size=0, is_resident=False, data_runs=[], ads_streams=[],
    )
    row.update(more)
    return tuple(row.values())


def frame(spark, *records):
    return spark.createDataFrame(list(records), MFT_RECORDS)


def paths(spark, *records):
    found = mft.with_paths(frame(spark, *records)).collect()
    return {(r.volume, r.entry_number): (r.full_path, r.is_orphan) for r in found}


def test_paths(spark):
    got = paths(
        spark,
        record("C:", 5, 5, "."), record("C:", 10, 5, "Users"), record("C:", 11, 10, "bob"),
        record("C:", 12, 11, "a.txt"), record("C:", 50, 999, "lost"), record("C:", 51, 50, "under_lost"),
        record("C:", 60, 61, "x"), record("C:", 61, 60, "y"), record("C:", 62, 61, "z"),
        record("C:", 70, 999, ""),
        record("D:", 5, 5, "."), record("D:", 11, 5, "other"), record("D:", 12, 11, "b.txt"),
    )
    assert got[("C:", 5)] == ("C:\\", False)
    assert got[("C:", 12)] == ("C:\\Users\\bob\\a.txt", False)
    assert got[("D:", 12)] == ("D:\\other\\b.txt", False)
    assert got[("C:", 50)] == ("C:\\[ORPHANED]\\lost", True)
    assert got[("C:", 51)] == ("C:\\[ORPHANED]\\under_lost", True)
    assert got[("C:", 62)] == ("C:\\[ORPHANED]\\z", True)
    assert got[("C:", 70)] == (None, False)


def test_repeated_records_do_not_multiply(spark):
    once = [record("C:", 5, 5, ".")] + [record("C:", 10 + i, 5 if i == 0 else 9 + i, f"d{i}") for i in range(20)]
    twice = mft.with_paths(frame(spark, *once, *once, record("C:", 10, 5, "e0"))).collect()
    assert len(twice) == 2 * len(once) + 1
    assert {r.full_path for r in twice if r.entry_number == 12} == {"C:\\d0\\d1\\d2"}


def test_deep_chain_and_wide_directory(spark):
    chain = [record("C:", 5, 5, ".")] + [record("C:", 10 + i, 5 if i == 0 else 9 + i, f"d{i}") for i in range(150)]
    wide = [record("C:", 1000 + i, 159, f"f{i}") for i in range(300)]
    got = paths(spark, *chain, *wide)
    assert got[("C:", 159)][0] == "C:\\" + "\\".join(f"d{i}" for i in range(150))
    assert got[("C:", 1299)][0].endswith("\\d149\\f299")


def test_salted_paths_are_the_same(spark):
    records = [record("C:", 5, 5, ".")] + [record("C:", 10 + i, 5 if i < 5 else 10 + i // 3, f"n{i}") for i in range(200)]
    plain = paths(spark, *records)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert paths(spark, *records) == plain
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_no_root_means_orphans(spark):
    assert paths(spark, record("C:", 50, 5, "a"))[("C:", 50)] == ("C:\\[ORPHANED]\\a", True)


@pytest.mark.parametrize("gap,flag", [(0.0, False), (1.0, False), (1.001, True), (None, False)])
def test_timestomp(spark, gap, flag):
    fn = None if gap is None else T0 - timedelta(seconds=gap)
    df = frame(spark, record("C:", 6, 5, "a", fn_created=fn, fn_modified=None))
    assert df.select(mft.is_timestomped()).first()[0] is flag


@pytest.mark.parametrize(
    "age,bucket",
    [(timedelta(0), "today"), (timedelta(days=1), "week"), (timedelta(days=7), "week"), (timedelta(days=8), "month"),
     (timedelta(days=30), "month"), (timedelta(days=90), "quarter"), (timedelta(days=180), "half"),
     (timedelta(days=181), "old"), (None, "old")],
)
def test_age_bucket(spark, age, bucket):
    df = frame(spark, record("C:", 6, 5, "a", si_modified=None if age is None else T0 - age))
    as_of = F.lit("2024-01-01 12:00:00").cast("timestamp")
    assert df.select(mft.age_bucket(as_of, F.col("si_modified"))).first()[0] == bucket


def test_flags_and_anomalies(spark):
    big = 11 * 1024 * 1024
    df = mft.with_paths(
        frame(
            spark, record("C:", 5, 5, "."), record("C:", 9, 5, "Temp"),
            record("C:", 10, 9, "a", logical_size=big, ads_streams=["s"], fn_created=None, is_deleted=True,
                   si_modified=T0 - timedelta(seconds=59)),
            record("C:", 11, 9, "b", logical_size=big - 1024 * 1024),
        )
    )
    as_of = F.lit("2024-01-01 12:00:00").cast("timestamp")
    flags = {r.entry_number: r.f for r in df.select("entry_number", mft.anomaly_flags(as_of).alias("f")).collect()}
    assert flags[10] == ["TIMESTOMPED", "HIDDEN_ADS", "SUSPICIOUS_PATH", "RECENTLY_DELETED"]
    assert flags[11] == []
    kinds = sorted(r.kind for r in mft.anomalies(df).collect() if r.entry_number == 10)
    assert kinds == ["hidden_ads", "suspicious_paths", "timestomped"]
    stats = mft.statistics(df).first()
    assert (stats.total_entries, stats.deleted_entries, stats.ads_detected) == (4, 1, 1)
    report = mft.filter_deleted(mft.deleted_report(df, as_of), age="today", status="METADATA_ONLY")
    assert [r.filename for r in report.collect()] == ["a"]


# -- decoding ------------------------------------------------------------------------


def ticks(moment):
    return int((moment - datetime(1601, 1, 1)).total_seconds()) * 10_000_000


def attribute(kind, content, name=""):
    raw_name = name.encode("utf-16le")
    at = (24 + len(raw_name) + 7) // 8 * 8
    total = (at + len(content) + 7) // 8 * 8
    head = struct.pack("<IIBBHHHIHH", kind, total, 0, len(name), 24, 0, 0, len(content), at, 0)
    return (head + raw_name).ljust(at, b"\0") + content.ljust(total - at, b"\0")


def non_resident(runs, allocated):
    head = struct.pack("<IIBBHHHQQHH4xQQQ", 0x80, 64 + 24, 1, 0, 0, 0, 0, 0, 0, 64, 0, allocated, 0, 0)
    return head + runs.ljust(24, b"\0")


def file_name(name, space, parent=5, size=77):
    t = ticks(T0)
    return (
        struct.pack("<Q4Q2QII", parent | (3 << 48), t, t, t, t, 0, size, 0, 0)
        + bytes([len(name), space]) + name.encode("utf-16le")
    )


def raw_record(*attributes, flags=1, signature=b"FILE", fixup=True):
    body = struct.pack("<4sHHQHHHHIIQHH", signature, 48, 3, 0, 9, 1, 56, flags, 0, 1024, 0, 0, 0)
    body = body.ljust(56, b"\0") + b"".join(attributes) + b"\xff\xff\xff\xff"
    data = bytearray(body.ljust(1024, b"\0"))
    if fixup:
        data[48:50] = b"\x07\x07"
        for i, end in ((1, 512), (2, 1024)):
            data[48 + 2 * i:50 + 2 * i] = data[end - 2:end]
            data[end - 2:end] = b"\x07\x07"
    return bytes(data)


STANDARD = attribute(0x10, struct.pack("<4Q", *[ticks(T0)] * 4) + b"\0" * 16)


def decode(spark, *raws):
    df = spark.createDataFrame([("C:", i, bytearray(r)) for i, r in enumerate(raws)], "volume string, entry_number long, record binary")
    return {r.entry_number: r for r in mft_decode.decode_mft(df).collect()}


def test_decode(spark):
    long_resident = b"y" * 600
    runs = b"\x21\x10\x00\x01" + b"\x11\x05\xf0" + b"\x01\x08" + b"\x00"
    got = decode(
        spark,
        raw_record(STANDARD, attribute(0x30, file_name("LONGNA~1.TXT", 2)), attribute(0x30, file_name("long name.txt", 1)),
                   attribute(0x80, b"hello"), attribute(0x80, b"hidden stream", "ads")),
        raw_record(STANDARD, attribute(0x30, file_name("run.bin", 3)), non_resident(runs, 8192), flags=0),
        raw_record(STANDARD, attribute(0x30, file_name("dir", 3)), flags=3, signature=b"BAAD"),
        b"JUNK" + b"\0" * 1020,
        raw_record(STANDARD, attribute(0x30, file_name("fix.txt", 3)), attribute(0x80, long_resident)),
        raw_record(STANDARD, struct.pack("<II", 0x30, 0) + b"\0" * 40),
    )
    a = got[0]
    assert (a.filename, a.parent_reference, a.parent_sequence, a.logical_size) == ("long name.txt", 5, 3, 77)
    assert (a.is_resident, a.physical_size, bytes(a.resident_data), a.ads_streams) == (True, 5, b"hello", ["ads"])
    assert a.si_modified == T0 and a.fn_created == T0 and a.is_deleted is False
    b = got[1]
    assert b.is_deleted and not b.is_resident and b.physical_size == 8192
    assert [(r.start, r.n) for r in b.data_runs] == [(256, 16), (240, 5), (240, 8)]
    assert got[2].is_directory and 3 not in got
    # The update sequence hides two bytes of this content; they must come back.
    assert bytes(got[4].resident_data) == long_resident
    assert got[5].filename == ""


# -- recovery ------------------------------------------------------------------------

FILES = "volume string, file_id long, is_resident boolean, data_runs array<struct<start:long,n:long>>"
EXTENTS = "volume string, start long, end_excl long"


def test_recovery_cases(spark):
    files = spark.createDataFrame(
        [("C:", 1, True, []), ("C:", 2, False, []), ("C:", 3, False, [(5000, 10)]), ("C:", 4, False, [(0, 100)]),
         ("C:", 5, False, [(0, 49), (9000, 1)]), ("C:", 6, False, [(10, 20)]), ("C:", 7, False, [(500, 30)])],
        FILES,
    )
    extents = spark.createDataFrame([("C:", 0, 49), ("C:", 510, 515), ("D:", 5000, 6000)], EXTENTS)
    got = {r.file_id: (r.status, round(r.recovery_percent, 2)) for r in recovery.assess(files, extents).collect()}
    assert got == {
        1: ("FULL", 100.0), 2: ("METADATA_ONLY", 0.0), 3: ("FULL", 100.0), 4: ("PARTIAL", 51.0),
        5: ("PARTIAL", 2.0), 6: ("OVERWRITTEN", 0.0), 7: ("PARTIAL", 83.33),
    }
    guess = {r.file_id: (r.status, r.recovery_percent) for r in recovery.assess(files).collect()}
    assert guess[3] == ("PARTIAL", 50.0) and guess[1] == ("FULL", 100.0)
    stats = recovery.recovery_statistics(recovery.assess(files, extents)).first()
    assert (stats.full_recovery, stats.partial_recovery, stats.metadata_only, stats.overwritten) == (2, 3, 1, 1)


def test_recovery_equals_a_bit_by_bit_count(spark):
    import random

    rng = random.Random(3)
    taken, extents, at = set(), [], 0
    while at < 6000:
        start = at + rng.randrange(1, 200)
        end = start + rng.randrange(1, 900)
        extents.append(("C:", start, end))
        taken.update(range(start, end))
        at = end + 1
    files = [("C:", i, False, [(rng.randrange(0, 6500), rng.randrange(1, 1500)) for _ in range(3)]) for i in range(60)]
    runs = recovery.runs_of(spark.createDataFrame(files, FILES))
    counted = recovery.free_clusters(runs, spark.createDataFrame(extents, EXTENTS))
    got = {r.file_id: (r.total_clusters, r.used_clusters) for r in counted.collect()}
    for _, i, _, runs in files:
        used = sum(1 for s, n in runs for c in range(s, s + n) if c in taken)
        assert got[i] == (sum(n for _, n in runs), used)


def test_bitmap_to_extents(spark):
    bits = bytes([0b11100001, 0b00000001, 0, 0xFF])
    df = spark.createDataFrame([("C:", 4, bytearray(bits))], "volume string, byte_offset long, bits binary")
    got = sorted((r.start, r.end_excl) for r in recovery.bitmap_extents(df).collect())
    assert got == [(32, 33), (37, 41), (56, 64)]


def test_large_bit_maps_take_linear_time(spark):
    rng = np.random.default_rng(3)
    data = [rng.integers(0, 256, 1 << 16, np.uint8).tobytes(), b"\xff" * (recovery.STRETCH + 2), b"", None]
    rows = [("C:", 10, data[0]), ("D:", 0, data[1]), ("E:", 0, data[2]), ("E:", 0, data[3])]
    df = spark.createDataFrame(rows, "volume string, byte_offset long, bits binary")
    got = recovery.bitmap_extents(df).orderBy("volume", "start").collect()
    taken = [80 + 8 * i + j for i, x in enumerate(data[0]) for j in range(8) if x >> j & 1]
    starts = [c for i, c in enumerate(taken) if not i or taken[i - 1] != c - 1]
    assert [r.start for r in got if r.volume == "C:"] == starts
    assert sum(r.end_excl - r.start for r in got if r.volume == "C:") == len(taken)
    edge = 8 * recovery.STRETCH
    assert [(r.volume, r.start, r.end_excl) for r in got if r.volume != "C:"] == [("D:", 0, edge), ("D:", edge, edge + 16)]


def test_repeated_and_overlapping_extents_count_once(spark):
    files = spark.createDataFrame(
        [("C:", 1, False, [(0, 512)]), ("C:", 2, False, [(100, 20)])],
        "volume string, file_id long, is_resident boolean, data_runs array<struct<start:long,n:long>>",
    )
    extents = spark.createDataFrame(
        [("C:", 0, 400), ("C:", 0, 400), ("C:", 50, 110), ("C:", 390, 450)], "volume string, start long, end_excl long"
    )
    used = {
        r.file_id: (r.total_clusters, r.used_clusters)
        for r in recovery.free_clusters(recovery.runs_of(files), extents).collect()
    }
    assert used == {1: (512, 450), 2: (20, 20)}


def test_registry_values_are_dealt_out_before_the_fold(spark):
    values = spark.range(20).select(
        F.concat(F.lit("h"), F.col("id") % 2).alias("host"),
        F.when(F.col("id") >= 0, "HKLM").alias("hive"),
        F.concat(F.lit(L.SERVICES_KEY + "\\S"), F.col("id")).alias("key_path"),
        F.lit("ImagePath").alias("value_name"), F.lit(1).alias("value_type"),
        F.lit("x").alias("value_text"), F.lit(b"0").alias("value_data"),
    )
    found = registry.services(values)
    assert {r.name for r in found.collect()} == {f"S{n}" for n in range(20)}
    plan = registry.services(values)._jdf.queryExecution().executedPlan().toString()
    above, below = plan.rsplit("Exchange hashpartitioning", 1)
    assert "Aggregate" in above and "Aggregate" not in below  # an input task sorts nothing
