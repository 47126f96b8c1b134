"""Cases, intelligence, sources, sinks and streams end to end."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from evidlake.operators import case, hashes, image, intel, mft_decode
from evidlake.operators import events as ev
from evidlake.operators.scan import explode_findings
from evidlake.sources import files, sinks
from evidlake.streaming import detectors

EVIL = "mimikatz on 10.0.0.1 and\nmeterpreter"


def evidence(spark):
    rows = [("/e/a.txt", 10, datetime(2024, 1, 2), "laptop", EVIL), ("/e/b.txt", 20, datetime(2024, 1, 1), None, "call 8.8.8.8"),
            ("/e/c.txt", 30, datetime(2024, 1, 3), "phone", "clean")]
    return spark.createDataFrame(rows, "path string, size long, mtime timestamp, label string, text string")


def test_case_views(spark):
    all_files = case.case_findings(evidence(spark), "C1", hits_only=False)
    found = case.case_findings(evidence(spark), "C1")
    totals = case.case_totals(all_files).first()
    assert (totals.total_files_scanned, totals.files_with_iocs, totals.total_iocs) == (3, 2, 5)
    assert totals.critical + totals.high + totals.medium + totals.low == totals.total_iocs
    assert [r.file for r in case.case_timeline(found).collect()] == ["b.txt", "a.txt"]
    assert {r.label for r in case.evidence_sources(found).collect()} == {"laptop", "Unlabeled"}
    assert [(r.category, r.files) for r in case.category_files(found).collect()] == [("Network IOC", 2), ("Malware", 1)]
    assert [r.path for r in case.having_severity(found, ["CRITICAL"]).collect()] == ["/e/a.txt"]
    strict = case.case_findings(evidence(spark), "C1", ["CRITICAL"]).collect()
    assert [(r.path, r.total_iocs, r.threat_score) for r in strict] == [("/e/a.txt", 2, 100)]


def test_notes_take_the_newest(spark):
    notes = spark.createDataFrame(
        [("/e/a.txt", "old", datetime(2024, 1, 1)), ("/e/a.txt", "new", datetime(2024, 1, 2)), ("/x", "other", datetime(2024, 1, 2))],
        "path string, note string, ts timestamp",
    )
    got = {r.path: r.notes for r in case.with_notes(case.case_findings(evidence(spark), "C1"), notes).collect()}
    assert got == {"/e/a.txt": "new", "/e/b.txt": ""}


def test_dashboard_and_activity(spark):
    n = lambda k: spark.range(k).agg(F.count("*").alias("n"))
    board = case.module_totals({"A": n(3), "B": n(0)}, {"A": 2, "B": 0})
    assert {r.module: (r["items"], r.active, r.alert) for r in board.collect()} == {"A": (3, True, True), "B": (0, False, False)}
    assert case.modules_active(board).first()[0] == 1
    assert {r.type: r.matches for r in case.activity_log({"x": spark.range(4)}).collect()} == {"x": 4}


@pytest.mark.parametrize(
    "m,s,h,u,score,level",
    [(11, 0, 0, 0, 200, "HIGH"), (10, 0, 10, 0, 100, "MEDIUM"), (4, 0, 0, 4, 100, "MEDIUM"), (0, 6, 6, 0, 50, "MEDIUM"),
     (3, 5, 1, 0, 122, "LOW"), (0, 1, 2, 0, 33, "LOW"), (0, 0, 5, 5, 0, "CLEAN"), (0, 0, 0, 0, None, "CLEAN")],
)
def test_verdict(spark, m, s, h, u, score, level):
    df = spark.createDataFrame([(m, s, h, u)], "malicious int, suspicious int, harmless int, undetected int")
    row = intel.verdict(df).first()
    assert (row.threat_score, row.threat_level) == (score, level)


def test_stale_answers_are_unknown(spark):
    hashed = spark.createDataFrame([("/a", "AA"), ("/b", "bb"), ("/c", "cc")], "path string, sha256 string")
    answers = spark.createDataFrame(
        [("aa", datetime(2024, 1, 2, 1), 0, 0, 9, 0), ("aa", datetime(2024, 1, 2, 2), 50, 0, 9, 0), ("bb", datetime(2024, 1, 1), 50, 0, 9, 0)],
        "hash string, ts timestamp, malicious int, suspicious int, harmless int, undetected int",
    )
    rows = intel.hash_verdicts(hashed, answers, F.lit("2024-01-02 12:00:00").cast("timestamp"))
    assert {r.path: r.threat_level for r in rows.collect()} == {"/a": "HIGH", "/b": "UNKNOWN", "/c": "UNKNOWN"}
    assert {r.verdict: r.files for r in intel.verdict_tally(rows).collect()} == {"malicious": 1, "unknown": 2}


def test_reading_evidence(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(b"mimi\xffkatz \xe4\xb8\xad")
    (tmp_path / "b.exe").write_bytes(b"mimikatz")
    (tmp_path / "sub" / "c.LOG").write_text("8.8.8.8")
    base = str(tmp_path)
    texts = {r.path.rsplit("/", 1)[1]: r.text for r in files.evidence_text(spark, base).collect()}
    assert texts == {"a.txt": "mimikatz \u4e2d", "c.LOG": "8.8.8.8"}
    assert files.evidence_text(spark, base, recursive=False).count() == 1
    assert [r.path[-5:] for r in files.evidence_text(spark, base, extensions=[".log"]).collect()] == ["c.LOG"]
    assert files.evidence_text(spark, [base], max_chars=4).filter("text = 'mimi'").count() == 1
    assert files.text_files(spark, base + "/a.txt").count() == 1
    plan = files.evidence_files(spark, base).filter("size > 5").select("path")._jdf.queryExecution().executedPlan().toString()
    assert "length" in plan and "content" not in plan.split("ReadSchema")[1]


def test_reading_images(spark, tmp_path):
    from tests.test_records import STANDARD, attribute, file_name, raw_record

    raw = b"".join(raw_record(STANDARD, attribute(0x30, file_name(f"f{i}.txt", 3))) for i in range(40))
    (tmp_path / "mft").write_bytes(raw)
    records = files.mft_image(spark, str(tmp_path / "mft"), "C:")
    got = {r.entry_number: r.filename for r in mft_decode.decode_mft(records).collect()}
    assert got == {i: f"f{i}.txt" for i in range(40)}
    assert files.mft_image(spark, str(tmp_path / "mft"), "C:", max_records=7).count() == 7
    page = (b"\0" * 50 + b"hello wide world" * 4).ljust(512, b"\0")
    (tmp_path / "page").write_bytes(page)
    strings = image.carve_strings(files.page_image(spark, str(tmp_path / "page"), "p", 64)).collect()
    assert [(r.offset, r.value) for r in strings] == [(50, "hello wide world" * 4)]
    short = spark.createDataFrame([("i", bytearray(b"x" * 10))], "image string, content binary")
    assert files.slice_images(short, 4, drop_tail=True).count() == 2
    assert files.slice_images(short, 4).count() == 3


def test_sinks(spark, tmp_path):
    out = str(tmp_path)
    noted = case.case_findings(evidence(spark), "C1").withColumn("notes", F.lit("n"))
    sinks.write_case_json(noted, case.case_totals(noted), out + "/json")
    assert spark.read.json(out + "/json/findings").count() == 2
    sinks.write_summary_csv(noted, out + "/csv")
    csv = spark.read.csv(out + "/csv", header=True)
    assert len(csv.columns) == 15 and csv.count() == 2
    hashed = hashes.hash_files(evidence(spark).select("path", F.encode("text", "UTF-8").alias("content")))
    sinks.write_hash_database(hashed, out + "/db")
    sinks.write_file_hashes(hashed, out + "/hashes")
    assert spark.read.csv(out + "/hashes", header=True).count() == 9
    found = explode_findings(noted.select("path", "findings"))
    sinks.write_indicator_csv(found, out + "/ioc")
    assert spark.read.csv(out + "/ioc", header=True).columns == ["Type", "Value", "File", "Severity"]
    sinks.write_report_tables({"files": noted.select("path"), "n": hashed}, out + "/report")
    assert spark.read.parquet(out + "/report/files").count() == 2


EVENT = "log string, ts timestamp, event_id int, strings array<string>"


def test_streams_equal_batch(spark, tmp_path):
    base = datetime(2024, 1, 1, 10)
    user = ["", "", "", "", "", "bob"]
    burst = [("security", base.replace(second=i), 4625, user) for i in range(7)]
    late = [("security", base.replace(hour=23, minute=30), 4624, user), ("system", base, 20001, ["stick"])]
    source = str(tmp_path / "in")
    spark.createDataFrame(burst + late, EVENT).coalesce(1).write.parquet(source)
    # A second, later file moves the watermark on.
    spark.createDataFrame([("security", base.replace(day=3), 4624, user)], EVENT).coalesce(1).write.mode("append").parquet(source)
    stream = detectors.event_stream(spark, source, EVENT)
    batch = ev.normalize(spark.read.parquet(source))

    def run(df, name):
        detectors.write_findings(df, str(tmp_path / name), str(tmp_path / f"{name}-state")).awaitTermination()
        return spark.read.parquet(str(tmp_path / name))

    got = run(detectors.stream_brute_force(stream), "force").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in ev.brute_force(batch).collect()] and len(got) == 1
    rows = run(detectors.stream_row_anomalies(stream), "rows")
    assert sorted(r.kind for r in rows.collect()) == sorted(r.kind for r in ev.row_anomalies(batch).collect())
    assert run(detectors.device_feed(stream), "usb").first().device == "stick"


def test_text_stream(spark, tmp_path):
    (tmp_path / "drop").mkdir()
    (tmp_path / "drop" / "a.txt").write_text(EVIL)
    rows = detectors.stream_text_scan(spark, str(tmp_path / "drop"))
    detectors.write_findings(rows, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    names = {r.name for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {"credential_theft", "backdoor_keyword", "private_ip"} <= names
