"""Events, browsers, registry, clocks."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evidlake.functions import times
from evidlake.operators import browser, registry
from evidlake.operators import events as ev
from evidlake.schemas import REGISTRY_VALUES

EVENT = "log string, ts timestamp, event_id int, strings array<string>"
NOON = datetime(2024, 1, 1, 12, 0, 0)
USER = ["0", "1", "2", "3", "4", "bob"]


def events(spark, *rows):
    return ev.normalize(spark.createDataFrame(list(rows), EVENT))


def test_brute_force_limits(spark):
    def burst(n, user, start=NOON):
        return [("security", start + timedelta(seconds=i), 4625, USER[:5] + [user]) for i in range(n)]

    split = burst(4, "edge", NOON + timedelta(seconds=296)) + burst(4, "edge", NOON + timedelta(minutes=5))
    got = ev.brute_force(events(spark, *burst(5, "a"), *burst(6, "b"), *burst(10, "c"), *burst(11, "d"), *split))
    assert {r.username: (r.attempts, r.severity) for r in got.collect()} == {
        "b": (6, "MEDIUM"), "c": (10, "MEDIUM"), "d": (11, "HIGH"),
    }


@pytest.mark.parametrize("clock,hit", [("22:59", False), ("23:00", True), ("06:59", True), ("07:00", False)])
def test_unusual_logon(spark, clock, hit):
    ts = datetime.strptime("2024-01-01 " + clock, "%Y-%m-%d %H:%M")
    assert ev.unusual_logons(events(spark, ("security", ts, 4624, USER))).count() == int(hit)


@pytest.mark.parametrize(
    "script,severity",
    [("dir", None), ("bypass", "MEDIUM"), ("bypass hidden", "MEDIUM"), ("bypass hidden IEX x", "HIGH")],
)
def test_powershell(spark, script, severity):
    got = ev.suspicious_powershell(events(spark, ("powershell", NOON, 4104, ["", script]))).collect()
    assert [r.severity for r in got] == ([severity] if severity else [])


def test_powershell_looks_at_the_whole_script(spark):
    row = ev.suspicious_powershell(events(spark, ("powershell", NOON, 4104, ["x" * 5000 + " bypass"]))).first()
    assert row.indicators == ["bypass"] and len(row.script_preview) == 200


def test_services_and_short_strings(spark):
    got = ev.suspicious_services(
        events(
            spark, ("system", NOON, 7045, ["a", "C:\\Windows\\System32\\a.exe"]),
            ("system", NOON, 7045, ["b", "C:\\Users\\x\\AppData\\b.exe"]), ("system", NOON, 7045, []),
        )
    ).collect()
    assert [r.service_name for r in got] == ["b"]
    logons = events(spark, ("security", NOON.replace(hour=1), 4624, USER[:5]), ("security", NOON.replace(hour=2), 4624, USER))
    assert sorted(r.username for r in ev.unusual_logons(logons).collect()) == ["Unknown", "bob"]


def test_id_detectors_and_totals(spark):
    df = events(
        spark, ("security", NOON, 1149 | 0x40000000, ["", "", "1.2.3.4"]), ("system", NOON, 21, []),
        ("security", NOON, 4672, ["", "eve"]), ("system", NOON, 20001, ["stick"]), ("system", NOON, 9999, []),
        ("powershell", NOON, 4104, ["bypass"]),
    )
    assert sorted(r.source_ip for r in ev.remote_access(df).collect()) == ["1.2.3.4", "Unknown"]
    assert ev.privilege_escalation(df).first().username == "eve"
    assert ev.usb_activity(df).first().device == "stick"
    totals = {r.kind: r.n for r in ev.anomaly_totals(df).collect()}
    kinds = [r.kind for r in ev.anomalies(df).collect()]
    assert totals["total"] == len(kinds) == 5
    assert all(totals[k] == kinds.count(k) for k in set(kinds))
    attributes = {r.kind: r.attributes for r in ev.row_anomalies(df).collect()}
    assert attributes["suspicious_powershell"]["indicators"] == "bypass"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_clocks(spark):
    assert value(spark, times.filetime(F.lit(133500000000000000))) == datetime(2024, 1, 17, 21, 20)
    assert value(spark, times.filetime(F.lit(0))) is None
    assert value(spark, times.filetime(F.lit(2**62))) is None
    assert value(spark, times.core_foundation(F.lit(700000000.0))) == datetime(2023, 3, 8, 20, 26, 40)
    assert value(spark, times.chromium_time(F.lit(times.MICROS_1601_TO_1970 + 1_000_000))) == datetime(1970, 1, 1, 0, 0, 1)
    assert value(spark, times.unix_micros(F.lit(2_000_000))) == datetime(1970, 1, 1, 0, 0, 2)
    assert value(spark, times.display(F.lit(None).cast("timestamp"))) == "N/A"


@pytest.mark.parametrize(
    "url,domain",
    [("https://www.Ex.com:8080/a", "ex.com:8080"), ("http://localhost:3000/x", "http://localhost:3000"),
     ("http://127.0.0.1/x", "http://127.0.0.1"), ("about:blank", "about:blank"),
     ("https://a.b/x y|z", "a.b"), ("http://u:p@host.org/", "u:p@host.org")],
)
def test_domain(spark, url, domain):
    assert value(spark, browser.domain(F.lit(url))) == domain


def test_visit_labels(spark):
    assert value(spark, browser.transition_label(F.lit(0x30000001))) == "Typed URL"
    assert value(spark, browser.transition_label(F.lit(55))) == "Unknown (55)"
    assert value(spark, browser.transition_label(F.lit(None).cast("int"))) == "Unknown"
    assert value(spark, browser.firefox_visit_label(F.lit(7))) == "Download"


def reg(spark, *rows):
    full = [("h", hive, key, name, 1, text, None if data is None else bytearray(data)) for hive, key, name, text, data in rows]
    return spark.createDataFrame(full, REGISTRY_VALUES)


def test_registry_text_families(spark):
    df = reg(
        spark,
        ("HKLM", "software\\microsoft\\windows\\currentversion\\run", "a", "a.exe", None),
        ("HKCU", "SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\RunOnce", "b", "b.exe", None),
        ("HKLM", "SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\RunMore", "c", "c.exe", None),
        ("HKLM", "SYSTEM\\CurrentControlSet\\Services\\S1", "ImagePath", "s.exe", None),
        ("HKLM", "SYSTEM\\CurrentControlSet\\Services\\S1", "Start", "2", None),
        ("HKLM", "SYSTEM\\CurrentControlSet\\Services\\S2", "DisplayName", "no path", None),
        ("HKCU", "Software\\Microsoft\\Internet Explorer\\TypedURLs", "url1", "", None),
    )
    assert sorted((r.location, r.name) for r in registry.run_keys(df).collect()) == [("HKCU RunOnce", "b"), ("HKLM Run", "a")]
    row = registry.services(df).collect()
    assert [(r.name, r.display_name, r.start_type) for r in row] == [("S1", "S1", "Automatic")]
    assert registry.typed_urls(df).count() == 0
    stats = {r.family: r.artifacts for r in registry.registry_statistics(df).collect()}
    assert stats["total"] == 3 and stats["run_keys"] == 2 and stats["userassist"] == 0


def test_registry_binary_families(spark):
    when = 133500000000000000
    blob = b"\0" * 4 + (300).to_bytes(4, "little") + b"\0" * 52 + when.to_bytes(8, "little") + b"\0" * 4
    key = registry.L.USERASSIST_KEY + "\\{G}\\Count"
    df = reg(
        spark, ("HKCU", key, "P:\\Ncc.rkr", None, blob), ("HKCU", key, "fubeg", None, blob[:8]),
        ("HKCU", key, "rzcgl", None, b""), ("HKCU", registry.L.RECENT_DOCS_KEY, "0", None, "\u00fcb.txt".encode("utf-16le") + b"\0\0"),
        ("HKCU", registry.L.MRU_KEYS[0], "MRUListEx", None, b"\1\0\0\0"),
    )
    got = {r.program: (r.run_count, r.last_executed) for r in registry.userassist(df).collect()}
    assert got == {"C:\\App.exe": (300, datetime(2024, 1, 17, 21, 20)), "short": (300, None), "empty"[:5]: (0, None)}
    assert registry.recent_docs(df).first().filename == "\u00fcb.txt"
    assert registry.mru_lists(df).count() == 0


def test_timeline_orders_by_the_shown_second(spark):
    rows = [
        (record, "h", "security", NOON + timedelta(microseconds=us), 4624, USER)
        for record, us in [(1, 100), (2, 900_000), (3, 500_000), (4, -1)]
    ]
    schema = "record long, host string, log string, ts timestamp, event_id int, strings array<string>"
    got = ev.timeline(ev.normalize(spark.createDataFrame(rows, schema)), 2).collect()
    assert [r.record for r in got] == [1, 2]
