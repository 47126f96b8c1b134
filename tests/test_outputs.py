"""Captured output, memory texts, devices."""

import pytest
from pyspark.sql import functions as F

from evidlake.operators import memory, outputs

SCHEMA = "host string, category string, cmd string, output string"


def parse(spark, cmd, text):
    df = spark.createDataFrame([("h", "c", cmd, text)], SCHEMA)
    rows = outputs.parse_outputs(df).orderBy("section_no", "line_no").collect()
    return [(r.format, r.section, [(f.name, f.value) for f in r.fields]) for r in rows]


def formats(spark, cmd, text):
    return spark.createDataFrame([(cmd, text)], "cmd string, t string").select(
        outputs.output_format(F.col("cmd"), F.col("t"))
    ).first()[0]


@pytest.mark.parametrize(
    "cmd,text,fmt",
    [("systeminfo", "a: b", "key_value"), ("systeminfo", "nothing", "generic"), ("net user", "User accounts for x", "net_user"),
     ("wmic useraccount list", "x", "wmic"), ("tasklist /svc", "x", "tasklist"), ("Get-X", "a: b", "format_list"),
     ("Get-X|Format-Table", "a: b\n---", "dashed_table"), ("dir", "x\n---", "dashed_table"), ("netstat -s", "x", "netstat_statistics"),
     ("netstat -nao", "TCP a", "netstat"), ("netstat -nao", "UDP Statistics", "netstat_statistics"), ("arp -a", "x", "arp"),
     ("ipconfig /all", "x", "ipconfig"), ("route print", "x", "route"), ("sc.exe query", "x", "sc_query"), ("x", "=== a", "usb"),
     ("x", "a: b\nc\nd", "generic_key_value"), ("x", "a: b\nc\nd\ne", "generic"), ("x", "plain", "generic"),
     ("x", "\n".join(["a"] * 10 + ["---"]), "generic")],
)
def test_dispatch(spark, cmd, text, fmt):
    assert formats(spark, cmd, text) == fmt


def test_key_value_needs_both_sides(spark):
    assert parse(spark, "systeminfo", "\r\n A : b:c \r\n D:\r\n: e\r\n") == [("key_value", "", [("A", "b:c")])]


def test_tasklist(spark):
    text = "Image Name PID\n====\nMy  Tool.exe 12 Services 0 8,192 K\nplain 1 2 3\na.exe 7\n"
    assert parse(spark, "tasklist", text) == [
        ("tasklist", "", [("name", "My Tool.exe"), ("pid", "12"), ("session", "Services"), ("mem", "0")])
    ]
    assert parse(spark, "tasklist", "no heading") == []


def test_tasklist_by_ruler(spark):
    text = (
        "\nImage Name                     PID Session Name        Session#    Mem Usage\n"
        "========================= ======== ================ =========== ============\n"
        "System Idle Process              0 Services                   0          8 K\n"
        "Registry                       148                            0     98,148 K\n"
        "a.exe                        12345 Console                    1  1,048,576 K\n"
    )
    names = ["name", "pid", "session", "Session#", "mem"]
    rows = [
        ("System Idle Process", "0", "Services", "0", "8 K"), ("Registry", "148", "", "0", "98,148 K"),
        ("a.exe", "12345", "Console", "1", "1,048,576 K"),
    ]
    assert parse(spark, "tasklist", text) == [
        ("tasklist", "", [(n, v) for n, v in zip(names, row) if v]) for row in rows
    ]
    services = "Image Name    PID Services\n========== ====== ===========\nlsass.exe     700 KeyIso,\n                  SamSs\n"
    assert parse(spark, "tasklist /svc", services) == [
        ("tasklist", "", [("name", "lsass.exe"), ("pid", "700"), ("Services", "KeyIso,")]),
        ("tasklist", "", [("Services", "SamSs")]),
    ]


def test_dashed_table_without_heading(spark):
    assert parse(spark, "dir", "----\na b") == []
    assert parse(spark, "dir", "A B\n- ---\n1 2 3\n===\n") == [
        ("dashed_table", "", [("A", "1"), ("B", "2"), ("column_3", "3")])
    ]


def test_wmic_uses_known_columns_when_the_heading_is_short(spark):
    got = parse(spark, "wmic useraccount", "Only\n\n512  d  FALSE\na  b\n")
    assert got == [("wmic", "", [("AccountType", "512"), ("Description", "d"), ("Disabled", "FALSE")])]


def test_netstat(spark):
    got = parse(spark, "netstat -nao", "Proto\n TCP a:1 b:2 CLOSE_WAIT 77\nUDP a b 5\nUDP a b\nTCP a b c\n")
    assert [dict(f)["state"] for _, _, f in got] == ["CLOSE_WAIT", "LISTENING", "c"]
    assert [dict(f)["pid"] for _, _, f in got] == ["77", "5", "N/A"]


def test_statistics_sections(spark):
    got = parse(spark, "netstat -s", "IPv4 first\n\nInterface Statistics\n  Received = 5\n  Sent : 6\nTCP for any\n  Open 7\n9 lines = 1\n")
    assert got == [
        # A digit among the first ten characters means it is no heading.
        ("netstat_statistics", "", [("IPv4 first", None)]),
        ("netstat_statistics", "Interface Statistics", [("Received", "5")]),
        ("netstat_statistics", "Interface Statistics", [("Sent", "6")]),
        ("netstat_statistics", "TCP for any", [("Open 7", None)]),
        ("netstat_statistics", "TCP for any", [("9 lines", "1")]),
    ]


def test_arp_route_and_services(spark):
    arp = parse(spark, "arp -a", "stray line x\nInterface: 1\n Internet Address Physical Address\n 10.0.0.1 aa dyn\n one\nInterface: 2\n 10.0.0.2 bb\n")
    assert [(s, f[0][1], f[2][1]) for _, s, f in arp] == [("Interface: 1", "10.0.0.1", "dyn"), ("Interface: 2", "10.0.0.2", "")]
    route = parse(spark, "route print", "x\nNetwork Destination Netmask\n0.0.0.0 m g i 25\n\n1.1.1.1 m g i 9\nDestination B\n2.2.2.2 m g i 3\n")
    assert [f[4][1] for _, _, f in route] == ["25", "3"]
    sc = parse(spark, "sc query", "lost: 1\nSERVICE_NAME: A\n TYPE : 1\nSERVICE_NAME: B\n TYPE : 2\n")
    assert [(s, f) for _, s, f in sc] == [("", [("lost", "1")]), ("A", [("TYPE", "1")]), ("B", [("TYPE", "2")])]


def test_format_list_and_usb(spark):
    got = parse(spark, "Get-X|fl", "Head\nName : a\nEmpty :\n=== x: y\nNext\nName: b")
    assert [(s, f) for _, s, f in got] == [("Head", [("Name", "a")]), ("Head", [("Empty", "")]), ("Next", [("Name", "b")])]
    usb = parse(spark, "report", "=== USB DEVICE INFO ===\nMfg : m\n=== USB INSERT / REMOVE EVENTS ===\n1 2 3\n1 2\n")
    assert [(s, f[0]) for _, s, f in usb] == [("device", ("Mfg", "m")), ("event", ("time", "1 2"))]
    assert dict(usb[1][2])["message"] == ""


def test_usable_and_blocks(spark):
    df = spark.createDataFrame(
        [("h", "a", "c1", "x"), ("h", "a", "c2", "[ERROR] y"), ("h", "a", "c3", " \n"), ("h", "a", "c4", None), ("h", "hash_analysis", "c5", "z")],
        SCHEMA,
    )
    assert [r.cmd for r in outputs.evidence_blocks(df).collect()] == ["c1"]
    assert outputs.evidence_blocks(df).first().text == "=== A - c1 ===\nx"
    described = outputs.describe(spark.createDataFrame([("net user",), ("y" * 150,)], "cmd string"))
    assert sorted(len(r.description) for r in described.collect()) == [len("Display all user accounts on the system"), 100]


@pytest.mark.parametrize(
    "os,cmd,shell",
    [("windows", "Get-Process", "powershell"), ("windows", "$x", "powershell"), ("windows", "dir", "cmd"), ("linux", "Get-X", "bash"),
     ("macos", "ls", "zsh"), ("linux", "ANALYZE_ALL", "regex_analysis"), ("linux", "HASH_X", "hash_analysis")],
)
def test_shell(spark, os, cmd, shell):
    assert spark.range(1).select(outputs.shell_type(F.lit(os), F.lit(cmd))).first()[0] == shell


def text(spark, body):
    return spark.createDataFrame([("h", body)], "host string, output string")


def test_memory_texts(spark):
    row = memory.memory_summary(text(spark, "MemTotal: 100 kB\nMemFree: 40 kB\n")).first()
    assert (row.total, row.available, row.used, row.total_human) == (102400, 40960, 61440, "100.00 KB")
    ranges = memory.ram_ranges(text(spark, "00001000-00001fff : System RAM\n  00001000-00001fff : System RAM\n00000000-00000000 : System RAM\n"))
    assert [(r.start, r.end, r["size"]) for r in ranges.collect()] == [(4096, 8191, 4096)]
    ps = memory.processes(text(spark, "USER ...\nroot 1 0.0 0.1 1 22 ? S 1 2 /dev/x -a  b\nbad line\n"))
    assert [(r.rss_kb, r.command) for r in ps.collect()] == [(22, "/dev/x -a  b")]
    assert memory.processes_in_temp(ps).count() == 1
    vm = memory.vm_statistics(text(spark, "Pages free: 10.\n\"x\": y\n")).collect()
    assert [(r.key, r["bytes"]) for r in vm] == [("Pages free", 40960)]
    one = memory.windows_processes(text(spark, '{"Name":"a","Id":5,"WorkingSet64":9}')).collect()
    assert [(r.name, r.working_set) for r in one] == [("a", 9)]


def test_labels(spark):
    pick = lambda c: spark.range(1).select(c).first()[0]
    assert [pick(memory.memory_pressure(F.lit(n))) for n in (51, 50, 21, 20)] == ["Normal", "Warning", "Warning", "Critical"]
    assert pick(memory.crash_dump_type(F.lit(7))) == "Automatic" and pick(memory.crash_dump_type(F.lit(5))) == "Unknown"
    assert pick(memory.dump_kind(F.lit("C:\\Windows\\MEMORY.DMP"))) == "Full Memory Dump"
    assert pick(memory.dump_kind(F.lit("C:\\Windows\\Minidump\\a.dmp"))) == "Minidump"
    assert pick(memory.lockdown_level(F.lit("none [integrity] confidentiality"))) == "integrity"
    assert pick(memory.symbols_note(F.lit("0000000000000000 T x"))).startswith("Symbols hidden")


def test_external_connections(spark):
    df = spark.createDataFrame(
        [("ESTAB", "1.2.3.4:5"), ("ESTABLISHED", "127.0.0.1:5"), ("LISTEN", "1.2.3.4:5"), ("ESTAB", "[::1]:3"),
         ("ESTAB", "[2606:4700::1111]:443"), ("ESTAB", "127.10.0.1:1"), ("ESTAB", "12.127.0.0:1"), ("ESTAB", "[::ffff:127.0.0.1]:9")],
        "state string, foreign string",
    )
    got = {r.foreign for r in outputs.external_connections(df).collect()}
    assert got == {"1.2.3.4:5", "[2606:4700::1111]:443", "12.127.0.0:1"}


def test_captured_outputs_are_dealt_finer_than_cores(spark):
    from evidlake.plans import standins

    rows = standins.command_outputs(spark, "/root/testdata/sf0.001")
    assert rows.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
