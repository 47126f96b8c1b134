"""Pattern scans against Python's re on the seed corpus, and the score limits."""

import random
import re

import pytest
from pyspark.sql import functions as F

from evidlake import catalogs as C
from evidlake.catalogs.patterns import PAGE_IMAGE
from evidlake.functions.text import NON_RECURSIVE
from evidlake.operators import scan as S
from tests.corpus import LINES

TEXTS = [*LINES, "\n".join(LINES)]
CATALOGS = {
    "extract": C.extract_catalog(),
    "suspicious": C.suspicious_catalog(),
    "ioc": C.indicator_catalog(),
    "pii": C.personal_catalog(),
}


def expected(catalog):
    out = []
    for i, text in enumerate(TEXTS):
        for p in catalog:
            flags = re.IGNORECASE | (re.MULTILINE if p.multiline else 0)
            found = list(dict.fromkeys(re.findall(p.regex, text, flags)))
            if found:
                out.append((i, p.name, tuple(found)))
    return sorted(out)


def found(scanned):
    return sorted(
        (r.id, r.name, tuple(r.matches)) for r in S.explode_findings(scanned).collect()
    )


def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")


@pytest.mark.parametrize("name", list(CATALOGS))
def test_matches_and_order(spark, name):
    got = found(S.scan(texts(spark), CATALOGS[name]))
    assert got == expected(CATALOGS[name])


def test_every_pattern_is_hit():
    silent = [
        p.name for c in CATALOGS.values() for p in c if not any(n == p.name for _, n, _ in expected(c))
    ]
    assert silent == []


@pytest.mark.parametrize("name", list(CATALOGS))
def test_gates_change_nothing(spark, name):
    base = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{base}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    pages = spark.read.parquet(f"{base}/pages.parquet").select("page_id", F.col("html").alias("text"))
    data = texts(spark).union(docs).union(pages)
    assert found(S.scan(data, CATALOGS[name])) == found(S.scan(data, CATALOGS[name], gated=False))


def test_gates_do_not_follow_a_borrowed_name(spark):
    own = C.Pattern("extract", "extract", "email", r"\w+ at \w+\.\w+")
    df = spark.createDataFrame([(0, "write to joe at example.com")], "id int, text string")
    assert found(S.scan(df, [own])) == [(0, "email", ("joe at example.com",))]


def test_rewritten_expressions_belong_to_shipped_ones():
    shipped = {p.regex for c in CATALOGS.values() for p in c} | {r for _, _, r in PAGE_IMAGE}
    assert set(NON_RECURSIVE) <= shipped


def test_dotted_names_equal_python(spark):
    rng = random.Random(5)
    parts = ["a", "b1", "com", "tk", "top", "live", "-", ".", ".", ".", "_", " ", "x" * 61, "9", "K", "\u017f", "\u00e9", "a-b"]
    lines = ["".join(rng.choices(parts, k=rng.randint(1, 24))) for _ in range(4000)]
    names = {"domain", "suspicious_tld"}
    catalog = [p for p in C.extract_catalog() if p.name in names]
    df = spark.createDataFrame(list(enumerate(lines)), "id int, text string")
    want = []
    for i, line in enumerate(lines):
        for p in catalog:
            hits = re.findall(p.regex, line, re.IGNORECASE)
            if hits:
                want.append((i, p.name, tuple(dict.fromkeys(hits))))
    assert len(want) > 500
    assert found(S.scan(df, catalog)) == sorted(want)


@pytest.mark.parametrize("unit", ["a.", "1-1.", "ab.com.", "a-", "com.tk-"])
def test_long_dotted_names_do_not_overflow(spark, unit):
    text = unit * (1_000_000 // len(unit)) + " x.top"
    catalog = [p for p in C.extract_catalog() if p.name in {"domain", "suspicious_tld"}]
    catalog += [p for p in C.indicator_catalog() if p.name == "suspicious_domain"]
    got = {name: matches for _, name, matches in found(S.scan(spark.createDataFrame([(0, text)], "id int, text string"), catalog))}
    assert set(got) == {"domain", "suspicious_tld", "suspicious_domain"}
    assert all("x.top" in m for m in got.values())


def test_long_concatenation_does_not_overflow(spark):
    text = "+ 'a' + '" + "+ 'a + '" * 100_000
    one = [p for p in C.indicator_catalog() if p.name == "string_concat"]
    assert found(S.scan(spark.createDataFrame([(0, text)], "id int, text string"), one)) == [
        (0, "string_concat", tuple(dict.fromkeys(re.findall(one[0].regex, text, re.IGNORECASE))))
    ]


def test_long_path_does_not_overflow(spark):
    path = "/" + "a/" * 200_000 + "end"
    df = spark.createDataFrame([(0, path)], "id int, text string")
    one = [p for p in C.extract_catalog() if p.name == "file_path"]
    assert found(S.scan(df, one)) == [(0, "file_path", (path,))]


@pytest.mark.parametrize(
    "score,level", [(29, "LOW"), (30, "MEDIUM"), (99, "MEDIUM"), (100, "HIGH"), (199, "HIGH"), (200, "CRITICAL")]
)
def test_indicator_level(spark, score, level):
    assert spark.range(1).select(S.indicator_level(F.lit(score))).first()[0] == level


@pytest.mark.parametrize(
    "score,level", [(18, "Low"), (20, "Medium"), (49, "Medium"), (50, "High"), (99, "High"), (100, "Critical")]
)
def test_suspicious_level(spark, score, level):
    assert spark.range(1).select(S.suspicious_level(F.lit(score))).first()[0] == level


def test_summary_agrees_with_findings(spark):
    scanned = S.scan(texts(spark), C.indicator_catalog())
    per_text = {r.id: r for r in S.summarize(scanned).collect()}
    for i, text in enumerate(TEXTS):
        rows = [r for r in expected(C.indicator_catalog()) if r[0] == i]
        by_name = {p.name: p for p in C.indicator_catalog()}
        counts = {s: sum(len(m) for _, n, m in rows if by_name[n].severity == s) for s in S.SEVERITIES}
        r = per_text[i]
        assert r.threat_score == sum(len(m) * by_name[n].weight for _, n, m in rows)
        assert [r.critical, r.high, r.medium, r.low] == [counts[s] for s in S.SEVERITIES]
        assert r.total_iocs == sum(counts.values())
        assert r.categories == sorted({by_name[n].category for _, n, _ in rows})


def test_severity_filter_counts_what_is_left(spark):
    scanned = S.scan(texts(spark), C.indicator_catalog())
    rows = S.summarize(S.severity_filter(scanned, ["CRITICAL"])).collect()
    assert rows and all(r.total_iocs == r.critical and r.high == 0 for r in rows)


def test_partitioning_does_not_matter(spark):
    one = found(S.scan(texts(spark).coalesce(1), C.indicator_catalog()))
    assert one == found(S.scan(texts(spark).repartition(7), C.indicator_catalog()))


def test_custom_pattern_reports_errors(spark):
    scanned, bad = S.custom_scan(texts(spark), {"digits": r"\d{4}", "broken": "(["})
    assert [n for n, _ in bad] == ["broken"]
    assert found(scanned)


def test_bug_compatible_note():
    note = {p.name: p.regex for p in C.indicator_catalog(bug_compatible=True)}["ransomware_note"]
    assert note.endswith("/i")


def test_catalog_round_trip(spark):
    back = C.from_table(C.as_table(spark, C.personal_catalog()))
    assert sorted(back, key=lambda p: p.name) == sorted(C.personal_catalog(), key=lambda p: p.name)
    with pytest.raises(ValueError):
        C.from_table(C.as_table(spark, C.personal_catalog()), max_patterns=3)


def test_examples_are_cut_but_counts_stay(spark):
    rows = S.explode_findings(S.scan(texts(spark), C.extract_catalog()))
    for r in S.limit_examples(rows, 5).collect():
        assert len(r.matches) == min(r["count"], 5)


def test_scan_plan_reads_text_once_and_stays_in_the_jvm(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    plan = S.severity_filter(S.scan(df, C.indicator_catalog()), ["HIGH"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("mimikatz") <= 3  # its needle and its expression, not repeated in filters
    assert "Python" not in text and "Exchange" not in text and "Cartesian" not in text


def test_close_gates_open_for_every_match(spark):
    words = [
        "rat", "RAT", "r\u0101t", "irat", "rati", "srat", "\u017frat", "rat\u017f", "\u212arat", "\u00e9rat\u00e9", "_rat",
        "at 5", "AT\u00a07", "at\u000b9", "at \u0665", "or 1=1", "OR\t1 = 1", "union  select", "schtasks", "New-ScheduledTask",
        "x.t\u212a", "x.w\u017f", "a.b.live", "abcdefghij.com", "\u017fbcdefghij.ru", "10.1.2.3", "10.\u0661.2.3", "1.2.3.4",
        "x", " ", "\u0130", "\u0131",
    ]
    rng = random.Random(11)
    lines = words + ["".join(rng.choices(words + [" "] * 8, k=3)) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(lines)), "id int, text string")
    names = {
        "backdoor_keyword", "scheduled_task", "sql_injection", "suspicious_domain", "dga_domain",
        "private_ip", "ipv4_address",
    }
    catalog = [p for p in C.indicator_catalog() if p.name in names]
    for plain in (False, True):
        gated = found(S.scan(df, catalog, ascii_classes=plain))
        assert gated == found(S.scan(df, catalog, gated=False, ascii_classes=plain))
        assert {name for _, name, _ in gated} == names


def test_frequent_letters_open_no_gate(spark):
    text = "The generation of rates, a = b, www.page.html and version 1.2"
    staged, gates = S.stage_gates(spark.createDataFrame([(text,)], "text string"), C.indicator_catalog())
    row = staged.first()
    opened = {p.name for p, column in gates.items() if row[column]}
    closed = {"backdoor_keyword", "sql_injection", "scheduled_task", "suspicious_domain", "dga_domain", "ipv4_address"}
    assert opened & closed == set() and closed <= {p.name for p in gates}
