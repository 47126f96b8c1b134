"""Personal data, hashes, encryption, paths and sizes."""

import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from evidlake.functions import binary, paths, sizes
from evidlake.operators import encrypted, hashes, joins, pii


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_paths(spark):
    p = lambda s: F.lit(s)
    assert value(spark, paths.extension(p("C:\\a\\B.TXT"))) == ".txt"
    assert value(spark, paths.extension(p("/x/.bashrc"))) == ""
    assert value(spark, paths.extension(p("/x.y/none"))) == ""
    assert value(spark, paths.base_name(p("C:\\a\\b.c"))) == "b.c"
    assert value(spark, paths.parent_dir(p("C:\\a\\b.c"))) == "C:/a"
    assert value(spark, paths.parent_dir(p("b.c"))) == "Root"
    assert value(spark, paths.has_dir(p("/a/.git/x"), [".git"])) is True
    assert value(spark, paths.has_dir(p("/a/.git"), [".git"])) is False


@pytest.mark.parametrize(
    "n,text",
    [(0, "0 B"), (1023, "1023.00 B"), (1024, "1.00 KB"), (1048576, "1.00 MB"), (400_000, "390.62 KB"),
     (5 * 1024**4, "5.00 TB"), (5000 * 1024**4, "5000.00 TB")],
)
def test_human_size(spark, n, text):
    assert value(spark, sizes.human_size(F.lit(n))) == text


def test_size_variants(spark):
    assert value(spark, sizes.human_size(F.lit(2 * 1024**5), "PB")) == "2.00 PB"
    assert value(spark, sizes.short_size(F.lit(1000))) == "1000 B"
    assert value(spark, sizes.short_size(F.lit(1536))) == "1.5 KB"
    assert value(spark, sizes.size_mb(F.lit(1572864))) == 1.5


def test_binary_helpers(spark):
    data = F.lit(bytes([1, 2, 3, 255, 0, 0, 0, 0, 0]))
    assert value(spark, binary.le_number(data, 0, 4)) == int.from_bytes(bytes([1, 2, 3, 255]), "little")
    assert value(spark, binary.le_number(F.lit(b"\xff" * 8), 0, 8)) is None
    assert value(spark, binary.utf16_text(F.lit("a\u00e9".encode("utf-16le") + b"\0\0"))) == "a\u00e9"
    assert value(spark, binary.hex_dump(F.lit(b"\x01\xab"))) == "01 ab"
    assert value(spark, binary.is_text(F.lit(b"abc\n"))) is True
    assert value(spark, binary.is_text(F.lit(b"abc\x00"))) is False
    bits = F.lit(bytes([0b00000101]))
    got = [value(spark, binary.bit_is_set(bits, F.lit(i))) for i in (0, 1, 2, 7, 8, -1)]
    assert got == [True, False, True, False, True, True]


def test_memory_likeness(spark):
    varied = bytes(range(256)) * 4
    assert value(spark, binary.looks_like_memory(F.lit(varied))) is True
    assert value(spark, binary.looks_like_memory(F.lit(b"\0" * 1024))) is False
    assert value(spark, binary.looks_like_memory(F.lit(b"ab" * 600))) is False


FORM = "Name: x\nAddress: y\nPhone: z\n"


def pii_rows(spark, *texts, size=500, name="/case/letter.txt"):
    df = spark.createDataFrame([(f"{i}{name}", size, t) for i, t in enumerate(texts)], "path string, size long, text string")
    return {int(r.path.split("/")[0]): r for r in pii.pii_files(df).collect()}


def test_pii_scores(spark):
    got = pii_rows(
        spark,
        "write to a.b@example.com please, thanks",
        "write to a.b@example.com and c.d@example.com please",
        FORM + "078-05-1120 and a.b@example.com and ABCDE1234F invoice",
        "nothing to see here, move along please",
    )
    assert 0 not in got and 3 not in got
    assert (got[1].risk_score, got[1].investigative_score, got[1].priority) == (2, 2, "Low")
    # 4 + 1 + 5 points, three types, form words and an official word: capped at ten.
    assert (got[2].risk_score, got[2].investigative_score, got[2].risk_band) == (10, 10, "high")
    assert got[2].file_type == "text/plain"


def test_pii_low_value_files(spark):
    text = FORM + "078-05-1120 and a.b@example.com"
    for name in ("/Screenshot 2024-01-01 at 10.txt", "/capture12.txt", "/my_sample.txt", "/image 3.png"):
        assert pii_rows(spark, text, name=name) == {}
    assert pii_rows(spark, text, size=99) == {}
    assert len(pii_rows(spark, text, size=100)) == 1


def test_pii_short_text(spark):
    assert pii_rows(spark, "  a@bb.co 078-05-1120  ") == {}
    assert len(pii_rows(spark, "  a@bbb.co 078-05-1120  ")) == 1
    assert value(spark, pii.long_enough(F.lit(" " + "x" * 19 + " "), 20)) is False
    assert value(spark, pii.long_enough(F.lit(" " + "x" * 20 + " "), 20)) is True
    assert value(spark, pii.long_enough(F.lit("x" + "\n" * 18 + "y"), 20)) is True


def test_pii_values_are_masked(spark):
    df = spark.createDataFrame([("p", "call 078-05-1120")], "path string, text string")
    row = pii.pii_findings(pii.pii_scan(df)).first()
    assert row.value_masked == "0**-**-***0" and "value" not in row.asDict()
    assert row.value_hash == hashlib.sha256(b"078-05-1120").hexdigest()
    assert pii.pii_findings(pii.pii_scan(df), masked=False).first().value == "078-05-1120"


def test_pii_file_choice(spark):
    names = ["/u/a.txt", "/u/.git/a.txt", "/u/.hid.txt", "/u/~a.txt", "/u/AppData/a.txt", "/u/a.exe", "/u/b.csv"]
    df = spark.createDataFrame([(n, 10) for n in names], "path string, size long")
    assert sorted(r.path for r in pii.select_files(df).collect()) == ["/u/a.txt", "/u/b.csv"]
    big = spark.createDataFrame([("/u/a.txt", 51 * 2**20), ("/u/a.png", 6 * 2**20), ("/u/b.png", 2**20)], "path string, size long")
    limits = pii.PiiConfig(max_file_bytes=50 * 2**20, max_image_bytes=5 * 2**20)
    assert [r.path for r in pii.select_files(big, limits).collect()] == ["/u/b.png"]


def file_rows(spark, *items):
    return spark.createDataFrame(list(items), "path string, content binary")


def test_hashes(spark):
    data = b"evidence \xff\x00"
    row = hashes.hash_files(
        file_rows(spark, ("/a", data), ("/b", None)), algorithms=("md5", "sha1", "sha256", "sha512")
    ).orderBy("path").collect()
    for name in ("md5", "sha1", "sha256", "sha512"):
        assert row[0][name] == hashlib.new(name, data).hexdigest()
    assert row[0]["size"] == len(data) and row[0].error is None and row[1].error
    with pytest.raises(ValueError):
        hashes.digest(F.lit("x"), "crc32")


def test_known_bad_is_typed_by_length(spark):
    listed = spark.createDataFrame(
        [("md5", hashlib.md5(b"bad").hexdigest().upper(), "M", "CRITICAL"),
         ("sha256", hashlib.sha256(b"worse").hexdigest(), "S", "CRITICAL")],
        "algorithm string, hash string, threat string, severity string",
    )
    hashed = hashes.hash_files(file_rows(spark, ("/1", b"bad"), ("/2", b"worse"), ("/3", b"good")))
    found = {r.path: r.threat for r in hashes.known_bad(hashed, listed).collect()}
    assert found == {"/1": "M", "/2": "S"}
    kinds = {r.algorithm for r in hashes.known_bad_table(spark).collect()}
    assert kinds == {"md5", "sha256"}


def test_status_of_files_without_a_join_by_path(spark):
    listed = spark.createDataFrame(
        [("md5", hashlib.md5(b"bad").hexdigest().upper(), "M", "CRITICAL"),
         ("sha256", hashlib.sha256(b"bad").hexdigest(), "A", "CRITICAL"),
         ("sha256", hashlib.sha256(b"worse").hexdigest(), "S", "CRITICAL")],
        "algorithm string, hash string, threat string, severity string",
    )
    hashed = hashes.hash_files(
        file_rows(spark, ("/1", b"bad"), ("/2", b"worse"), ("/tmp/a.exe", b"good"), ("/4", None), ("/1", b"fine"))
    )
    done = hashes.classify(hashed, listed)
    assert sorted((r.path, r.status, r.threat or "") for r in done.collect()) == [
        ("/1", "clean", ""), ("/1", "malware", "A"), ("/2", "malware", "S"), ("/4", "clean", ""),
        ("/tmp/a.exe", "suspicious", ""),
    ]
    assert set(done.columns) == {*hashed.columns, "threat", "status"}


def test_duplicates_with_one_hot_content(spark):
    data = spark.range(3000).select(
        F.concat(F.lit("/f"), F.col("id")).alias("path"),
        F.when(F.col("id") < 1000, F.lit("same")).otherwise(F.col("id").cast("string")).alias("t"),
    ).withColumn("content", F.encode("t", "UTF-8"))
    hashed = hashes.hash_files(data.drop("t"))
    group = hashes.duplicate_groups(hashed).collect()
    assert [(g.copies, g.first_path) for g in group] == [(1000, "/f0")]
    assert hashes.duplicate_files(hashed).count() == 1000


def test_salted_lookup_equals_plain_join(spark):
    left = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"))
    right = spark.range(1500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain = sorted(tuple(r) for r in left.join(right, "k", "left").select("id", "k", "v").collect())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        salted = joins.lookup_join(left, right, "k", "left", salts=4)
        assert "BroadcastHashJoin" not in salted._jdf.queryExecution().executedPlan().toString()
        assert sorted(tuple(r) for r in salted.select("id", "k", "v").collect()) == plain
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_top_per_group_cuts_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    top = joins.top_per_group(df, ["g"], [F.desc("id")], 2)
    assert top.count() == 6
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def office(member):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", "EncryptionInfo is only text here")
        z.writestr(member, "x")
    return buffer.getvalue()


def locked_zip(flag):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a.txt", "data" * 20)
    raw = bytearray(buffer.getvalue())
    raw[6] = flag
    return bytes(raw)


ENCRYPTED = [
    ("/u/a.zip", locked_zip(1), "password_protected"),
    ("/u/b.zip", locked_zip(0), None),
    ("/u/a.7z", b"7z\xbc\xaf\x27\x1c" + b"0" * 30, "password_protected"),
    ("/u/b.7z", b"other", "encrypted_format"),
    ("/u/a.pdf", b"%PDF" + b" " * 1000 + b"/Encrypt", "password_protected"),
    ("/u/b.pdf", b"%PDF" + b" " * 5000 + b"/Encrypt", "password_protected"),
    ("/u/a.docx", office("EncryptionInfo"), "password_protected"),
    ("/u/b.docx", office("word/other.xml"), None),
    ("/u/c.xlsx", office("EncryptedPackage"), "password_protected"),
    ("/u/a.hc", b"zzz", "container"),
    ("/u/a.KDBX", b"zzz", "encrypted_format"),
    ("/u/empty.hc", b"", "skipped"),
    ("/usr/share/a.hc", b"zzz", "skipped"),
    ("/u/a.rar", b"Rar!", None),
]


def test_encryption_classes(spark):
    df = file_rows(spark, *[(p, c) for p, c, _ in ENCRYPTED]).withColumn("size", F.octet_length("content").cast("long"))
    got = {r.path: r for r in encrypted.scan_encrypted(df).collect()}
    for path, _, kind in ENCRYPTED:
        if kind == "skipped":
            assert path not in got
        else:
            assert got[path].encryption_class == kind, path
    assert got["/u/a.zip"].encryption_type == "Password-Protected Potentially Encrypted ZIP"
    assert got["/u/a.hc"].encryption_type == "VeraCrypt Container"


@pytest.mark.parametrize(
    "efs,containers,protected,found,score,level",
    [(0, 1, 0, 0, 30, "LOW"), (1, 0, 11, 0, 45, "MEDIUM"), (0, 0, 11, 51, 50, "MEDIUM"),
     (0, 1, 11, 0, 55, "HIGH"), (1, 0, 11, 51, 70, "HIGH"), (1, 1, 11, 0, 75, "CRITICAL"), (0, 0, 10, 50, 0, "LOW")],
)
def test_encryption_risk(spark, efs, containers, protected, found, score, level):
    df = spark.createDataFrame(
        [(efs, containers, protected, found)],
        "efs_files int, encrypted_containers int, password_protected int, encrypted_found int",
    ).withColumn("s", encrypted.encryption_risk())
    row = df.withColumn("l", encrypted.encryption_level(F.col("s"))).first()
    assert (row.s, row.l) == (score, level)


def test_size_limits_are_off_and_listed_when_set(spark):
    df = spark.createDataFrame(
        [("/u/a.txt", 60 << 20), ("/u/b.jpg", 6 << 20), ("/u/c.mp4", 1 << 40), ("/u/d.txt", 10)], "path string, size long"
    )
    assert pii.select_files(df).count() == 4
    config = pii.PiiConfig(max_file_bytes=50 << 20, max_image_bytes=5 << 20)
    assert pii.select_files(df, config).count() == 1
    assert {(r.path, r.reason) for r in pii.oversized(df, config).collect()} == {
        ("/u/a.txt", "max_file_bytes"), ("/u/b.jpg", "max_image_bytes"), ("/u/c.mp4", "max_file_bytes")
    }
