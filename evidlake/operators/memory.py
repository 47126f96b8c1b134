"""Captured memory, process and device text to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidlake.catalogs import lookups as L
from evidlake.functions.sizes import human_size
from evidlake.functions.text import lookup
from evidlake.operators.joins import top_per_group

DISK_SCHEMA = "number int, name string, bus string, size long, is_readonly string"
PNP_SCHEMA = "name string, instance_id string, status string"
PROCESS_JSON = (
    "array<struct<Name:string,Id:long,WorkingSet64:long,VirtualMemorySize64:long,"
    "CPU:double,PagedMemorySize64:long>>"
)


def _lines(df: DataFrame, text: str = "output") -> DataFrame:
    keep = [c for c in df.columns if c != text]
    body = F.regexp_replace(F.col(text), "\r\n?", "\n")
    return df.select(*keep, F.posexplode(F.split(body, "\n")).alias("line_no", "line"))


def _long(text: Column) -> Column:
    return text.try_cast("bigint")


def meminfo(outputs: DataFrame) -> DataFrame:
    """``/proc/meminfo`` lines as bytes."""
    pattern = r"^\s*(\S+?):*\s+(\d+)"
    line = F.col("line")
    rows = _lines(outputs).filter(line.rlike(pattern))
    return rows.select(
        "host",
        F.regexp_extract(line, pattern, 1).alias("key"),
        (_long(F.regexp_extract(line, pattern, 2)) * 1024).alias("bytes"),
    )


def memory_summary(outputs: DataFrame) -> DataFrame:
    """Totals of each captured ``/proc/meminfo``, read inside its own row."""

    def value(key: str) -> Column:
        hit = F.regexp_extract(F.col("output"), rf"(?m)^\s*{key}:\s+(\d+)", 1)
        return _long(F.nullif(hit, F.lit(""))) * 1024

    zero = F.lit(0).cast("long")
    total = F.coalesce(value("MemTotal"), zero)
    free = F.coalesce(value("MemAvailable"), value("MemFree"), zero)
    return outputs.select(
        "host",
        total.alias("total"),
        free.alias("available"),
        (total - free).alias("used"),
        F.coalesce(value("SwapTotal"), zero).alias("swap_total"),
        F.coalesce(value("SwapFree"), zero).alias("swap_free"),
        F.coalesce(value("Buffers"), zero).alias("buffers"),
        F.coalesce(value("Cached"), zero).alias("cached"),
        human_size(total, zero=None).alias("total_human"),
    )


def ram_ranges(outputs: DataFrame) -> DataFrame:
    """Top-level ``System RAM`` ranges of ``/proc/iomem``; zeroed ranges are left out."""
    pattern = r"^([0-9A-Fa-f]+)-([0-9A-Fa-f]+)\s*:.*System RAM"
    line = F.col("line")
    rows = _lines(outputs).filter(line.rlike(pattern))
    number = lambda i: _long(F.conv(F.regexp_extract(line, pattern, i), 16, 10))
    rows = rows.select("host", number(1).alias("start"), number(2).alias("end"))
    return rows.filter((F.col("start") != 0) | (F.col("end") != 0)).withColumn(
        "size", F.col("end") - F.col("start") + 1
    )


def ram_totals(ranges: DataFrame) -> DataFrame:
    return ranges.groupBy("host").agg(
        F.count("*").alias("ranges"), F.sum("size").alias("total_ram")
    )


def processes(outputs: DataFrame) -> DataFrame:
    """``ps aux`` lines: eleven fields, the last one with its spaces."""
    pattern = r"^\s*" + r"(\S+)\s+" * 10 + r"(.*?)\s*$"
    line = F.col("line")
    part = lambda i: F.regexp_extract(line, pattern, i)
    count = lambda i: F.coalesce(_long(part(i)), F.lit(0).cast("long"))
    rows = _lines(outputs).filter((F.col("line_no") > 0) & line.rlike(pattern))
    return rows.select(
        "host",
        part(1).alias("user"),
        _long(part(2)).alias("pid"),
        part(3).try_cast("double").alias("cpu_pct"),
        part(4).try_cast("double").alias("mem_pct"),
        count(5).alias("vsz_kb"),
        count(6).alias("rss_kb"),
        part(11).alias("command"),
    )


def windows_processes(outputs: DataFrame) -> DataFrame:
    """Processes from captured JSON: one object or an array of them."""
    text = F.trim("output")
    items = F.when(F.startswith(text, F.lit("{")), F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
    rows = outputs.select("host", F.explode(F.from_json(items, PROCESS_JSON)).alias("p"))
    zero = F.lit(0).cast("long")
    return rows.select(
        "host",
        F.coalesce("p.Name", F.lit("?")).alias("name"),
        F.col("p.Id").alias("pid"),
        F.coalesce("p.WorkingSet64", zero).alias("working_set"),
        F.coalesce("p.VirtualMemorySize64", zero).alias("virtual_memory"),
        F.coalesce("p.CPU", F.lit(0.0)).alias("cpu"),
        F.coalesce("p.PagedMemorySize64", zero).alias("paged_memory"),
    )


def top_processes(rows: DataFrame, n: int = 20, by: str = "rss_kb") -> DataFrame:
    """The n largest processes of each host."""
    return top_per_group(rows, ["host"], [F.desc(by), "pid"], n)


def processes_in_temp(rows: DataFrame) -> DataFrame:
    """Programs running from /tmp, /var/tmp or /dev."""
    return rows.filter(F.col("command").rlike(r"^(?:/tmp|/var/tmp|/dev)/"))


def vm_statistics(outputs: DataFrame, page_size: int = 4096) -> DataFrame:
    """``vm_stat`` counters as pages and bytes."""
    pattern = r"^\s*([^:]*?)\s*:\s*(\d+)\.*\s*$"
    line = F.col("line")
    pages = _long(F.regexp_extract(line, pattern, 2))
    return _lines(outputs).filter(line.rlike(pattern)).select(
        "host",
        F.regexp_extract(line, pattern, 1).alias("key"),
        pages.alias("pages"),
        (pages * page_size).alias("bytes"),
    )


def csv_rows(outputs: DataFrame, schema: str) -> DataFrame:
    """Captured CSV without its header line."""
    rows = _lines(outputs).filter((F.col("line_no") > 0) & (F.trim("line") != ""))
    return rows.select("host", F.from_csv("line", schema).alias("r")).select("host", "r.*")


def usb_disks(outputs: DataFrame) -> DataFrame:
    rows = csv_rows(outputs, DISK_SCHEMA).filter(F.col("number").isNotNull())
    return rows.select(
        "host", "number", "name", "bus",
        F.round(F.coalesce("size", F.lit(0)) / F.lit(float(1024**3)), 2).alias("size_gb"),
        (F.lower("is_readonly") == "true").alias("is_readonly"),
    )


def pnp_devices(outputs: DataFrame) -> DataFrame:
    return csv_rows(outputs, PNP_SCHEMA)


def memory_pressure(level: Column) -> Column:
    return F.when(level > 50, "Normal").when(level > 20, "Warning").otherwise("Critical")


def crash_dump_type(code: Column) -> Column:
    return lookup(L.CRASH_DUMP_TYPES, code, F.lit("Unknown"))


def dump_kind(path: Column) -> Column:
    """Full dump or minidump by where the file is."""
    low = F.lower(path)
    return (
        F.when(F.endswith(low, F.lit("\\memory.dmp")), "Full Memory Dump")
        .when(low.rlike(r"\\minidump\\[^\\]*\.dmp$"), "Minidump")
    )


def lockdown_level(text: Column) -> Column:
    bare = F.trim(text)
    out = bare
    for level in ("none", "integrity", "confidentiality"):
        out = F.when(F.contains(bare, F.lit(f"[{level}]")), level).otherwise(out)
    return F.coalesce(out, F.lit("unknown"))


def symbols_note(first_line: Column) -> Column:
    hidden = F.startswith(first_line, F.lit("0000000000000000"))
    return F.when(hidden, "Symbols hidden (non-root or KASLR active)").otherwise("Kernel symbols visible")


def usable_sources(sources: DataFrame) -> DataFrame:
    return sources.agg(F.count_if("usable").alias("usable_sources"))
