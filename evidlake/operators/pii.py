"""Personal data in texts: findings, scores and review thresholds."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidlake.catalogs import lookups as L
from evidlake.catalogs import patterns, personal_catalog
from evidlake.functions.paths import base_name, extension, has_dir, unix_path
from evidlake.functions.rows import once
from evidlake.functions.text import any_contains, count_contains, java_regex, lookup
from evidlake.operators.scan import band, categories, count_of, scan, total_matches


@dataclass(frozen=True)
class PiiConfig:
    #: Size limits are off; ``oversized`` lists what limits that are set leave out.
    max_file_bytes: int | None = None
    max_image_bytes: int | None = None
    max_video_bytes: int | None = None
    min_file_bytes: int = 100
    min_text_chars: int = 20
    min_risk: int = 2
    min_findings: int = 1
    min_investigative: int = 1
    skip_low_value: bool = True
    scan_hidden: bool = False
    scan_system_dirs: bool = False
    preview_chars: int = 500
    excluded_dirs: tuple = field(default=tuple(L.EXCLUDED_DIRS))


def supported_extensions() -> list[str]:
    return sorted({e for group in L.SCAN_EXTENSIONS.values() for e in group})


def select_files(files: DataFrame, config: PiiConfig = PiiConfig()) -> DataFrame:
    """Files worth opening, by path and size only (the content column is not read)."""
    path, name = F.col("path"), base_name(F.col("path"))
    ext = extension(path)
    keep = ext.isin(supported_extensions())
    keep = keep & ~has_dir(path, list(config.excluded_dirs))
    keep = keep & ~F.startswith(name, F.lit("~")) & ~F.endswith(name, F.lit(".tmp"))
    if not config.scan_system_dirs:
        keep = keep & ~has_dir(path, L.SYSTEM_DIRS)
    if not config.scan_hidden:
        keep = keep & ~unix_path(path).rlike(r"(^|/)\.[^/.]")
    return files.filter(keep & size_reason(ext, config).isNull())


def size_reason(ext: Column, config: PiiConfig) -> Column:
    """The limit that a file is over, NULL if it is over none that is set."""
    reason = F.lit(None).cast("string")
    for name, limit, kind in (
        ("max_file_bytes", config.max_file_bytes, None),
        ("max_image_bytes", config.max_image_bytes, "image"),
        ("max_video_bytes", config.max_video_bytes, "video"),
    ):
        if limit is not None:
            over = F.col("size") > limit
            over = over & ext.isin(L.SCAN_EXTENSIONS[kind]) if kind else over
            reason = F.when(over, F.lit(name)).otherwise(reason)
    return reason


def oversized(files: DataFrame, config: PiiConfig) -> DataFrame:
    """Files that the size limits leave out, with the limit as ``reason``."""
    return files.withColumn("reason", size_reason(extension(F.col("path")), config)).filter("reason IS NOT NULL")


def is_low_value(path: Column, size: Column, min_bytes: int = 100) -> Column:
    """Screenshots, captures, test files and very small files."""
    name = F.lower(base_name(path))
    hit = F.contains(name, F.lit("screenshot")) & any_contains(name, L.SCREENSHOT_NAME_WORDS)
    for regex in patterns.CAPTURE_NAMES:
        hit = hit | name.rlike(java_regex(regex))
    return hit | any_contains(name, L.TEST_NAME_WORDS) | (size < min_bytes)


def file_type(path: Column) -> Column:
    """MIME type by extension, else the category, else Unknown."""
    category = {e: c.title() for c, group in reversed(L.SCAN_EXTENSIONS.items()) for e in group}
    ext = extension(path)
    return lookup(L.MIME_TYPES, ext, lookup(category, ext, F.lit("Unknown")))


def risk_score(findings: str = "findings") -> Column:
    return F.aggregate(
        F.col(findings), F.lit(0).cast("long"), lambda acc, f: acc + count_of(f) * f["weight"]
    )


def investigative_score(lowered: Column, name: Column, findings: str = "findings") -> Column:
    """0 to 10: points per value, more for several types, form words and official words
    (``lowered`` is the text in lower case)."""
    points = F.aggregate(
        F.col(findings),
        F.lit(0).cast("long"),
        lambda acc, f: acc
        + count_of(f) * lookup(L.INVESTIGATIVE_POINTS, f["name"], F.lit(0)),
    )
    types = F.size(findings)
    variety = F.when(types >= 3, 2).when(types >= 2, 1).otherwise(0)
    words = count_contains(lowered, L.FORM_WORDS)
    form = F.when(words >= 3, 2).when(words >= 2, 1).otherwise(0)
    official = any_contains(lowered, L.OFFICIAL_WORDS) | any_contains(F.lower(name), L.OFFICIAL_WORDS)
    return F.least(points + variety + form + official.cast("int"), F.lit(10))


def long_enough(text: Column, chars: int) -> Column:
    """The text has at least this many characters between its outer white space."""
    return text.rlike(rf"(?sU)\S.{{{max(chars - 2, 0)},}}\S")


def pii_scan(texts: DataFrame, text: str = "text", ascii_classes: bool = False) -> DataFrame:
    return scan(texts, personal_catalog(), text, ascii_classes=ascii_classes)


def pii_findings(scanned: DataFrame, masked: bool = True) -> DataFrame:
    """One row per value found.

    Values are personal data. By default a row carries the SHA-256 of the value and a
    masked form that keeps its first and last character; ``masked=False`` adds the value.
    """
    keep = [c for c in scanned.columns if c != "findings"]
    rows = scanned.select(*keep, F.inline_outer("findings")).filter(F.col("name").isNotNull())
    rows = rows.withColumn("value", F.explode("matches")).drop("matches")
    rows = rows.withColumnRenamed("name", "type").withColumnRenamed("weight", "points")
    rows = rows.withColumn("value_hash", F.sha2("value", 256))
    shape = F.regexp_replace(F.expr("substring(value, 2, length(value) - 2)"), "[\\p{L}\\p{Nd}]", "*")
    rows = rows.withColumn(
        "value_masked", F.concat(F.substring("value", 1, 1), shape, F.expr("right(value, 1)"))
    )
    return rows.drop("value") if masked else rows


def pii_files(
    texts: DataFrame, config: PiiConfig = PiiConfig(), text: str = "text", ascii_classes: bool = False
) -> DataFrame:
    """Files worth an investigator's time (columns path, size and the text)."""
    path = F.col("path")
    rows = texts.filter(long_enough(F.col(text), config.min_text_chars))
    if config.skip_low_value:
        rows = rows.filter(~is_low_value(path, F.col("size"), config.min_file_bytes))
    scanned = scan(rows, personal_catalog(), text, keep_text=True, ascii_classes=ascii_classes)
    if config.min_findings > 0:
        # Most texts hold nothing personal; they need no score.
        scanned = scanned.filter(F.size("findings") > 0)
    scanned = scanned.withColumn("_lower", F.lower(F.col(text)))
    preview = F.when(
        F.length(text) > config.preview_chars,
        F.concat(F.substring(text, 1, config.preview_chars), F.lit("...")),
    ).otherwise(F.col(text))
    keep = [c for c in texts.columns if c != text]
    scored = once(
        scanned,
        [*keep, "findings"],
        {
            "risk_score": risk_score(),
            "items": total_matches(),
            "investigative_score": investigative_score(F.col("_lower"), base_name(path)),
            "categories": categories(),
            "text_preview": preview,
        },
    )
    return (
        scored.filter(F.col("risk_score") >= config.min_risk)
        .filter(F.col("items") >= config.min_findings)
        .filter(F.col("investigative_score") >= config.min_investigative)
        .withColumn("priority", priority(F.col("investigative_score")))
        .withColumn("risk_band", risk_band(F.col("risk_score")))
        .withColumn("file_type", file_type(path))
    )


def priority(score: Column) -> Column:
    return band(score, [(7, "Critical"), (5, "High"), (3, "Medium")], "Low")


def risk_band(score: Column) -> Column:
    return band(score, [(8, "high"), (5, "medium")], "low")


def pii_summary(files: DataFrame) -> DataFrame:
    return files.agg(
        F.count("*").alias("files_with_pii"),
        F.coalesce(F.sum("items"), F.lit(0)).alias("pii_items"),
        F.count_if(F.col("risk_score") >= 8).alias("high_risk_files"),
    )


def examples_per_category(findings: DataFrame, n: int = 3) -> DataFrame:
    """First n findings of each category of each file; groups are single files."""
    from evidlake.operators.joins import top_per_group

    return top_per_group(findings, ["path", "category"], ["type", "value_hash"], n)
