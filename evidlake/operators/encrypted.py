"""Encrypted-file detection from extension and leading bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidlake.catalogs import lookups as L
from evidlake.functions.binary import latin1, le_number, starts_with_bytes
from evidlake.functions.paths import base_name, extension, under_any
from evidlake.functions.sizes import size_mb
from evidlake.functions.text import lookup
from evidlake.operators.locations import outside_listed_places

# A central-directory entry whose name is exactly one of the two encryption members.
ENCRYPTED_OFFICE = (
    r"(?s)PK\x01\x02.{24}\x0e\x00.{16}EncryptionInfo"
    r"|PK\x01\x02.{24}\x10\x00.{16}EncryptedPackage"
)


def has_encrypted_header(ext: Column, content: Column, pdf_prefix: int | None = None) -> Column:
    """The file says itself that it is protected.

    A PDF names its encryption mostly in the trailer, so the whole file is searched;
    ``pdf_prefix`` limits that to leading bytes.
    """
    zip_flag = (F.octet_length(content) >= 30) & (le_number(content, 6, 2).bitwiseAND(1) == 1)
    searched = content if pdf_prefix is None else F.substring(content, 1, pdf_prefix)
    pdf = F.contains(latin1(searched), F.lit("/Encrypt"))
    office = starts_with_bytes(content, "504b") & latin1(content).rlike(ENCRYPTED_OFFICE)
    hit = (
        F.when(ext == ".zip", zip_flag)
        .when(ext == ".7z", starts_with_bytes(content, "377abcaf271c"))
        .when(ext == ".pdf", pdf)
        .when(ext.isin(".docx", ".xlsx", ".pptx"), office)
    )
    return F.coalesce(hit, F.lit(False))


def scan_encrypted(
    files: DataFrame, platform: str | None = "linux", excluded: DataFrame | None = None
) -> DataFrame:
    """Encryption class of every scanned file (NULL class: not encrypted).

    Needs path, size and content. Optional boolean columns ``efs`` and ``filevault``
    carry attributes recorded at collection time. ``excluded`` is a table of further
    prefixes (column ``place``) whose files are not scanned.
    """
    path, ext = F.col("path"), F.col("extension")
    rows = files.filter(F.col("size") > 0)
    if platform:
        rows = rows.filter(~under_any(path, L.SYSTEM_PREFIXES[platform]))
    if excluded is not None:
        rows = outside_listed_places(rows, excluded)
    rows = rows.withColumn("extension", extension(path))
    label = lookup(L.ENCRYPTED_EXTENSIONS, ext)
    kind = (
        F.when(label.isNull(), F.lit(None).cast("string"))
        .when(has_encrypted_header(ext, F.col("content")), "password_protected")
        .when(ext.isin(L.CONTAINER_EXTENSIONS), "container")
        .when(ext.isin(L.ENCRYPTED_FORMATS), "encrypted_format")
    )
    for flag in ("filevault", "efs"):
        if flag in files.columns:
            kind = F.when(F.col(flag), flag).otherwise(kind)
    rows = rows.withColumn("encryption_class", kind)
    text = (
        F.when(F.col("encryption_class") == "efs", "Windows EFS")
        .when(F.col("encryption_class") == "filevault", "macOS FileVault/Encrypted DMG")
        .when(
            F.col("encryption_class") == "password_protected",
            F.concat(F.lit("Password-Protected "), label),
        )
        .when(F.col("encryption_class").isNotNull(), label)
    )
    return rows.withColumns(
        {
            "encryption_type": text,
            "filename": base_name(path),
            "size_mb": size_mb(F.col("size")),
        }
    ).drop("content")


def encrypted_files(scanned: DataFrame) -> DataFrame:
    return scanned.filter(F.col("encryption_class").isNotNull())


def encryption_stats(scanned: DataFrame) -> DataFrame:
    """Counters, risk score and level."""
    kind = F.col("encryption_class")
    stats = scanned.agg(
        F.count("*").alias("total_scanned"),
        F.count(kind).alias("encrypted_found"),
        F.count_if(kind == "efs").alias("efs_files"),
        F.count_if(kind == "filevault").alias("filevault_files"),
        F.count_if(kind == "password_protected").alias("password_protected"),
        F.count_if(kind == "container").alias("encrypted_containers"),
        F.count_if(kind == "encrypted_format").alias("encrypted_archives"),
    )
    return stats.withColumn("risk_score", encryption_risk()).withColumn(
        "risk_level", encryption_level(F.col("risk_score"))
    )


def encryption_risk() -> Column:
    return (
        F.when(F.col("efs_files") > 0, 20).otherwise(0)
        + F.when(F.col("encrypted_containers") > 0, 30).otherwise(0)
        + F.when(F.col("password_protected") > 10, 25).otherwise(0)
        + F.when(F.col("encrypted_found") > 50, 25).otherwise(0)
    )


def encryption_level(score: Column) -> Column:
    return (
        F.when(score > 70, "CRITICAL").when(score > 50, "HIGH").when(score > 30, "MEDIUM").otherwise("LOW")
    )
