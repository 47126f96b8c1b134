"""Case level: findings per file, notes, timeline, statistics, dashboard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidlake.catalogs import indicator_catalog
from evidlake.functions.paths import base_name
from evidlake.operators.joins import lookup_join
from evidlake.operators.scan import SEVERITIES, scan, severity_filter, summarize
from evidlake.session import materialize


def case_findings(
    evidence: DataFrame,
    case_id: str,
    severities: Sequence[str] | None = None,
    text: str = "text",
    hits_only: bool = True,
    ascii_classes: bool = False,
) -> DataFrame:
    """One row per evidence file with indicators. Score, level and counts come from the
    same findings that the severity filter leaves."""
    scanned = scan(evidence, indicator_catalog(), text, ascii_classes=ascii_classes)
    if severities:
        scanned = severity_filter(scanned, severities)
    rows = summarize(scanned)
    if hits_only:
        rows = rows.filter(F.col("total_iocs") > 0)
    label = F.coalesce("label", F.lit("Unlabeled"))
    return rows.withColumns(
        {"case_id": F.lit(case_id), "label": label, "file_name": base_name(F.col("path"))}
    )


def with_notes(findings: DataFrame, notes: DataFrame) -> DataFrame:
    """The newest note of each path; of equal times the last in order."""
    newest = notes.groupBy("path").agg(F.max_by("note", F.struct("ts", "note")).alias("notes"))
    return lookup_join(findings, newest, "path", "left", salts=1).withColumn(
        "notes", F.coalesce("notes", F.lit(""))
    )


def having_severity(findings: DataFrame, severities: Sequence[str]) -> DataFrame:
    hit = F.lit(False)
    for s in severities:
        hit = hit | (F.col(s.lower()) > 0)
    return findings.filter(hit)


def case_timeline(findings: DataFrame) -> DataFrame:
    """Findings by modification time, oldest first.

    A range-partitioned sort reads its input twice, first to sample it. The few columns
    it needs are written once, so the evidence is not scanned a second time.
    """
    rows = findings.select(
        F.col("mtime").alias("ts"),
        F.lit("File Modified").alias("event_type"),
        F.col("file_name").alias("file"),
        F.col("label").alias("evidence"),
        "threat_level",
        F.col("total_iocs").alias("iocs"),
    )
    return materialize(rows).orderBy("ts", "evidence", "file")


def case_totals(scanned_files: DataFrame) -> DataFrame:
    """Totals over all scanned files, those without findings included."""
    hit = F.col("total_iocs") > 0
    return scanned_files.agg(
        F.count("*").alias("total_files_scanned"),
        F.count_if(hit).alias("files_with_iocs"),
        F.sum("total_iocs").alias("total_iocs"),
        *[F.sum(s.lower()).alias(s.lower()) for s in SEVERITIES],
    )


def category_files(findings: DataFrame) -> DataFrame:
    """Files per category, most first."""
    return (
        findings.select(F.explode("categories").alias("category"))
        .groupBy("category")
        .agg(F.count("*").alias("files"))
        .orderBy(F.desc("files"), "category")
    )


def evidence_sources(findings: DataFrame) -> DataFrame:
    return findings.select("label").distinct()


def summary_table(findings: DataFrame) -> DataFrame:
    """The fifteen columns of the CSV summary."""
    return findings.select(
        F.col("case_id").alias("Case ID"),
        F.col("label").alias("Evidence Label"),
        F.col("file_name").alias("File Name"),
        F.col("path").alias("File Path"),
        F.col("size").alias("File Size"),
        F.col("mtime").alias("Modified Date"),
        F.col("threat_level").alias("Threat Level"),
        F.col("threat_score").alias("Threat Score"),
        F.col("total_iocs").alias("Total IOCs"),
        F.col("critical").alias("Critical"),
        F.col("high").alias("High"),
        F.col("medium").alias("Medium"),
        F.col("low").alias("Low"),
        F.concat_ws(", ", "categories").alias("Categories"),
        F.col("notes").alias("Investigator Notes"),
    )


def module_totals(totals: dict[str, DataFrame], alerts: dict[str, int] | None = None) -> DataFrame:
    """Dashboard rows (module, items, alert) from one-row totals per module."""
    out = None
    for module, df in totals.items():
        row = df.select(F.lit(module).alias("module"), F.col(df.columns[0]).cast("long").alias("items"))
        out = row if out is None else out.unionByName(row)
    limit = F.lit(None).cast("long")
    for module, value in (alerts or {}).items():
        limit = F.when(F.col("module") == module, F.lit(value)).otherwise(limit)
    return out.withColumns(
        {
            "active": F.col("items") > 0,
            "alert": F.coalesce(F.col("items") > limit, F.lit(False)),
        }
    )


def dashboard(modules: dict[str, DataFrame], alerts: dict[str, int] | None = None) -> DataFrame:
    """Items, activity and alert of each module from the rows it found.

    All rows go into one tall table (module, items) that is summed once: partial sums leave
    each task, whatever the number of modules. A module without rows has 0 items.
    """
    spark = next(iter(modules.values())).sparkSession
    tall = spark.createDataFrame([(name, 0) for name in modules], "module string, items long")
    for name, rows in modules.items():
        tall = tall.unionByName(rows.select(F.lit(name).alias("module"), F.lit(1).cast("long").alias("items")))
    limit = F.lit(None).cast("long")
    for name, most in (alerts or {}).items():
        limit = F.when(F.col("module") == name, F.lit(most)).otherwise(limit)
    return tall.groupBy("module").agg(F.sum("items").alias("items")).withColumns(
        {"active": F.col("items") > 0, "alert": F.coalesce(F.col("items") > limit, F.lit(False))}
    )


def activity_log(matches: dict[str, DataFrame]) -> DataFrame:
    """Rows found per analysis."""
    out = None
    for kind, df in matches.items():
        row = df.agg(F.count("*").alias("matches")).select(F.lit(kind).alias("type"), "matches")
        out = row if out is None else out.unionByName(row)
    return out


def modules_active(dashboard: DataFrame) -> DataFrame:
    return dashboard.agg(F.count_if(F.col("active")).alias("modules_active"))
