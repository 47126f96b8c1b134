"""Writing results: JSON, CSV and curated Parquet tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from evidlake.operators import case, hashes, mft, scan


def write_case(
    evidence: DataFrame, case_id: str, path: str, severities: Sequence[str] | None = None,
    notes: DataFrame | None = None, text: str = "text",
) -> dict[str, int]:
    """A whole case in one pass over its evidence; returns the case's totals.

    The evidence is scanned once, into ``path/files`` (one Parquet row per file, those
    without findings too), and the totals are observed while it is written. Every other
    table is made from ``files``, which holds no texts: findings and case metadata as JSON,
    the summary as CSV, indicator rows as CSV, and the tables of a report: categories,
    severities, sources and timeline.
    """
    spark = evidence.sparkSession
    hit = F.col("total_iocs") > 0
    names = [s.lower() for s in scan.SEVERITIES]
    seen = Observation("case")
    rows = case.case_findings(evidence, case_id, severities, text, hits_only=False).observe(
        seen,
        F.count(F.lit(1)).alias("total_files_scanned"),
        F.count(F.when(hit, 1)).alias("files_with_iocs"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total_iocs", *names)],
    )
    rows.write.mode("overwrite").parquet(f"{path}/files")
    totals = seen.get
    files = spark.read.schema(rows.schema).parquet(f"{path}/files")
    found = files.filter(hit)
    noted = case.with_notes(found, notes) if notes is not None else found.withColumn("notes", F.lit(""))
    metadata = spark.createDataFrame([{"case_id": case_id, **totals}])
    write_case_json(noted, metadata, path)
    write_summary_csv(noted, f"{path}/summary")
    write_indicator_csv(scan.explode_findings(found), f"{path}/indicators")
    tables = {
        "categories": case.category_files(found), "severities": scan.by_severity(found),
        "sources": case.evidence_sources(found), "timeline": case.case_timeline(found),
    }
    write_report_tables(tables, f"{path}/report")
    return totals


def write_case_json(findings: DataFrame, totals: DataFrame, path: str) -> None:
    """Case totals and all findings, each as its own JSON table."""
    totals.write.mode("overwrite").json(f"{path}/case_metadata")
    findings.write.mode("overwrite").json(f"{path}/findings")


def write_summary_csv(findings: DataFrame, path: str) -> None:
    case.summary_table(findings).write.mode("overwrite").option("header", "true").csv(path)


def write_hash_database(hash_rows: DataFrame, path: str) -> None:
    hash_rows.write.mode("overwrite").json(path)


def write_file_hashes(hash_rows: DataFrame, path: str) -> None:
    hashes.unpivot(hash_rows).write.mode("overwrite").option("header", "true").csv(path)


def indicator_rows(tall_findings: DataFrame) -> DataFrame:
    """Type, Value, File, Severity: one row per match."""
    return tall_findings.select(
        F.col("name").alias("Type"),
        F.explode("matches").alias("Value"),
        F.col("path").alias("File"),
        F.col("severity").alias("Severity"),
    )


def write_indicator_csv(tall_findings: DataFrame, path: str) -> None:
    indicator_rows(tall_findings).write.mode("overwrite").option("header", "true").csv(path)


def write_entry_metadata(with_path: DataFrame, path: str) -> None:
    mft.entry_metadata(with_path).write.mode("overwrite").json(path)


def write_report_tables(tables: dict[str, DataFrame], path: str) -> None:
    """The tables behind a report, one Parquet table each."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
