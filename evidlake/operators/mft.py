"""File-system record analytics: paths, anomalies, counters, timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidlake.catalogs import lookups as L
from evidlake.functions.sizes import human_size
from evidlake.functions.text import any_contains
from evidlake.functions.times import display
from evidlake.operators.joins import lookup_join
from evidlake.session import materialize_observed

ROOT_ENTRY = 5
BIG_FILE = 10 * 1024 * 1024


def _join_path(parent: Column, name: Column) -> Column:
    slash = F.when(F.endswith(parent, F.lit("\\")), F.lit("")).otherwise(F.lit("\\"))
    return F.concat(parent, slash, name)


def directory_paths(records: DataFrame) -> DataFrame:
    """Full path of every record that is the parent of another one.

    Only parents take part in the iteration; files never do. Each pass joins every
    unfinished directory to the directory its pointer names and takes over that one's
    pointer, so the distance covered doubles: a tree n levels deep needs log2(n)
    passes. A pass that finishes nothing means the rest hangs on a missing record or
    a cycle. Of repeated records of one entry (two copies of a volume) the least counts,
    so repeats do not multiply from pass to pass. Each pass is one write to the shared
    checkpoint folder, which counts what it finished on the way, so lineage stays short and
    a lost executor does not restart the loop.
    """
    key = ["volume", "entry_number"]
    parents = records.select("volume", F.col("parent_reference").alias("entry_number")).distinct()
    root = F.col("entry_number") == ROOT_ENTRY
    count = F.count_if("done")
    state, seen = materialize_observed(
        records.select("volume", "entry_number", "parent_reference", "filename")
        .join(parents, key, "left_semi")
        .groupBy(*key).agg(F.min(F.struct("parent_reference", "filename")).alias("r"))
        .select(*key, "r.*")
        .select(
            *key,
            F.col("parent_reference").alias("pointer"),
            F.when(root, F.concat("volume", F.lit("\\"))).otherwise(F.col("filename")).alias("path"),
            root.alias("done"),
        ),
        done=count,
        left=F.count_if(~F.col("done")),
    )
    while seen["left"]:
        finished = seen["done"]
        target = state.select(
            "volume",
            F.col("entry_number").alias("pointer"),
            F.col("pointer").alias("next_pointer"),
            F.col("path").alias("target_path"),
            F.col("done").alias("target_done"),
        )
        moved = lookup_join(
            state.filter("NOT done"), target, ["volume", "pointer"], "inner", spread=key
        ).select(
            *key,
            F.col("next_pointer").alias("pointer"),
            _join_path(F.col("target_path"), F.col("path")).alias("path"),
            F.col("target_done").alias("done"),
        )
        state, seen = materialize_observed(
            state.filter("done").unionByName(moved), done=count, left=F.count_if(~F.col("done"))
        )
        if seen["done"] == finished:
            break
    return state.filter("done").select(*key, "path")


def with_paths(records: DataFrame) -> DataFrame:
    """Add full_path and is_orphan. A directory may hold a third of all records: the
    final join to its parent's path salts the records of hot parents."""
    parent = directory_paths(records).select(
        "volume", F.col("entry_number").alias("parent_reference"), F.col("path").alias("parent_path")
    )
    joined = lookup_join(
        records, parent, ["volume", "parent_reference"], "left", spread=["entry_number"]
    )
    named = F.coalesce("filename", F.lit("")) != ""
    root = F.col("entry_number") == ROOT_ENTRY
    path = (
        F.when(root, F.concat("volume", F.lit("\\")))
        .when(F.col("parent_path").isNotNull(), _join_path(F.col("parent_path"), F.col("filename")))
        .when(named, F.concat("volume", F.lit("\\[ORPHANED]\\"), "filename"))
    )
    orphan = ~root & F.col("parent_path").isNull() & named
    return joined.withColumns({"full_path": path, "is_orphan": orphan}).drop("parent_path")


def is_timestomped() -> Column:
    """Standard and name times differ by more than one second."""

    def apart(a: str, b: str) -> Column:
        gap = F.abs(F.unix_micros(F.col(a)) - F.unix_micros(F.col(b)))
        return F.coalesce(gap > 1_000_000, F.lit(False))

    return apart("si_created", "fn_created") | apart("si_modified", "fn_modified")


def recoverability() -> Column:
    """Of a deleted file, by where its data is."""
    return (
        F.when(F.col("is_resident"), "FULL")
        .when(F.size("data_runs") > 0, "PARTIAL")
        .otherwise("METADATA_ONLY")
    )


def in_hiding_place() -> Column:
    place = any_contains(F.lower(F.coalesce("full_path", F.lit(""))), L.HIDING_PLACES)
    return place & (F.col("logical_size") > BIG_FILE)


def has_ads() -> Column:
    return F.size(F.coalesce("ads_streams", F.array().cast("array<string>"))) > 0


def anomaly_flags(as_of: Column | None = None) -> Column:
    """Names of everything odd about a record, in a fixed order."""
    flags = [
        F.when(is_timestomped(), "TIMESTOMPED"),
        F.when(has_ads(), "HIDDEN_ADS"),
        F.when(F.col("is_orphan"), "ORPHANED"),
        F.when(in_hiding_place(), "SUSPICIOUS_PATH"),
    ]
    if as_of is not None:
        age = F.unix_micros(as_of) - F.unix_micros("si_modified")
        flags.append(F.when(F.col("is_deleted") & (age < 60_000_000), "RECENTLY_DELETED"))
    return F.array_compact(F.array(*flags))


def anomalies(with_path: DataFrame) -> DataFrame:
    """One row per record and anomaly."""
    kinds = F.array_compact(
        F.array(
            F.when(is_timestomped(), _kind("timestomped", "HIGH")),
            F.when(has_ads(), _kind("hidden_ads", "MEDIUM")),
            F.when(F.col("is_orphan"), _kind("orphaned_files", "LOW")),
            F.when(in_hiding_place(), _kind("suspicious_paths", "LOW")),
        )
    )
    return with_path.select(
        F.inline_outer(kinds), "volume", "entry_number", "filename", "full_path", "ads_streams",
        "logical_size",
    ).filter(F.col("kind").isNotNull())


def _kind(kind: str, severity: str) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"))


def deleted_files(with_path: DataFrame) -> DataFrame:
    return with_path.filter("is_deleted").withColumn("recoverability", recoverability())


def statistics(with_path: DataFrame) -> DataFrame:
    """All counters in one pass."""
    deleted, where = F.col("is_deleted"), recoverability()
    ads = F.size(F.coalesce("ads_streams", F.array().cast("array<string>")))
    return with_path.agg(
        F.count("*").alias("total_entries"),
        F.count_if("is_directory").alias("directories"),
        F.count_if(~F.col("is_directory")).alias("files"),
        F.coalesce(F.sum(ads), F.lit(0)).cast("long").alias("ads_detected"),
        F.count_if(is_timestomped()).alias("timestomped_files"),
        F.count_if(~deleted).alias("active_entries"),
        F.count_if(deleted).alias("deleted_entries"),
        F.count_if(deleted & (where == "FULL")).alias("recoverable_files"),
        F.count_if(deleted & (where == "PARTIAL")).alias("partially_recoverable"),
        F.count_if(deleted & (where == "METADATA_ONLY")).alias("non_recoverable"),
        F.count_if("is_orphan").alias("orphaned_files"),
    )


def deletion_timeline(with_path: DataFrame, n: int | None = 100) -> DataFrame:
    """Deleted files with a valid time, newest first; sorted before it is cut."""
    rows = (
        deleted_files(with_path)
        .filter(F.col("si_modified").isNotNull())
        .select(
            F.col("si_modified").alias("ts"),
            F.lit("File Deleted").alias("event"),
            "volume", "entry_number", "filename",
            F.col("full_path").alias("path"),
            F.col("logical_size").alias("size"),
            "recoverability",
        )
        .orderBy(F.desc("ts"), "volume", "entry_number")
    )
    return rows if n is None else rows.limit(n)


def age_bucket(as_of: Column, modified: Column) -> Column:
    """Whole days since the last change, in six buckets."""
    micros = F.unix_micros(as_of) - F.unix_micros(modified)
    days = F.floor(micros / F.lit(86_400_000_000))
    return (
        F.when(days.isNull(), "old")
        .when(days == 0, "today")
        .when(days <= 7, "week")
        .when(days <= 30, "month")
        .when(days <= 90, "quarter")
        .when(days <= 180, "half")
        .otherwise("old")
    )


def deleted_report(
    with_path: DataFrame, as_of: Column, n: int | None = 500, age: str | None = None, status: str | None = None
) -> DataFrame:
    """Deleted files, newest first and unknown times last.

    ``age`` and ``status`` choose files before the first ``n`` are taken.
    """
    rows = deleted_files(with_path).select(
        "volume", "entry_number",
        F.coalesce(F.nullif(F.col("filename"), F.lit("")), F.lit("[No Name]")).alias("filename"),
        F.coalesce("full_path", F.lit("[Unknown]")).alias("path"),
        human_size(F.col("logical_size")).alias("size"),
        display(F.col("si_modified")).alias("modified"),
        "recoverability",
        age_bucket(as_of, F.col("si_modified")).alias("age"),
        "si_modified",
    )
    rows = filter_deleted(rows, age, status).orderBy(F.desc_nulls_last("si_modified"), "volume", "entry_number")
    return (rows if n is None else rows.limit(n)).drop("si_modified")


def filter_deleted(report: DataFrame, age: str | None = None, status: str | None = None):
    if age:
        report = report.filter(F.col("age") == age)
    if status:
        report = report.filter(F.col("recoverability") == status)
    return report


def entry_metadata(with_path: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Nested export of each entry."""
    status = F.when(F.col("is_deleted"), recoverability()).otherwise("UNKNOWN")
    return with_path.select(
        "volume", "entry_number", "filename", "full_path",
        F.col("logical_size").alias("file_size"),
        human_size(F.col("logical_size")).alias("file_size_formatted"),
        "is_deleted", "is_directory", "is_resident",
        status.alias("recoverability"),
        F.struct(
            display(F.col("si_created")).alias("created"),
            display(F.col("si_modified")).alias("modified"),
            display(F.col("si_accessed")).alias("accessed"),
            display(F.col("si_mft_modified")).alias("mft_modified"),
        ).alias("timestamps"),
        F.struct(
            is_timestomped().alias("is_timestomped"),
            has_ads().alias("has_ads"),
            "ads_streams",
            anomaly_flags(as_of).alias("flags"),
        ).alias("anomalies"),
        F.struct(
            "sequence_number", "parent_reference", "parent_sequence", "data_runs", "physical_size",
            human_size(F.col("physical_size")).alias("physical_size_formatted"),
        ).alias("technical"),
    )
