"""Content hashes, known-bad lookup, duplicates and risky files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidlake.catalogs import lookups as L
from evidlake.functions.paths import base_name, extension, in_risky_place, parent_dir
from evidlake.operators.joins import lookup_join, top_per_group
from evidlake.operators.locations import in_listed_places
from evidlake.session import materialize

HASHES = ["md5", "sha1", "sha256", "sha512"]


def digest(content: Column, algorithm: str) -> Column:
    """Hash of a binary or string column by algorithm name."""
    name = algorithm.lower().replace("-", "")
    if name == "md5":
        return F.md5(content)
    if name == "sha1":
        return F.sha1(content)
    if name in ("sha224", "sha256", "sha384", "sha512"):
        return F.sha2(content, int(name[3:]))
    raise ValueError(f"unknown hash algorithm {algorithm!r}")


def hash_files(files: DataFrame, content: str = "content", algorithms=("md5", "sha1", "sha256")):
    """Hashes and size of each file; a missing content gives an error row."""
    data = F.col(content)
    out = files.withColumns({a: digest(data, a) for a in algorithms})
    out = out.withColumn("size", F.octet_length(data).cast("long"))
    out = out.withColumn("error", F.when(data.isNull(), "Failed to hash: no content"))
    return out.drop(content)


def valid_hashes(hashes: DataFrame) -> DataFrame:
    return hashes.filter(F.col("error").isNull())


def first_files_per_root(files: DataFrame, root: str = "root", n: int = 100) -> DataFrame:
    """Optional cap: the first n files by path under each scanned directory."""
    return top_per_group(files, [root], ["path"], n).drop("rank")


def known_bad_table(spark: SparkSession) -> DataFrame:
    """The built-in list, typed by the length of the hash."""
    rows = [("md5" if len(h) == 32 else "sha256", h, t, "CRITICAL") for h, t in L.KNOWN_BAD]
    return spark.createDataFrame(
        rows, "algorithm string, hash string, threat string, severity string"
    )


def _listed(known: DataFrame) -> DataFrame:
    return known.groupBy("algorithm", F.lower("hash").alias("hash")).agg(
        F.min("threat").alias("threat"), F.min("severity").alias("severity")
    )


def known_bad(hashes: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose MD5 or SHA-256 is on the list."""
    keyed = hashes.select(
        "path",
        F.inline(
            F.array(
                F.struct(F.lit("md5").alias("algorithm"), F.lower("md5").alias("hash")),
                F.struct(F.lit("sha256").alias("algorithm"), F.lower("sha256").alias("hash")),
            )
        ),
    )
    return lookup_join(keyed, _listed(known), ["algorithm", "hash"], "inner", measured=True)


def duplicate_groups(hashes: DataFrame) -> DataFrame:
    """Contents held by more than one file: partial counts per task, then one shuffle."""
    return (
        hashes.filter(F.col("sha256").isNotNull())
        .groupBy("sha256")
        .agg(
            F.count("*").alias("copies"),
            F.min("path").alias("first_path"),
            F.sum("size").alias("total_bytes"),
        )
        .filter(F.col("copies") > 1)
    )


def duplicate_files(hashes: DataFrame) -> DataFrame:
    """Every copy, one row each, with the number of copies of its content."""
    groups = duplicate_groups(hashes).select("sha256", "copies", "first_path")
    return lookup_join(hashes.select("sha256", "path"), groups, "sha256", "inner", measured=True)


def suspicious_files(hashes: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """Executables and scripts in places where none should be.

    ``places`` is a table of locations (column ``place``) to use in place of the built-in
    list; the risky rows are then written once, as they are read for the look-up and the result.
    """
    path = F.col("path")
    risky = hashes.filter(extension(path).isin(L.RISKY_EXTENSIONS))
    if places is None:
        risky = risky.filter(in_risky_place(path, L.RISKY_LOCATIONS))
    else:
        risky = in_listed_places(materialize(risky.select("path", "sha256")), places)
    return (
        risky
        .select(
            "path",
            F.lit("Executable/script in suspicious location").alias("reason"),
            extension(path).alias("extension"),
            F.coalesce("sha256", F.lit("N/A")).alias("sha256"),
        )
    )


def classify(hashes: DataFrame, known: DataFrame) -> DataFrame:
    """malware, suspicious or clean for every file, with the threat's name.

    The hashed rows meet the list directly, once for each type of hash, so no content is
    read or hashed twice and nothing is joined by path.
    """
    marked = hashes
    for name in ("md5", "sha256"):
        rows = _listed(known.filter(F.col("algorithm") == name))
        rows = rows.select(F.col("hash").alias("_key"), F.col("threat").alias(f"_{name}_threat"))
        marked = lookup_join(marked.withColumn("_key", F.lower(name)), rows, "_key", "left").drop("_key")
    marked = marked.withColumn("threat", F.least("_md5_threat", "_sha256_threat"))
    marked = marked.drop("_md5_threat", "_sha256_threat")
    risky = F.col("path")
    is_risky = extension(risky).isin(L.RISKY_EXTENSIONS) & in_risky_place(risky, L.RISKY_LOCATIONS)
    return marked.withColumn(
        "status",
        F.when(F.col("threat").isNotNull(), "malware").when(is_risky, "suspicious").otherwise("clean"),
    )


def directory_summary(classified: DataFrame) -> DataFrame:
    """Files per directory and the worst status found in it."""
    rank = F.when(F.col("status") == "malware", 2).when(F.col("status") == "suspicious", 1).otherwise(0)
    return (
        classified.groupBy(parent_dir(F.col("path")).alias("directory"))
        .agg(F.count("*").alias("files"), F.max(rank).alias("worst"))
        .select(
            "directory",
            "files",
            F.when(F.col("worst") == 2, "malware")
            .when(F.col("worst") == 1, "suspicious")
            .otherwise("clean")
            .alias("status"),
        )
    )


def hash_search(hashes: DataFrame, term: str) -> DataFrame:
    """Files whose path or any hash contains the term."""
    needle = term.lower().strip()
    hit = F.contains(F.lower("path"), F.lit(needle))
    for name in HASHES:
        if name in hashes.columns:
            hit = hit | F.contains(F.lower(name), F.lit(needle))
    return hashes.filter(hit)


def verify_integrity(hashes: DataFrame, expected: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """Compare to an expected hash per path, ignoring case."""
    want = expected.groupBy("path").agg(F.max("expected").alias("expected"))
    joined = lookup_join(hashes, want, "path", "inner", salts=1)
    return joined.withColumn(
        "verified", F.coalesce(F.lower(algorithm) == F.lower("expected"), F.lit(False))
    )


def unpivot(hashes: DataFrame) -> DataFrame:
    """One row per file and hash, as the per-file export writes them."""
    labels = {"md5": "MD5", "sha1": "SHA-1", "sha256": "SHA-256", "sha512": "SHA-512"}
    have = [h for h in HASHES if h in hashes.columns]
    rows = F.array(
        *[F.struct(F.lit(labels[h]).alias("hash_type"), F.col(h).alias("hash_value")) for h in have]
    )
    return hashes.select("path", base_name(F.col("path")).alias("file_name"), F.inline(rows))
