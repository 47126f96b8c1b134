"""Reading evidence: files, texts, record images and exported tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidlake.catalogs.lookups import BINARY_EXTENSIONS
from evidlake.functions.paths import has_extension
from evidlake.functions.text import clean_utf8
from evidlake.sources.stored import chunks_of, resolved, stored_chunks, stored_files, streams


def evidence_files(
    spark: SparkSession,
    paths: str | Sequence[str],
    label: str = "Unlabeled",
    recursive: bool = True,
    extensions: Sequence[str] | None = None,
    skip_extensions: Sequence[str] = (),
) -> DataFrame:
    """Files of one or many directories: path, size, mtime, content, label.

    The content is read only when a later step selects it; filters on size and
    modification time reach the scan.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    rows = reader.load(list(paths) if not isinstance(paths, str) else paths).select(
        "path",
        F.col("length").alias("size"),
        F.col("modificationTime").alias("mtime"),
        "content",
        F.lit(label).alias("label"),
    )
    if extensions:
        rows = rows.filter(has_extension(F.col("path"), list(extensions)))
    if skip_extensions:
        rows = rows.filter(~has_extension(F.col("path"), list(skip_extensions)))
    return rows


def evidence_text(
    spark: SparkSession,
    paths: str | Sequence[str],
    label: str = "Unlabeled",
    recursive: bool = True,
    extensions: Sequence[str] | None = None,
    max_chars: int | None = None,
) -> DataFrame:
    """Evidence files as text, undecodable bytes dropped. Whole texts by default."""
    skip = () if extensions else BINARY_EXTENSIONS
    files = evidence_files(spark, paths, label, recursive, extensions, skip)
    text = clean_utf8(F.col("content"))
    text = text if max_chars is None else F.substring(text, 1, max_chars)
    return files.select("path", "size", "mtime", "label", text.alias("text"))


def text_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Plain text, code and data files, one row per file."""
    return spark.read.text(
        list(paths) if not isinstance(paths, str) else paths, wholetext=True
    ).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def image_records(
    spark: SparkSession, path: str, record_bytes: int, name: str, max_records: int | None = None
) -> DataFrame:
    """A large image as numbered records of one size: (record_no, record, image).

    The file is read by byte ranges in many tasks (``sources.stored``); a shorter record at
    its end stays. With ``max_records``, only their bytes are read.
    """
    path = resolved(spark, path)
    if not streams(path):
        rows = chunks_of(spark, path, record_bytes)
    else:
        files = stored_files(spark, path)
        if max_records is not None:
            files = files.withColumn("size", F.least("size", F.lit(max_records * record_bytes)))
        rows = stored_chunks(files, record_bytes)
    rows = rows.select(F.col("chunk_no").alias("record_no"), F.col("bytes").alias("record"), F.lit(name).alias("image"))
    return rows if max_records is None else rows.filter(F.col("record_no") < max_records)


def mft_image(spark: SparkSession, path: str, volume: str, max_records: int | None = None):
    """A record file as (volume, entry_number, record); a shorter record at its end is none."""
    rows = image_records(spark, path, 1024, volume, max_records).filter(F.octet_length("record") == 1024)
    return rows.select(
        F.col("image").alias("volume"), F.col("record_no").alias("entry_number"), "record"
    )


def page_image(spark: SparkSession, path: str, image: str, chunk_bytes: int = 10 * 1024 * 1024):
    """A page or memory image as chunks with offsets; the last one may be shorter."""
    rows = image_records(spark, path, chunk_bytes, image)
    return rows.select(
        "image",
        F.col("record_no").alias("chunk_no"),
        (F.col("record_no") * chunk_bytes).alias("offset"),
        F.col("record").alias("bytes"),
    )


def slice_images(
    files: DataFrame, chunk_bytes: int, content: str = "content", drop_tail: bool = False
) -> DataFrame:
    """Images held in rows (image, content) cut to chunks inside their task."""
    size = F.octet_length(content)
    whole = F.call_function("div", size, F.lit(chunk_bytes))
    parts = whole if drop_tail else F.ceil(size / F.lit(float(chunk_bytes)))
    numbers = F.when(parts > 0, F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1))
    rows = files.select("image", content, F.explode(numbers).alias("chunk_no"))
    offset = F.col("chunk_no") * chunk_bytes
    return rows.select(
        "image",
        "chunk_no",
        offset.alias("offset"),
        F.substring(F.col(content), (offset + 1).cast("int"), F.lit(chunk_bytes)).alias("bytes"),
    )


def table(spark: SparkSession, path: str, schema: str | None = None, fmt: str = "parquet"):
    """An exported evidence table with its fixed schema."""
    reader = spark.read.format(fmt)
    if schema:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", "true")
    return reader.load(path)
