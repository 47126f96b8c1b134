"""The event detectors and the evidence scan on streams.

The batch functions are used as they are. Row detectors hold no state. Brute force
keeps one counter per open window and user, and the watermark closes windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidlake.catalogs import indicator_catalog
from evidlake.functions.text import clean_utf8
from evidlake.operators import events as E
from evidlake.operators.scan import explode_findings, scan
from evidlake.schemas import WINDOWS_EVENTS


def event_stream(spark: SparkSession, path: str, schema: str = WINDOWS_EVENTS, **options):
    """Events from files that keep arriving in a folder."""
    reader = spark.readStream.schema(schema)
    for key, value in options.items():
        reader = reader.option(key, value)
    return E.normalize(reader.parquet(path))


def stream_brute_force(
    events: DataFrame, late: str = "10 minutes", config: E.EventConfig = E.EventConfig()
) -> DataFrame:
    """Append-mode brute force: a window is reported once, when it can get no more rows.

    The filter names the event time, so it stays above the watermark: every event moves
    the watermark on, not only the next failed log-on.
    """
    seen = events.withWatermark("ts", late)
    failed = F.coalesce(E.is_failed_logon() & F.col("ts").isNotNull(), F.lit(False))
    return E.count_failures(seen.filter(failed), config)


def stream_row_anomalies(events: DataFrame) -> DataFrame:
    """The six stateless detectors in one pass over the stream."""
    return E.row_anomalies(events)


def device_feed(events: DataFrame) -> DataFrame:
    """Every event of a device; ``streaming.devices`` follows what is attached and gone."""
    return E.usb_activity(events)


def stream_text_scan(
    spark: SparkSession, path: str, label: str = "Unlabeled", ascii_classes: bool = False
) -> DataFrame:
    """Indicators in evidence files as they are dropped into a folder."""
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    texts = files.select(
        "path",
        F.col("modificationTime").alias("mtime"),
        F.lit(label).alias("label"),
        clean_utf8(F.col("content")).alias("text"),
    )
    return explode_findings(scan(texts, indicator_catalog(), ascii_classes=ascii_classes))


def write_findings(stream: DataFrame, path: str, checkpoint: str, **trigger):
    """Exactly-once append to a Parquet table."""
    return (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
