"""Strings and artefacts from page and memory images.

Input: chunks (image, chunk_no, offset, bytes) of one even size. Printable runs of
a chunk are found with numpy inside its task, with absolute offsets. A run that
touches a chunk edge is a *piece*; pieces that continue each other are put back
together, so no string is lost or cut at an edge. Only a string beyond a size stays as
its pieces, each searched with the beginning of the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidlake.catalogs import lookups as L
from evidlake.catalogs import patterns
from evidlake.functions.text import any_contains, java_regex
from evidlake.operators.joins import lookup_join
from evidlake.session import materialize

MIN_CHARS = 8
SPAN = 10 * 1024 * 1024
SEGMENT = 4096
#: Characters up to which a string over chunk edges is put together in one row.
WHOLE = 1 << 20
#: Characters of the next piece that a piece of a longer string is searched with.
OVERLAP = 4096
#: Pieces, and their characters, after which a task hands on what it has found.
HAND_ON, HAND_ON_CHARS = 8192, 4 << 20
#: Bytes of chunks that are copied out of an Arrow batch at a time.
SLICE_BYTES = 1 << 20

PIECES = (
    "image string, chunk_no long, encoding string, offset long, value string, "
    "at_start boolean, at_end boolean"
)


def _runs(mask: np.ndarray, shortest: int) -> list[tuple[int, int]]:
    """[start, end) of runs of True that are long enough or touch an edge."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    keep = (ends - starts >= shortest) | (starts == 0) | (ends == len(mask))
    return list(zip(starts[keep].tolist(), ends[keep].tolist()))


def _carve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces of each chunk, handed on in small frames, however many chunks a batch holds."""
    names = [c.split()[0] for c in PIECES.split(", ")]
    for batch in batches:
        rows, chars_held = [], 0
        for image, chunk_no, offset, data in batch.itertuples(index=False):
            raw = np.frombuffer(data, dtype=np.uint8)
            pairs = raw[: len(raw) // 2 * 2].reshape(-1, 2)
            found = {
                "ascii": (raw, (raw >= 32) & (raw <= 126), 1),
                "utf16": (
                    pairs[:, 0],
                    (pairs[:, 1] == 0) & (pairs[:, 0] >= 32) & (pairs[:, 0] <= 126),
                    2,
                ),
            }
            for encoding, (chars, mask, width) in found.items():
                for start, end in _runs(mask, MIN_CHARS):
                    rows.append(
                        (image, chunk_no, encoding, offset + start * width,
                         chars[start:end].tobytes().decode("ascii"),
                         start == 0, end == len(mask))
                    )
                    chars_held += end - start
                    if len(rows) >= HAND_ON or chars_held >= HAND_ON_CHARS:
                        yield pd.DataFrame(rows, columns=names)
                        rows, chars_held = [], 0
        yield pd.DataFrame(rows, columns=names)


PIECES_ARROW = pa.schema(
    [
        ("image", pa.string()), ("chunk_no", pa.int64()), ("encoding", pa.string()),
        ("offset", pa.int64()), ("value", pa.string()), ("at_start", pa.bool_()), ("at_end", pa.bool_()),
    ]
)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """The chunks of Arrow batches in frames of about ``SLICE_BYTES``."""
    for batch in batches:
        step = max(1, SLICE_BYTES * batch.num_rows // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step).to_pandas()
        del batch  # before the next one is read


def _carve_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of each chunk: beside Spark's batch, a task holds one slice and one small frame."""
    for frame in _carve(_slices(batches)):
        if len(frame):
            yield pa.RecordBatch.from_pandas(frame, PIECES_ARROW, preserve_index=False)


def string_pieces(chunks: DataFrame) -> DataFrame:
    return chunks.select("image", "chunk_no", "offset", "bytes").mapInArrow(_carve_batches, PIECES)


def _chain_heads(edge: DataFrame) -> DataFrame:
    """Offset of the first piece of the string each edge piece belongs to.

    Only the position of a piece moves here, not its text: two small rows per chunk
    and encoding. The running "last head so far" is taken in two levels, first inside
    segments of 4096 chunks and then over one row per segment, so even an image with
    a third of all chunks is spread over many tasks.
    """
    key = ["image", "encoding"]
    previous = edge.filter("at_end").select(*key, (F.col("chunk_no") + 1).alias("chunk_no"))
    previous = previous.withColumn("follows", F.lit(True))
    rows = edge.select(*key, "chunk_no", "offset", "at_start").join(
        previous, [*key, "chunk_no"], "left"
    )
    continues = F.col("at_start") & F.coalesce("follows", F.lit(False))
    rows = rows.withColumn("head", F.when(~continues, F.col("offset")))
    rows = rows.withColumn("segment", F.call_function("div", F.col("chunk_no"), F.lit(SEGMENT)))
    inside = Window.partitionBy(*key, "segment").orderBy("offset")
    rows = rows.withColumn("head_here", F.last("head", ignorenulls=True).over(inside))
    per_segment = rows.groupBy(*key, "segment").agg(F.max("head").alias("segment_head"))
    before = Window.partitionBy(*key).orderBy("segment").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = per_segment.select(
        *key, "segment", F.max("segment_head").over(before).alias("carried")
    )
    rows = rows.join(carried, [*key, "segment"])
    return rows.select(*key, "offset", F.coalesce("head_here", "carried").alias("head"))


def carve_strings(chunks: DataFrame, whole_chars: int = WHOLE) -> DataFrame:
    """All printable strings of at least 8 characters: image, encoding, offset, value, head, rest.

    A string of up to ``whole_chars`` characters is one row. A longer one stays as its pieces,
    one row for each chunk it runs through: ``offset`` is the piece's place, ``head`` that of
    the string, and ``rest`` holds the first characters of the next piece, so that a search
    in value and rest misses nothing at a border. No group or row is larger than a chunk or
    ``whole_chars``, however long a printable run is.

    The pieces are written to the checkpoint folder once, because several branches read
    them and the images themselves should be read a single time.
    """
    pieces = materialize(string_pieces(chunks))
    key = ["image", "encoding"]
    columns = [*key, "offset", "value"]
    touching = F.col("at_start") | F.col("at_end")
    inner = pieces.filter(~touching).select(*columns)
    edge = pieces.filter(touching)
    heads = _chain_heads(edge.drop("value"))
    placed = materialize(edge.join(heads, [*key, "offset"]))
    sizes = placed.groupBy(*key, "head").agg(F.sum(F.length("value")).alias("chars"))
    sized = lookup_join(
        placed, sizes.filter(F.col("chars") >= MIN_CHARS), [*key, "head"], "inner", spread=["offset"], may_broadcast=False
    )
    # what a group collects is one value of the result, of a bounded size
    whole = (
        sized.filter(F.col("chars") <= whole_chars)
        .groupBy(*key, F.col("head").alias("offset"))
        .agg(F.array_sort(F.collect_list(F.struct(F.col("offset").alias("o"), "value"))).alias("p"))
        .withColumn("value", F.array_join(F.col("p.value"), ""))
    )
    long = sized.filter(F.col("chars") > whole_chars)
    following = long.filter("at_start").select(
        *key, (F.col("chunk_no") - 1).alias("chunk_no"), F.substring("value", 1, OVERLAP).alias("rest")
    )
    # a piece goes on in the next chunk if it ends with its own; of a chunk, one piece does
    goes_on = F.when(F.col("at_end"), F.col("chunk_no"))
    long = long.withColumn("chunk_no", goes_on).join(following, [*key, "chunk_no"], "left")
    rows = inner.unionByName(whole.select(*columns)).withColumns(
        {"head": F.col("offset"), "rest": F.lit("")}
    )
    return rows.unionByName(long.select(*columns, "head", F.coalesce("rest", F.lit("")).alias("rest")))


def distinct_strings(strings: DataFrame, span: int = SPAN) -> DataFrame:
    """Each value once per 10 MB stretch of its image, at its first offset and in its encoding.

    Pieces of long strings are told apart by what follows them as well.
    """
    stretch = F.call_function("div", F.col("offset"), F.lit(span))
    key = ["image", "stretch", "value"]
    columns = [c for c in strings.columns if c not in ("image", "value")]
    if "rest" in columns:
        key.append("rest")
    first = F.min_by(F.struct(*columns), F.col("offset")).alias("first")
    found = strings.withColumn("stretch", stretch).groupBy(*key).agg(first)
    return found.select("image", "value", *[F.col(f"first.{c}").alias(c) for c in columns])


def artifact_category(kind: Column, value: Column) -> Column:
    has = lambda *words: any_contains(value, list(words))
    url = (
        F.when(has("google.com"), "search_engine")
        .when(has(*L.SOCIAL_SITES), "social_media")
        .when(has(*L.SHOPPING_SITES), "shopping")
        .otherwise("browsing")
    )
    path = (
        F.when(has("\\Users\\"), "user_documents")
        .when(has("\\Program Files"), "applications")
        .when(has("\\Windows\\"), "system")
        .otherwise("files")
    )
    return (
        F.when(kind == "url", url)
        .when(kind == "file_path", path)
        .when(kind.isin(L.SENSITIVE_TYPES), "credentials")
    )


def artifacts(strings: DataFrame) -> DataFrame:
    """Typed artefacts: one row per string, or piece of a long string, and type it shows.

    A piece is searched together with the beginning of the next one.
    """
    value = F.col("value")

    def shown(regex: str) -> Column:
        hit = value.rlike(regex)
        if "rest" not in strings.columns:
            return hit
        rest = F.col("rest")
        # what lies in the rest alone is the next piece's
        over_border = F.concat(value, rest).rlike(regex) & ~rest.rlike(regex)
        return hit | F.when(rest != "", over_border).otherwise(F.lit(False))

    types = F.array_compact(
        F.array(
            *[
                F.when(shown(java_regex(regex, fold)), F.lit(kind))
                for kind, fold, regex in patterns.PAGE_IMAGE
            ]
        )
    )
    rows = strings.select("*", F.explode_outer(types).alias("type")).filter(F.col("type").isNotNull())
    sensitive = F.col("type").isin(L.SENSITIVE_TYPES) | any_contains(F.lower(value), L.SENSITIVE_WORDS)
    return rows.withColumns(
        {"category": artifact_category(F.col("type"), value), "is_sensitive": sensitive}
    )


def artifact_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("type").agg(
        F.count("*").alias("artifacts"), F.count_if("is_sensitive").alias("sensitive")
    )


def top_artifacts(found: DataFrame, kind: str, n: int) -> DataFrame:
    """Values of a type by how often they occur, ranked; first seen wins a tie."""
    order = [F.desc("count"), F.col("first_seen")]
    top = (
        found.filter(F.col("type") == kind)
        .groupBy("value")
        .agg(
            F.count("*").alias("count"),
            F.min("category").alias("category"),
            F.max("is_sensitive").alias("is_sensitive"),
            F.min(F.struct("image", "offset")).alias("first_seen"),
        )
        .orderBy(*order)
        .limit(n)
    )
    # only the n rows of the list are numbered
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).drop("first_seen")


def new_locations(configured: DataFrame, known: DataFrame) -> DataFrame:
    """Configured image paths that are not known yet."""
    return configured.select("path").distinct().join(known.select("path"), "path", "left_anti")
