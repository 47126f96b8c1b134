"""Files of any size, read in pieces inside tasks.

Tasks list folders, with the empty and hidden files that Spark's own listing leaves out, and
contents never become one row. A task opens its files itself and streams them: hashes are
kept as running states, images are cut into chunks, and what leaves the task are Arrow
batches of bounded size. A large image is dealt out by byte ranges, so it is read by many
tasks.

A store that Python's or Arrow's file systems cannot open (a mount table is resolved to what
it mounts) is read by Spark's own reader, a file a row, which holds up to 2 GB.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidlake.session import materialize

PIECE = 8 << 20
RANGE = 128 << 20
MAX_TASKS = 4096
#: Schemes of stores that Arrow's file systems open.
ARROW_SCHEMES = {"hdfs", "s3", "s3a", "gs", "gcs", "abfs", "abfss"}


def resolved(spark: SparkSession, path: str) -> str:
    """A path behind a mount table as the path of the store that holds it."""
    if urlsplit(path).scheme != "viewfs":
        return path
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).resolvePath(hadoop).toString()


def streams(path: str) -> bool:
    """Whether tasks can open files of this path's store themselves."""
    return urlsplit(path).scheme in {"", "file", *ARROW_SCHEMES}


def open_stored(path: str):
    """A stored file, open for reading; paths are as Spark lists them, so nothing is escaped."""
    scheme, _, rest = path.partition(":") if urlsplit(path).scheme else ("", "", path)
    if scheme in ("", "file"):
        return open(_local(path) if scheme else rest, "rb", buffering=0)
    from pyarrow import fs

    filesystem, inner = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return filesystem.open_input_file(inner)


def _local(path: str) -> str:
    return "/" + path.partition(":")[2].lstrip("/")


def _entry(path: str, info) -> tuple[str, bool, int, int]:
    """An Arrow file system's entry: path, whether it is a folder, size, time in microseconds."""
    from pyarrow import fs

    return path, info.type == fs.FileType.Directory, info.size or 0, (info.mtime_ns or 0) // 1000


def entries(path: str, root: bool = False) -> Iterator[tuple[str, bool, int, int]]:
    """What a folder holds; a root that is a file holds itself. Folders that cannot be read are empty."""
    if path.startswith("file:"):
        here = _local(path)
        if root and not os.path.isdir(here):
            if os.path.exists(here):
                found = os.stat(here)
                yield path, False, found.st_size, found.st_mtime_ns // 1000
            return
        try:
            children = list(os.scandir(here))
        except OSError:
            return
        for child in children:
            name = path.rstrip("/") + "/" + os.fsencode(child.name).decode("utf-8", "replace")
            try:
                if child.is_dir(follow_symlinks=False):
                    yield name, True, 0, 0
                elif child.is_file():
                    found = child.stat()
                    yield name, False, found.st_size, found.st_mtime_ns // 1000
            except OSError:
                continue
        return
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    info = store.get_file_info(inner)
    if root and info.type == fs.FileType.File:
        yield _entry(path, info)
    elif info.type == fs.FileType.Directory:
        for child in store.get_file_info(fs.FileSelector(inner)):
            yield _entry(path.rstrip("/") + "/" + child.base_name, child)


LISTED = "path string, is_dir boolean, size long, mtime timestamp"


def _listing(depth: int | None):
    """Lists folders down to a depth; deeper folders are returned as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [(), (), (), ()]
            kinds = [pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC")]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "is_dir", "size", "mtime"]
            )

        rows: list = []
        for batch in batches:
            for start in batch.column(0).to_pylist():
                open_ = [(start, 0)]
                while open_:
                    folder, level = open_.pop()
                    for entry in entries(folder, root=level == 0):
                        if entry[1] and (depth is None or level + 1 < depth):
                            open_.append((entry[0], level + 1))
                        else:
                            rows.append(entry)
                    if len(rows) >= 10_000:
                        yield batch_of(rows)
                        rows = []
        yield batch_of(rows)

    return run


def stored_files(spark: SparkSession, paths: str | Sequence[str], recursive: bool = True) -> DataFrame:
    """path, size, mtime of all files of some folders, empty and hidden ones too.

    The two upper levels are listed first, then tasks walk the folders below in parallel; no
    content is read and no size limit holds. Links to folders are not followed. Paths with
    wildcards, and stores that tasks cannot open, are listed by Spark, without empty and
    hidden files.
    """
    paths = [resolved(spark, p) for p in ([paths] if isinstance(paths, str) else paths)]
    if not all(streams(p) and not set(p) & set("*?[{") for p in paths):
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
        return reader.load(paths).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    roots = ["file:" + os.path.abspath(_local(p) if p.startswith("file:") else p) if urlsplit(p).scheme in ("", "file") else p for p in paths]
    upper = spark.createDataFrame([(p,) for p in roots], "path string").mapInArrow(_listing(2 if recursive else 1), LISTED)
    columns = ["path", "size", "mtime"]
    if not recursive:
        return materialize(upper.filter("not is_dir").select(*columns))
    upper = materialize(upper)
    folders = upper.filter("is_dir")
    tasks = max(1, min(folders.count(), MAX_TASKS))
    below = folders.select("path").repartition(tasks).mapInArrow(_listing(None), LISTED)
    return materialize(upper.filter("not is_dir").select(*columns).unionByName(below.select(*columns)))


def dealt(files: DataFrame) -> DataFrame:
    """Listed files dealt out to as many tasks as their bytes ask for."""
    count, size = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    wanted = max(size // RANGE + 1, min(count, files.sparkSession.sparkContext.defaultParallelism))
    return files.repartition(max(1, min(wanted, MAX_TASKS)))


def hash_stored(files: DataFrame, algorithms: Sequence[str] = ("md5", "sha1", "sha256"), piece: int = PIECE) -> DataFrame:
    """Hashes of listed files of any size: one running state per algorithm and open file.

    A file that cannot be read gives a row with ``error`` and null hashes and does not fail the
    job; ``size`` is what was read.
    """
    names = list(algorithms)
    schema = ", ".join(["path string", "size long", "mtime timestamp", *(f"{a} string" for a in names), "error string"])

    def one(path: str) -> tuple[int, list[str | None], str | None]:
        states = [hashlib.new(a) for a in names]
        size = 0
        try:
            with open_stored(path) as file:
                while data := file.read(piece):
                    size += len(data)
                    for state in states:
                        state.update(data)
        except OSError as error:
            return size, [None] * len(names), f"Failed to hash: {error.strerror or error}"
        return size, [s.hexdigest() for s in states], None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, mtime in zip(batch.column("path").to_pylist(), batch.column("mtime")):
                size, found, error = one(path)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path]), pa.array([size]), pa.array([mtime.as_py()], mtime.type),
                        *(pa.array([h], pa.string()) for h in found), pa.array([error], pa.string()),
                    ],
                    names=["path", "size", "mtime", *names, "error"],
                )

    return dealt(files).select("path", "mtime").mapInArrow(run, schema)


def _pieces(path: str, start: int, end: int, piece: int) -> Iterator[tuple[int, bytes]]:
    """Bytes of a range, ``piece`` at a time; a shorter file ends the range."""
    with open_stored(path) as file:
        file.seek(start)
        while start < end:
            data, want = b"", min(piece, end - start)
            while len(data) < want and (more := file.read(want - len(data))):
                data += more
            if not data:
                return
            yield start, data
            start += len(data)


def stored_chunks(files: DataFrame, chunk_bytes: int, range_bytes: int = RANGE) -> DataFrame:
    """path, chunk_no, offset, bytes of listed files cut at multiples of ``chunk_bytes``.

    The last chunk of a file may be shorter; an empty file has none. A task has ranges of
    about ``range_bytes`` and holds a few chunks, or 8 MB of small ones, at a time.
    """
    per_range = max(1, range_bytes // chunk_bytes) * chunk_bytes
    last = F.ceil(F.col("size") / F.lit(per_range)).cast("long") - 1
    ranges = files.filter("size > 0").select(
        "path", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("range")
    )
    # a range is a tiny row and much work: rows are dealt in turn, not merged by their bytes
    count = ranges.count()
    ranges = ranges.repartition(max(1, min(count, MAX_TASKS)))
    piece = max(1, PIECE // chunk_bytes) * chunk_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, number in zip(*(batch.column(i).to_pylist() for i in range(3))):
                start = number * per_range
                for offset, data in _pieces(path, start, min(size, start + per_range), piece):
                    n = -(-len(data) // chunk_bytes)
                    edges = np.minimum(np.arange(n + 1) * chunk_bytes, len(data)).astype(np.int32)
                    first = offset // chunk_bytes
                    numbers = np.arange(first, first + n)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([path] * n), pa.array(numbers), pa.array(numbers * chunk_bytes),
                            pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(edges), pa.py_buffer(data)]),
                        ],
                        names=["path", "chunk_no", "offset", "bytes"],
                    )

    return ranges.select("path", "size", "range").mapInArrow(
        run, "path string, chunk_no long, offset long, bytes binary"
    )


def _decoded(data: bytes) -> str:
    """Bytes as text, with undecodable bytes dropped (as ``functions.text.clean_utf8``)."""
    return data.decode("utf-8", "ignore").replace("\ufffd", "")


def _window(path: str, size: int, start: int, piece_bytes: int, reach: int):
    """A piece of a text with its surroundings: left, core, texts of the pieces behind, last.

    Cuts move on by at most three bytes to one that begins a character, or that no character
    can hold, so the pieces' texts put together are the text of the file.
    """
    end = min(size, start + piece_bytes)
    low, high = max(0, start - reach), min(size, end + reach)
    data = b"".join(d for _, d in _pieces(path, low, min(size, high + 3), PIECE))

    def cut(at: int) -> int:
        at -= low
        return next((i for i in range(at, min(at + 3, len(data))) if data[i] & 0xC0 != 0x80), min(at + 3, len(data)))

    edges = [cut(start), *(cut(e) for e in range(end, high, piece_bytes)), cut(high)]
    left = _decoded(data[cut(low):edges[0]]) if start else ""
    parts = [_decoded(data[a:b]) for a, b in zip(edges, edges[1:])] or [""]
    return left, parts, high == size


WINDOW = (
    "path string, piece_no long, left_chars long, core_chars long, behind array<long>, last boolean, "
    "text string, error string"
)


def text_windows(
    pieces: DataFrame,
    piece_bytes: int,
    through: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None,
    schema: str = WINDOW,
) -> DataFrame:
    """Pieces of stored texts with ``reach`` bytes of text on both sides.

    ``pieces`` has path, size, piece_no and reach. ``behind`` lists where later pieces begin,
    in characters from the beginning of the core. A piece that cannot be read has an error.
    ``through`` goes on with the windows in the same task, to rows of ``schema``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, number, reach in zip(*(batch.column(i).to_pylist() for i in range(4))):
                error, left, parts, last = None, "", [""], True
                try:
                    left, parts, last = _window(path, size, number * piece_bytes, piece_bytes, reach)
                except OSError as failed:
                    error = f"Failed to read: {failed.strerror or failed}"
                behind = np.cumsum([len(p) for p in parts]).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path]), pa.array([number]), pa.array([len(left)]), pa.array([behind[0]]),
                        pa.array([behind[:-1] if len(parts) > 1 else []], pa.list_(pa.int64())), pa.array([last]),
                        pa.array([left + "".join(parts)]), pa.array([error], pa.string()),
                    ],
                    names=["path", "piece_no", "left_chars", "core_chars", "behind", "last", "text", "error"],
                )

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return through(run(batches)) if through else run(batches)

    return pieces.select("path", "size", "piece_no", "reach").mapInArrow(passed, schema)


def chunks_of(spark: SparkSession, paths: str | Sequence[str], chunk_bytes: int) -> DataFrame:
    """Chunks of all files of some paths, whatever store they are in."""
    listed = [resolved(spark, p) for p in ([paths] if isinstance(paths, str) else paths)]
    if all(streams(p) for p in listed):
        return stored_chunks(stored_files(spark, listed), chunk_bytes)
    from evidlake.sources.files import evidence_files, slice_images

    whole = evidence_files(spark, listed).select(F.col("path").alias("image"), "content")
    return slice_images(whole, chunk_bytes).withColumnRenamed("image", "path")


def file_hashes(spark: SparkSession, paths: str | Sequence[str], algorithms: Sequence[str] = ("md5", "sha1", "sha256")) -> DataFrame:
    """Hashes of all files of some paths: path, size, mtime, one column per algorithm, error."""
    listed = [resolved(spark, p) for p in ([paths] if isinstance(paths, str) else paths)]
    if all(streams(p) for p in listed):
        return hash_stored(stored_files(spark, listed), algorithms)
    from evidlake.operators.hashes import hash_files
    from evidlake.sources.files import evidence_files

    rows = hash_files(evidence_files(spark, listed).select("path", "mtime", "content"), algorithms=tuple(algorithms))
    return rows.select("path", "size", "mtime", *algorithms, "error")
