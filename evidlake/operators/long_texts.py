"""Pattern scan of stored texts of any size, split over tasks.

A text is read in pieces, each with some text on both sides, so no text is one row. Matches
are those that one scan from the beginning of the text would find. Such a scan has one
state, the end of its last match, so the scans of two neighbouring pieces are one scan when
they agree on the match that crosses their border, or on there being none. Where they differ,
and where a match ends close to the end of what was read, the piece is read again with more
text around it. A piece that lies inside one long match has no matches of its own.

An expression that skips any text up to a closing part (``Load([^)]*byte[]``) may end earlier
in a piece than in the whole text; the next piece sees the longer match, and both are read
again. What is not seen is a closing part more than ``reach`` bytes behind its piece.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidlake.catalogs import Pattern
from evidlake.catalogs.lookups import BINARY_EXTENSIONS
from evidlake.functions.paths import has_extension
from evidlake.functions.text import java_regex, sql_text
from evidlake.operators.hulls import hull, left_to_scan
from evidlake.operators.scan import indicator_level
from evidlake.session import materialize
from evidlake.sources.files import evidence_text
from evidlake.sources.stored import MAX_TASKS, resolved, stored_files, streams, text_windows

PIECE_BYTES = 4 << 20
REACH = 256 << 10
GROWTH = 8
#: Bytes that a task reads, unless that leaves cores without work.
TASK_BYTES = 4 << 20
TASKS_PER_CORE = 4
#: The pattern number of the row that every piece has.
PIECE_ROW = -1

HIT = (
    "path string, piece_no long, pattern int, start long, end long, match string, "
    "beyond array<long>, open boolean, error string"
)


#: What the expressions of a window have to scan: parts of its text, and where they begin in it.
LEFT = (
    "path string, piece_no long, left_chars long, core_chars long, behind array<long>, last boolean, error string, "
    "text_chars long, pattern int, text string, at array<long>, places array<long>"
)
KEPT = ["path", "piece_no", "left_chars", "core_chars", "behind", "last", "error", "text_chars", "pattern"]
LEFT_TYPES = [
    pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.string(),
    pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()),
]
#: Characters of text, and rows of matches, that leave a task at a time.
HAND_ON = 1 << 20
ROWS = 10_000


def _narrowed(catalog: Sequence[Pattern], ascii_classes: bool):
    """Windows as rows of what each expression has to scan, and a row without text for each window."""
    hulls = [hull(p, ascii_classes) for p in catalog]
    names = [*KEPT, "text", "at", "places"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), LEFT_TYPES)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                r = batch.slice(i, 1).to_pylist()[0]
                window = tuple(r[c] for c in KEPT[:-2]) + (len(r["text"]),)
                rows, held = [(*window, PIECE_ROW, "", [0], [0])], 0
                for number, text, at, places in left_to_scan(r["text"], hulls):
                    if held and held + len(text) > HAND_ON:
                        yield batch_of(rows)
                        rows, held = [], 0
                    rows.append((*window, number, text, at, places))
                    held += len(text)
                yield batch_of(rows)

    return run


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches with their places, in characters from the beginning of their piece's core.

    Kept are matches that begin in the core and, with a negative start, the one that crosses
    into it. ``beyond`` says how far a match reaches into each later piece; ``open`` is a
    match that might go on behind the text that was read.
    """
    for batch in batches:
        rows: list[tuple] = []
        for r in batch.to_pylist():
            if r["pattern"] == PIECE_ROW:
                rows.append((r["path"], r["piece_no"], PIECE_ROW, 0, r["core_chars"], None, [], False, r["error"]))
                continue
            matches = r["found"]["matches"]
            if not matches:
                continue
            lengths = np.array([len(m) for m in matches], np.int64)
            gaps = np.array(r["found"]["gaps"], np.int64)
            if len(gaps) == len(lengths):  # an empty match at the beginning splits nothing off
                gaps = np.concatenate([[0], gaps])
            starts = np.cumsum(gaps[:-1]) + np.cumsum(lengths) - lengths
            at, places = np.array(r["at"], np.int64), np.array(r["places"], np.int64)
            starts += (places - at)[np.searchsorted(at, starts, "right") - 1] - r["left_chars"]
            ends = starts + lengths
            behind = r["text_chars"] - r["left_chars"] - r["core_chars"]
            limit = r["core_chars"] + behind - behind // 2
            for i in np.flatnonzero((starts < r["core_chars"]) & ((starts >= 0) | (ends > 0))).tolist():
                s, e = int(starts[i]), int(ends[i])
                beyond = [e - b for b in r["behind"] if b < e] if s >= 0 else []
                opened = not r["last"] and s >= 0 and e > limit
                rows.append((r["path"], r["piece_no"], r["pattern"], s, e, matches[i], beyond, opened, r["error"]))
                if len(rows) >= ROWS:
                    yield _hit_batch(rows)
                    rows = []
        if rows:
            yield _hit_batch(rows)


def _hit_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [
        pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.bool_(), pa.string(),
    ]
    names = ["path", "piece_no", "pattern", "start", "end", "match", "beyond", "open", "error"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _scanned(left: DataFrame, catalog: Sequence[Pattern], ascii_classes: bool) -> DataFrame:
    """Matches in what is left to scan, each with its place."""
    regexes = [java_regex(p.regex, True, p.multiline, ascii_classes) for p in catalog]
    regex = f"get(array({', '.join(map(sql_text, regexes)) or 'cast(null AS string)'}), pattern)"
    gaps = "transform(split(text, regex, -1), g -> char_length(g))"
    found = (
        "transform(array(CASE WHEN pattern >= 0 THEN regexp_extract_all(text, regex, 0) END), m -> named_struct("
        f"'matches', m, 'gaps', CASE WHEN size(m) > 0 THEN {gaps} END))[0]"
    )
    rows = left.withColumn("regex", F.expr(regex)).select(*KEPT, "at", "places", F.expr(found).alias("found"))
    return rows.mapInArrow(_placed, HIT)


def _unsettled(hits: DataFrame, piece_bytes: int) -> DataFrame:
    """Pieces (path, piece_no) whose scan is not yet proven to be a part of the whole scan."""
    hits = hits.filter(F.col("pattern") != PIECE_ROW)
    opened = hits.filter("open").select("path", "piece_no").distinct()
    key = ["path", "pattern", "piece_no"]
    carried = hits.filter(F.size("beyond") > 0).select(
        "path", "pattern", F.col("piece_no").alias("source"), F.size("beyond").alias("n"), F.posexplode("beyond").alias("j", "carry")
    ).select("path", "pattern", "source", (F.col("source") + 1 + F.col("j")).alias("piece_no"), "carry", (F.col("j") < F.col("n") - 1).alias("inside"))
    inside = carried.filter("inside").select("path", "pattern", F.col("piece_no").alias("source"))
    carried = carried.join(inside, ["path", "pattern", "source"], "left_anti")
    carried = carried.groupBy(*key).agg(F.max(F.struct("carry", "source")).alias("c"), F.max("inside").alias("inside"))
    entered = hits.filter("start < 0").select(*key, "start", F.col("end").alias("entry"))
    none = F.lit(0).cast("long")
    # either side may be wrong: both are read again, back to where the crossing match begins
    back = F.call_function("div", -4 * F.coalesce("start", none), F.lit(piece_bytes)) + 1
    first = F.least(F.coalesce("c.source", "piece_no"), F.greatest(F.col("piece_no") - back, none))
    differ = (
        carried.join(entered, key, "full_outer")
        .filter(~F.coalesce("inside", F.lit(False)) & (F.coalesce("c.carry", none) != F.coalesce("entry", none)))
        .select("path", F.explode(F.sequence(first, "piece_no")).alias("piece_no")).distinct()
    )
    # a match that goes on may settle the borders behind it, so those wait
    return opened.unionByName(differ.join(opened.select("path").distinct(), "path", "left_anti"))


def _attribute(catalog: Sequence[Pattern], name: str) -> Column:
    values = [F.lit(getattr(p, name)) for p in catalog]
    return F.get(F.array(*values), F.col("pattern")) if values else F.lit(None).cast("string")


def stored_matches(
    spark: SparkSession, files: DataFrame, catalog: Sequence[Pattern], piece_bytes: int = PIECE_BYTES, reach: int = REACH,
    ascii_classes: bool = False,
) -> DataFrame:
    """Every match in listed files (path, size): path, pattern number, offset, match, error.

    ``offset`` counts characters from the beginning of the text. A file that cannot be read
    has a row with its error and no pattern; an empty file has no row.
    """
    catalog = [p for p in catalog if p.enabled]
    last = F.ceil(F.col("size") / F.lit(piece_bytes)).cast("long") - 1
    pieces = materialize(
        files.filter("size > 0").select(
            "path", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece_no")
        )
    )

    def scanned(some: DataFrame, reach: int) -> DataFrame:
        # a piece is a tiny row and much work: rows are dealt in turn, not merged by their bytes
        count = some.count()
        wanted = max(count * (piece_bytes + 2 * reach) // TASK_BYTES, TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
        dealt = some.repartition(max(1, min(count, wanted, MAX_TASKS)))
        windows = dealt.withColumn("reach", F.lit(reach).cast("long"))
        left = text_windows(windows, piece_bytes, _narrowed(catalog, ascii_classes), LEFT)
        return materialize(_scanned(left, catalog, ascii_classes))

    key = ["path", "piece_no"]
    parts = [scanned(pieces, reach)]
    while True:
        hits = reduce(DataFrame.unionByName, parts)
        again = materialize(_unsettled(hits, piece_bytes))
        if again.isEmpty():
            break
        reach = min(max(reach, 1) * GROWTH, 1 << 40)
        parts = [p.join(again, key, "left_anti") for p in parts]
        parts.append(scanned(pieces.join(again, key, "left_semi"), reach))

    before = Window.partitionBy("path").orderBy("piece_no").rowsBetween(Window.unboundedPreceding, -1)
    marks = hits.filter(F.col("pattern") == PIECE_ROW)
    bases = marks.select(*key, F.coalesce(F.sum("end").over(before), F.lit(0)).alias("base"))
    within = hits.filter(F.size("beyond") > 1).select(
        "path", "pattern", F.explode(F.sequence(F.col("piece_no") + 1, F.col("piece_no") + F.size("beyond") - 1)).alias("piece_no")
    ).distinct()
    placed = (
        hits.filter((F.col("pattern") != PIECE_ROW) & (F.col("start") >= 0))
        .join(within, ["path", "pattern", "piece_no"], "left_anti")
        .join(bases, key)
        .select("path", "pattern", (F.col("base") + F.col("start")).alias("offset"), "match", F.lit(None).cast("string").alias("error"))
    )
    failed = marks.filter(F.col("error").isNotNull()).groupBy("path").agg(F.min("error").alias("error")).select(
        "path", F.lit(None).cast("int").alias("pattern"), F.lit(None).cast("long").alias("offset"),
        F.lit(None).cast("string").alias("match"), "error",
    )
    return placed.unionByName(failed)


def scan_stored(
    spark: SparkSession,
    paths: str | Sequence[str],
    catalog: Sequence[Pattern],
    files: DataFrame | None = None,
    piece_bytes: int = PIECE_BYTES,
    reach: int = REACH,
    ascii_classes: bool = False,
) -> DataFrame:
    """Findings in stored texts of any size: one row per file, pattern and distinct match.

    ``offset`` is the first place of the match and ``occurrences`` how often it stands there;
    ``files`` (path, size) replaces the listing of the paths, which leaves binary extensions
    out. A file that cannot be read has
    a row with its error. Files of a store that tasks cannot open are read whole by Spark.
    """
    catalog = [p for p in catalog if p.enabled]
    listed = [resolved(spark, p) for p in ([paths] if isinstance(paths, str) else paths)]
    if all(streams(p) for p in listed):
        if files is None:
            files = stored_files(spark, listed).filter(~has_extension(F.col("path"), BINARY_EXTENSIONS))
        rows = stored_matches(spark, files, catalog, piece_bytes, reach, ascii_classes)
    else:
        texts = evidence_text(spark, listed)
        texts = texts if files is None else texts.join(files.select("path"), "path", "left_semi")
        whole = texts.select(
            "path", F.lit(0).cast("long").alias("piece_no"), F.lit(0).cast("long").alias("left_chars"),
            F.char_length("text").cast("long").alias("core_chars"), F.expr("cast(array() AS array<long>)").alias("behind"),
            F.lit(True).alias("last"), "text", F.lit(None).cast("string").alias("error"),
        )
        left = whole.mapInArrow(_narrowed(catalog, ascii_classes), LEFT)
        rows = _scanned(left, catalog, ascii_classes).filter(F.col("pattern") != PIECE_ROW).select(
            "path", "pattern", F.col("start").alias("offset"), "match", "error"
        )
    found = rows.groupBy("path", "pattern", "match").agg(
        F.min("offset").alias("offset"), F.count("pattern").alias("occurrences"), F.min("error").alias("error")
    )
    return found.select(
        "path", *(_attribute(catalog, a).alias(a) for a in ("name", "category", "severity", "weight", "description")),
        "match", "offset", "occurrences", "error",
    )


def stored_scores(findings: DataFrame) -> DataFrame:
    """Score, distinct matches and level of each file with findings (partial sums first)."""
    totals = findings.filter(F.col("name").isNotNull()).groupBy("path").agg(
        F.sum("weight").cast("long").alias("threat_score"), F.count("*").alias("total_iocs")
    )
    return totals.withColumn("threat_level", indicator_level(F.col("threat_score")))
