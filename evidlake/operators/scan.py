"""Multi-pattern text scan, scores and severity roll-ups.

All expressions of a catalogue run in one projection over the text; the result is
one array of findings per text. Everything that is *per text* (score, level,
severity counts, categories) is then computed inside the row, without a shuffle.
Only reports across texts aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidlake.catalogs import Pattern, shipped_patterns
from evidlake.catalogs.gates import (
    ALSO_SHAPE,
    DIGIT,
    DIGIT_NEEDLES,
    DIGIT_SHAPES,
    NEEDLES,
    SHAPE_OF,
    SHAPES,
)
from evidlake.functions.rows import once
from evidlake.functions.text import fold, java_regex, sql_text

SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]


@lru_cache(maxsize=1)
def _shipped() -> dict[str, set[str]]:
    """The expressions for which the gates of a name hold."""
    known: dict[str, set[str]] = {}
    for p in shipped_patterns():
        known.setdefault(p.name, set()).add(p.regex)
    return known


def is_shipped(pattern: Pattern) -> bool:
    """Whether gates hold: they are proven for the shipped expression only, whatever a row is called."""
    return pattern.regex in _shipped().get(pattern.name, ())


def _gate(pattern: Pattern) -> str | None:
    """SQL test on the folded text or a shape column, None when nothing can be skipped."""
    if not is_shipped(pattern):
        return None
    if pattern.name in SHAPE_OF:
        return f"_shape_{SHAPE_OF[pattern.name]}"
    if pattern.name in NEEDLES:
        tests = [f"contains(_folded, {sql_text(n)})" for n in NEEDLES[pattern.name]]
        if pattern.name in ALSO_SHAPE:
            tests.append(f"_shape_{ALSO_SHAPE[pattern.name]}")
        some = " OR ".join(tests)
        return f"_has_digit AND ({some})" if pattern.name in DIGIT_NEEDLES else some
    return None


def _finding(pattern: Pattern, text: str, gate: str | None, ascii_classes: bool = False) -> str:
    """One pattern as a SQL struct: its attributes and its distinct matches."""
    regex = java_regex(pattern.regex, True, pattern.multiline, ascii_classes)
    found = f"array_distinct(regexp_extract_all(`{text}`, {sql_text(regex)}, 0))"
    if gate:
        found = f"CASE WHEN {gate} THEN {found} ELSE cast(array() AS array<string>) END"
    return (
        f"named_struct('name', {sql_text(pattern.name)}, 'category', {sql_text(pattern.category)}, "
        f"'severity', {sql_text(pattern.severity)}, 'weight', {pattern.weight}, "
        f"'description', {sql_text(pattern.description)}, 'matches', {found})"
    )


def stage_gates(
    df: DataFrame, catalog: Sequence[Pattern], text: str = "text"
) -> tuple[DataFrame, dict[Pattern, str]]:
    """The texts with a boolean column for every gate, and the column of each pattern."""
    gates: dict[Pattern, str] = {}
    opened: dict[str, Column] = {}
    shapes = sorted({s for p in catalog for s in (SHAPE_OF.get(p.name), ALSO_SHAPE.get(p.name)) if s})
    staged = df.withColumn("_folded", fold(F.col(text)))
    staged = staged.withColumn("_has_digit", F.col(text).rlike(DIGIT))
    tests = {}
    for shape in shapes:
        hit = F.col("_folded").rlike(SHAPES[shape])
        tests[f"_shape_{shape}"] = F.col("_has_digit") & hit if shape in DIGIT_SHAPES else hit
    staged = staged.withColumns(tests)
    # Gates are columns of their own, so they run in generated code; the array of
    # findings below is interpreted.
    for p in catalog:
        test = _gate(p)
        if test:
            gates[p] = f"_gate_{len(gates)}"
            opened[gates[p]] = F.expr(test)
    return staged.withColumns(opened), gates


def scan(
    df: DataFrame,
    catalog: Sequence[Pattern],
    text: str = "text",
    keep_text: bool = False,
    gated: bool = True,
    as_column: str = "findings",
    ascii_classes: bool = False,
) -> DataFrame:
    """Add the findings of every enabled pattern: distinct matches in first-seen order.

    ``ascii_classes`` scans with the word borders and classes of ASCII text.
    """
    catalog = [p for p in catalog if p.enabled]
    staged, gates = stage_gates(df, catalog, text) if gated else (df, {})
    # The catalogue is one SQL expression: a catalogue of columns takes seconds to build.
    hits = F.expr(
        f"filter(array({', '.join(_finding(p, text, gates.get(p), ascii_classes) for p in catalog)}), "
        "f -> size(f.matches) > 0)"
    )
    keep = [c for c in df.columns if keep_text or c != text]
    return once(staged, keep, {as_column: hits})


def explode_findings(scanned: DataFrame, findings: str = "findings") -> DataFrame:
    """One row per (text, pattern) with the number of distinct matches."""
    keep = [c for c in scanned.columns if c != findings]
    return (
        scanned.select(*keep, F.inline_outer(findings))
        .filter(F.col("name").isNotNull())
        .withColumn("count", F.size("matches").cast("long"))
    )


def with_findings(scanned: DataFrame, findings: str = "findings") -> DataFrame:
    """The texts in which something was found."""
    return scanned.filter(F.size(findings) > 0)


def limit_examples(findings: DataFrame, n: int) -> DataFrame:
    """Keep the first n example matches; counts are unchanged."""
    return findings.withColumn("matches", F.slice("matches", 1, n))


def _sum(findings: str, value) -> Column:
    return F.aggregate(F.col(findings), F.lit(0).cast("long"), lambda acc, f: acc + value(f))


def count_of(f: Column) -> Column:
    return F.size(f["matches"]).cast("long")


def threat_score(findings: str = "findings") -> Column:
    return _sum(findings, lambda f: count_of(f) * f["weight"])


def total_matches(findings: str = "findings") -> Column:
    return _sum(findings, count_of)


def severity_count(severity: str, findings: str = "findings") -> Column:
    return _sum(
        findings, lambda f: F.when(f["severity"] == severity, count_of(f)).otherwise(F.lit(0))
    )


def categories(findings: str = "findings") -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.col(findings), lambda f: f["category"])))


def band(value: Column, limits: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """Label of the first limit the value reaches (limits in falling order)."""
    out = None
    for limit, label in limits:
        hit = value >= limit
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(otherwise)


def indicator_level(score: Column) -> Column:
    return band(score, [(200, "CRITICAL"), (100, "HIGH"), (30, "MEDIUM")], "LOW")


def suspicious_level(score: Column) -> Column:
    return band(score, [(100, "Critical"), (50, "High"), (20, "Medium")], "Low")


def severity_filter(scanned: DataFrame, severities: Sequence[str], findings: str = "findings"):
    """Keep findings of the given severities; texts left without any are dropped."""
    kept = F.filter(F.col(findings), lambda f: f["severity"].isin(list(severities)))
    return scanned.withColumn(findings, kept).filter(F.size(findings) > 0)


def summarize(scanned: DataFrame, level=indicator_level, findings: str = "findings") -> DataFrame:
    """Score, level, totals and severity counts of each text, inside its own row."""
    out = scanned.withColumns(
        {
            "threat_score": threat_score(findings),
            "total_iocs": total_matches(findings),
            **{s.lower(): severity_count(s, findings) for s in SEVERITIES},
            "categories": categories(findings),
        }
    )
    return out.withColumn("threat_level", level(F.col("threat_score")))


def by_category(scanned: DataFrame, findings: str = "findings") -> DataFrame:
    """Texts, patterns and matches of each category (partial sums before the shuffle)."""
    return (
        explode_findings(scanned, findings)
        .groupBy("category")
        .agg(
            F.count("*").alias("findings"),
            F.sum("count").alias("matches"),
            F.sum(F.col("count") * F.col("weight")).alias("score"),
        )
    )


def by_severity(scanned: DataFrame, findings: str = "findings") -> DataFrame:
    """Totals per severity, from one row of counts per text."""
    return (
        explode_findings(scanned, findings)
        .groupBy("severity")
        .agg(F.count("*").alias("findings"), F.sum("count").alias("matches"))
        .withColumn("severity_rank", severity_rank(F.col("severity")))
    )


def severity_rank(severity: Column) -> Column:
    rank = F.lit(len(SEVERITIES))
    for position, name in reversed(list(enumerate(SEVERITIES))):
        rank = F.when(F.upper(severity) == name, position).otherwise(rank)
    return rank


def custom_scan(
    df: DataFrame, patterns: dict[str, str], text: str = "text", multiline: bool = False,
    ascii_classes: bool = False,
) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Scan with the caller's expressions.

    Returns the scan and the (name, error) pairs of expressions the JVM rejects; a
    bad expression is reported, it does not fail the job.
    """
    good, bad = [], []
    pattern_class = df.sparkSession._jvm.java.util.regex.Pattern
    for name, regex in patterns.items():
        try:
            pattern_class.compile(java_regex(regex, True, multiline, ascii_classes))
            good.append(Pattern("custom", "custom", name, regex, multiline))
        except Exception as error:  # the JVM reports a PatternSyntaxException
            bad.append((name, str(error).splitlines()[0]))
    return scan(df, good, text, ascii_classes=ascii_classes), bad
