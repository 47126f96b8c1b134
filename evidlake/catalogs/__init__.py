"""Pattern catalogues as rows.

A catalogue is a list of :class:`Pattern`; ``as_table`` turns it into a DataFrame
and ``from_table`` reads one back, so adding a pattern is adding a row.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

from evidlake.catalogs import patterns
from evidlake.catalogs.lookups import SEVERITY_WEIGHT, SUSPICIOUS_CATEGORY

PATTERN_SCHEMA = (
    "catalog string, category string, name string, regex string, multiline boolean, "
    "severity string, description string, points int, weight int, enabled boolean"
)


@dataclass(frozen=True)
class Pattern:
    catalog: str
    category: str
    name: str
    regex: str
    multiline: bool = False
    severity: str = ""
    description: str = ""
    points: int = 0
    weight: int = 0
    enabled: bool = True


def extract_catalog() -> list[Pattern]:
    return [Pattern("extract", "extract", name, rx) for name, rx in patterns.EXTRACT]


def suspicious_catalog() -> list[Pattern]:
    out = []
    for category, name, rx, description in patterns.SUSPICIOUS:
        weight, severity = SUSPICIOUS_CATEGORY[category]
        out.append(
            Pattern("suspicious", category, name, rx, True, severity, description, 0, weight)
        )
    return out


def indicator_catalog(bug_compatible: bool = False) -> list[Pattern]:
    """Indicators; ``bug_compatible`` keeps a stray ``/i`` one expression once had."""
    out = [
        Pattern("ioc", category, name, rx, True, severity, description, 0,
                SEVERITY_WEIGHT[severity])
        for name, category, severity, rx, description in patterns.INDICATORS
    ]
    if bug_compatible:
        out = [replace(p, regex=p.regex + "/i") if p.name == "ransomware_note" else p for p in out]
    return out


def personal_catalog() -> list[Pattern]:
    return [
        Pattern("pii", category, name, rx, False, severity, description, points, points)
        for name, category, severity, points, rx, description in patterns.PERSONAL
    ]


def shipped_patterns() -> list[Pattern]:
    """All patterns that come with the library."""
    return [
        *extract_catalog(), *suspicious_catalog(), *indicator_catalog(), *indicator_catalog(True),
        *personal_catalog(),
    ]


def as_table(spark: SparkSession, catalog: list[Pattern]) -> DataFrame:
    return spark.createDataFrame([tuple(asdict(p).values()) for p in catalog], PATTERN_SCHEMA)


def from_table(table: DataFrame, max_patterns: int = 2000) -> list[Pattern]:
    """Read a pattern table. A catalogue becomes expressions in one plan, so it must be small."""
    names = [f.name for f in fields(Pattern)]
    rows = table.select(*names).limit(max_patterns + 1).collect()
    if len(rows) > max_patterns:
        raise ValueError(f"more than {max_patterns} patterns do not fit in one plan")
    return [Pattern(**r.asDict()) for r in rows]
