"""Sizes for people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit names.
UNITS = ["B", "KB", "MB", "GB", "TB", "PB"]


def _fixed(value: Column, digits: int, unit: str) -> Column:
    """A number with its unit; a tie rounds to the even digit."""
    return F.format_string(f"%.{digits}f {unit}", F.bround(value, digits))


def human_size(size: Column, last_unit: str = "TB", zero: str | None = "0 B") -> Column:
    """Two decimals and the largest unit below 1024, up to ``last_unit``."""
    value = size.cast("double")
    last = UNITS.index(last_unit)
    out = _fixed(value / F.lit(float(1024**last)), 2, last_unit)
    for power in reversed(range(last)):
        text = _fixed(value / F.lit(float(1024**power)), 2, UNITS[power])
        out = F.when(value < float(1024 ** (power + 1)), text).otherwise(out)
    return out if zero is None else F.when(size == 0, zero).otherwise(out)


def short_size(size: Column) -> Column:
    """Whole bytes, or one decimal of KB or MB."""
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024**2, _fixed(size / F.lit(1024.0), 1, "KB"))
        .otherwise(_fixed(size / F.lit(1024.0**2), 1, "MB"))
    )


def size_mb(size: Column) -> Column:
    return F.bround(size / F.lit(float(1024**2)), 2)
