"""Row-level plan helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, keep: Sequence[str], columns: dict[str, Column]) -> DataFrame:
    """Compute costly columns exactly once per row.

    The optimizer copies a projected expression into every filter above it, and a
    generator into the filter it infers below. Rows made by an outer generator are
    the one place it does neither, so a later ``size(findings) > 0`` reads the array
    instead of scanning the text a second time.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*keep, F.inline_outer(F.array(row)))
