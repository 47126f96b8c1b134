"""File names, extensions and path tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidlake.functions.text import any_contains


def unix_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def base_name(path: Column) -> Column:
    return F.substring_index(unix_path(path), "/", -1)


def parent_dir(path: Column) -> Column:
    """Everything before the last separator; ``Root`` for a bare name."""
    whole = unix_path(path)
    return F.when(
        F.contains(whole, F.lit("/")), F.regexp_replace(whole, "/[^/]*$", "")
    ).otherwise("Root")


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, empty when there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"[^.](\.[^.]*)$", 1))


def has_extension(path: Column, extensions: list[str]) -> Column:
    return extension(path).isin([e.lower() for e in extensions])


def in_risky_place(path: Column, places: list[str]) -> Column:
    return any_contains(F.lower(path), [p.lower() for p in places])


def under_any(path: Column, prefixes: list[str]) -> Column:
    """Path lies under one of the prefixes, whatever the case."""
    hit = F.lit(False)
    for prefix in prefixes:
        hit = hit | F.startswith(F.lower(path), F.lit(prefix.lower()))
    return hit


def has_dir(path: Column, names: list[str]) -> Column:
    """One of the directories on the path has one of the names."""
    dirs = F.slice(F.split(unix_path(path), "/"), F.lit(1),
                   F.greatest(F.size(F.split(unix_path(path), "/")) - 1, F.lit(0)))
    return F.arrays_overlap(dirs, F.array(*[F.lit(n) for n in names]))
