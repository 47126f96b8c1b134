"""Little-endian numbers and byte tests on binary columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def le_number(data: Column, offset: int, size: int) -> Column:
    """Unsigned little-endian number of up to 8 bytes; NULL when it does not fit a long."""
    parts = [F.hex(F.substring(data, offset + i + 1, 1)) for i in reversed(range(size))]
    return F.conv(F.concat(*parts), 16, 10).try_cast("bigint")


def latin1(data: Column) -> Column:
    """One character per byte, so text functions can look at bytes."""
    return F.decode(data, "ISO-8859-1")


def starts_with_bytes(data: Column, hex_bytes: str) -> Column:
    return F.hex(F.substring(data, 1, len(hex_bytes) // 2)) == hex_bytes.upper()


def utf16_text(data: Column) -> Column:
    """UTF-16LE text without its trailing NULs."""
    return F.regexp_replace(F.decode(data, "UTF-16LE"), "\\x00+$", "")


def looks_like_memory(data: Column) -> Column:
    """At least 10 % non-zero, 5 % printable and 50 distinct bytes in the first 1000."""
    size = F.octet_length(data)
    chars = latin1(data)
    non_zero = F.length(F.replace(chars, F.lit("\x00"), F.lit("")))
    printable = F.length(F.regexp_replace(chars, "[^ -~]", ""))
    distinct = F.size(F.array_distinct(F.split(F.substring(chars, 1, 1000), "")))
    return (non_zero >= size * 0.1) & (printable >= size * 0.05) & (distinct >= 50)


def hex_dump(data: Column, max_bytes: int = 1024) -> Column:
    shown = F.lower(F.hex(F.substring(data, 1, max_bytes)))
    return F.trim(F.regexp_replace(shown, "(..)", "$1 "))


def is_text(data: Column) -> Column:
    """True when the first 100 bytes are printable or tab, line feed, carriage return."""
    return ~latin1(F.substring(data, 1, 100)).rlike(r"[^\t\n\r -~]")


def bit_is_set(data: Column, position: Column) -> Column:
    """Bit of a little-endian bit map; a position outside it counts as set."""
    byte = F.conv(F.hex(F.substring(data, (position / 8).cast("int") + 1, F.lit(1))), 16, 10)
    bit = F.call_function("shiftright", byte.try_cast("int"), F.pmod(position, F.lit(8)).cast("int"))
    inside = (position >= 0) & (position < F.octet_length(data) * 8)
    return F.when(inside, bit.bitwiseAND(1) == 1).otherwise(True)
