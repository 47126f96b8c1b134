"""The four clocks found in evidence, as UTC timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Distance of each epoch from 1970-01-01.
MICROS_1601_TO_1970 = 11_644_473_600_000_000
SECONDS_1970_TO_2001 = 978_307_200
MICROS_1970_TO_2101 = 4_133_980_800_000_000


def filetime(value: Column) -> Column:
    """100 ns ticks since 1601; zero and times after 2100 are missing."""
    ticks = value.cast("bigint")
    micros = F.call_function("div", ticks, F.lit(10)) - F.lit(MICROS_1601_TO_1970)
    return F.when(
        (ticks > 0) & (micros < MICROS_1970_TO_2101), F.timestamp_micros(micros)
    )


def chromium_time(value: Column) -> Column:
    """Microseconds since 1601; zero is missing."""
    return F.when(value != 0, F.timestamp_micros(value - F.lit(MICROS_1601_TO_1970)))


def unix_micros(value: Column) -> Column:
    return F.when(value != 0, F.timestamp_micros(value))


def core_foundation(value: Column) -> Column:
    """Seconds, with a fraction, since 2001; zero is missing."""
    micros = F.round((value + F.lit(SECONDS_1970_TO_2001)) * 1_000_000).cast("bigint")
    return F.when(value != 0, F.timestamp_micros(micros))


def display(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("N/A"))
