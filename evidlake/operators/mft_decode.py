"""Raw 1024-byte file records to rows.

Walking the attributes of a record has no SQL form, so a small function decodes
one record inside ``mapInPandas``; Spark reads, splits and spreads the records.
Times leave the function as raw ticks and become timestamps in the JVM.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidlake.functions.times import filetime

# On-disk layout of the record and its attributes.
HEADER = struct.Struct("<4sHH8xHHHHII")
ATTRIBUTE = struct.Struct("<IIBBH")
SI_TYPE, FN_TYPE, DATA_TYPE, END_TYPE = 0x10, 0x30, 0x80, 0xFFFFFFFF
IN_USE, DIRECTORY = 1, 2
LONG_NAME_SPACES = (1, 3)
MAX_LONG = 2**63 - 1

TIMES = ["si_created", "si_modified", "si_mft_modified", "si_accessed",
         "fn_created", "fn_modified"]

RAW_SCHEMA = (
    "volume string, entry_number long, sequence_number int, is_directory boolean, "
    "is_deleted boolean, "
    + ", ".join(f"{t} long" for t in TIMES)
    + ", filename string, parent_reference long, parent_sequence int, logical_size long, "
    "physical_size long, is_resident boolean, data_runs array<struct<start:long,n:long>>, "
    "ads_streams array<string>, resident_data binary"
)


def apply_fixup(record: bytes, offset: int, count: int) -> bytes:
    """Put back the two bytes each 512-byte sector gave up to the update sequence."""
    data = bytearray(record)
    mark = record[offset:offset + 2]
    for sector in range(1, count):
        end = sector * 512
        saved = record[offset + 2 * sector:offset + 2 * sector + 2]
        if end <= len(data) and len(saved) == 2 and data[end - 2:end] == mark:
            data[end - 2:end] = saved
    return bytes(data)


def data_runs(data: bytes, pos: int, end: int) -> list[dict]:
    """Cluster runs; each start is relative to the one before, and a run without an offset
    keeps it."""
    runs, start = [], 0
    while pos < end and data[pos]:
        n_len, n_off = data[pos] & 15, data[pos] >> 4
        body = data[pos + 1:pos + 1 + n_len + n_off]
        if not n_len or len(body) < n_len + n_off:
            break
        start += int.from_bytes(body[n_len:], "little", signed=True)
        runs.append({"start": start, "n": int.from_bytes(body[:n_len], "little")})
        pos += 1 + n_len + n_off
    return runs


def attributes(data: bytes, pos: int) -> Iterator[tuple]:
    """(type, non-resident, name, offset, length); stops at the end mark or a bad length."""
    while pos + 24 <= len(data):
        kind, length, non_resident, name_chars, name_at = ATTRIBUTE.unpack_from(data, pos)
        if kind == END_TYPE or length < 24:
            return
        name = data[pos + name_at:pos + name_at + 2 * name_chars].decode("utf-16le", "ignore")
        yield kind, non_resident, name, pos, length
        pos += length


def _ticks(values) -> list:
    return [v if 0 < v <= MAX_LONG else None for v in values]


def decode_record(record: bytes) -> dict | None:
    """Row of one record, or None when it is not a record."""
    if len(record) < 48 or record[:4] not in (b"FILE", b"BAAD"):
        return None
    _, fix_at, fix_n, sequence, _, first, flags, _, _ = HEADER.unpack_from(record)
    data = apply_fixup(record, fix_at, fix_n)
    row = dict.fromkeys(TIMES)
    row.update(
        sequence_number=sequence, is_directory=bool(flags & DIRECTORY),
        is_deleted=not flags & IN_USE, filename="", parent_reference=0, parent_sequence=0,
        logical_size=0, physical_size=0, is_resident=False, data_runs=[], ads_streams=[],
        resident_data=None,
    )
    for kind, non_resident, name, pos, length in attributes(data, first):
        content = b""
        if not non_resident:
            size, at = struct.unpack_from("<IH", data, pos + 16)
            content = data[pos + at:pos + at + size]
        if kind == SI_TYPE and len(content) >= 48:
            row.update(zip(TIMES[:4], _ticks(struct.unpack_from("<4Q", content))))
        elif kind == FN_TYPE and len(content) >= 66:
            row.update(zip(TIMES[4:], _ticks(struct.unpack_from("<2Q", content, 8))))
            if content[65] in LONG_NAME_SPACES or not row["filename"]:
                parent = struct.unpack_from("<Q", content)[0]
                row.update(
                    filename=content[66:66 + 2 * content[64]].decode("utf-16le", "ignore"),
                    parent_reference=parent & (2**48 - 1),
                    parent_sequence=parent >> 48,
                    logical_size=min(struct.unpack_from("<Q", content, 48)[0], MAX_LONG),
                )
        elif kind == DATA_TYPE and name:
            row["ads_streams"].append(name)
        elif kind == DATA_TYPE and non_resident and pos + 64 <= len(data):
            run_at, = struct.unpack_from("<H", data, pos + 32)
            allocated, = struct.unpack_from("<Q", data, pos + 40)
            row.update(
                is_resident=False, physical_size=min(allocated, MAX_LONG),
                data_runs=data_runs(data, pos + run_at, min(pos + length, len(data))),
            )
        elif kind == DATA_TYPE and not non_resident:
            row.update(is_resident=True, physical_size=len(content), resident_data=content)
    return row


def _decode_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in RAW_SCHEMA.replace("start:long,n:long", "").split(", ")]
    for batch in batches:
        rows = []
        for volume, entry, record in zip(batch["volume"], batch["entry_number"], batch["record"]):
            row = decode_record(bytes(record))
            if row is not None:
                rows.append({"volume": volume, "entry_number": entry, **row})
        yield pd.DataFrame(rows, columns=columns)


def decode_mft(raw: DataFrame) -> DataFrame:
    """Rows of (volume, entry_number, record) to file records."""
    decoded = raw.select("volume", "entry_number", "record").mapInPandas(_decode_batches, RAW_SCHEMA)
    return decoded.withColumns({t: filetime(F.col(t)) for t in TIMES})
