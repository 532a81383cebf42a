"""MOBI and AZW3: a Palm database whose first record holds a MOBI header and, after it, EXTH records."""

from __future__ import annotations

import struct

from .images import sniff
from .record import Found, Unreadable, year_of

# Offsets in the database and in record 0, and types of EXTH records.
RECORDS_AT, HEADER_AT, HAS_EXTH = 78, 16, 0x40
AUTHOR, SUBJECT, DATE, TITLE = 100, 105, 106, 503


def _u32(data: bytes, at: int) -> int:
    return struct.unpack_from(">I", data, at)[0]


def _text(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def _offsets(data: bytes) -> list[int]:
    n = struct.unpack_from(">H", data, RECORDS_AT - 2)[0]
    return [_u32(data, RECORDS_AT + 8 * i) for i in range(n) if RECORDS_AT + 8 * i + 4 <= len(data)] if n else []


def _exth(record: bytes, at: int) -> dict[int, bytes]:
    """Records by type, the last of a type; what comes before a broken one is kept."""
    out: dict[int, bytes] = {}
    if record[at : at + 4] != b"EXTH" or at + 12 > len(record):
        return out
    left, at = _u32(record, at + 8), at + 12
    while left and at + 8 <= len(record):
        kind, size = struct.unpack_from(">II", record, at)
        if size < 8 or at + size > len(record):
            break
        out[kind] = record[at + 8 : at + size]
        left, at = left - 1, at + size
    return out


def _cover(data: bytes, offsets: list[int]) -> tuple[bytes, str] | None:
    """The first record after the header that is an image."""
    for start, end in zip(offsets[1:], [*offsets[2:], len(data)], strict=False):
        if start < end <= len(data) and (kind := sniff(data[start:end])):
            return data[start:end], kind
    return None


def extract(data: bytes, cover: bool = False) -> Found:
    if len(data) < RECORDS_AT + 4:
        raise Unreadable("mobi: file too short")
    offsets = _offsets(data)
    if not offsets or offsets[0] >= len(data):
        raise Unreadable("mobi: no first record")
    record = data[offsets[0] :]
    if len(record) < HEADER_AT + 104 or record[HEADER_AT : HEADER_AT + 4] != b"MOBI":
        raise Unreadable("mobi: no MOBI header")
    out = Found()
    name_at, name_size = _u32(record, HEADER_AT + 96), _u32(record, HEADER_AT + 100)
    if name_at + name_size <= len(record):
        out.title = _text(record[name_at : name_at + name_size])
    if _u32(record, HEADER_AT + 84) & HAS_EXTH:
        found = _exth(record, HEADER_AT + _u32(record, HEADER_AT + 4))
        out.title = _text(found[TITLE]) if TITLE in found else out.title
        out.author, out.subject = _text(found.get(AUTHOR, b"")), _text(found.get(SUBJECT, b""))
        out.year = year_of(_text(found.get(DATE, b"")))
    declared = struct.unpack_from(">H", data, RECORDS_AT - 2)[0]
    if cover and declared == len(offsets) and (image := _cover(data, offsets)):
        out.cover, out.content_type = image
    return out
