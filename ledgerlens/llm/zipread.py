"""Reading stored members of ZIP files through range reads: directories first, then bytes."""

from __future__ import annotations

import struct
from dataclasses import dataclass

END = b"PK\x05\x06"
END64_PLACE = b"PK\x06\x07"
END64 = b"PK\x06\x06"
CENTRAL = b"PK\x01\x02"
LOCAL = b"PK\x03\x04"
FULL = 0xFFFFFFFF


class BadArchive(ValueError):
    """The file is no ZIP file, is cut off, or holds what cannot be range-read."""


@dataclass(frozen=True)
class Member:
    name: str
    offset: int
    size: int
    crc: int
    method: int


def _need(raw: bytes, size: int, what: str) -> bytes:
    if len(raw) < size:
        raise BadArchive(f"{what} is cut off")
    return raw


def directory(read_at, size: int) -> tuple[int, int, int]:
    """Offset, size and entries of the central directory; ``read_at(offset, length)`` reads."""
    tail_size = min(size, 22 + 65_535 + 20)
    tail = read_at(size - tail_size, tail_size)
    at = tail.rfind(END)
    while at >= 0:
        # The comment after the record must end the file, or the mark is part of other bytes.
        if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise BadArchive("no end of central directory")
    entries, length, offset = struct.unpack_from("<HLL", tail, at + 10)
    if entries == 0xFFFF or FULL in (length, offset):
        place = size - tail_size + at - 20
        if place < 0:
            raise BadArchive("no ZIP64 locator")
        raw = _need(read_at(place, 20), 20, "ZIP64 locator")
        if raw[:4] == END64_PLACE:
            where = struct.unpack_from("<Q", raw, 8)[0]
            raw = _need(read_at(where, 56), 56, "ZIP64 end of central directory")
            if raw[:4] != END64:
                raise BadArchive("no ZIP64 end of central directory")
            entries, length, offset = struct.unpack_from("<QQQ", raw, 32)
    return offset, length, entries


def members(read_at, size: int) -> list[Member]:
    """All entries of the central directory, with sizes and offsets from ZIP64 fields if need be."""
    offset, length, entries = directory(read_at, size)
    raw = _need(read_at(offset, length), length, "central directory")
    found, at = [], 0
    for _ in range(entries):
        if raw[at : at + 4] != CENTRAL or at + 46 > len(raw):
            raise BadArchive("bad central directory entry")
        flags, method = struct.unpack_from("<HH", raw, at + 8)
        crc, packed, plain, name_size, extra_size, comment_size = struct.unpack_from(
            "<LLLHHH", raw, at + 16
        )
        (start,) = struct.unpack_from("<L", raw, at + 42)
        name = raw[at + 46 : at + 46 + name_size]
        extra = raw[at + 46 + name_size : at + 46 + name_size + extra_size]
        plain, packed, start = _wide(extra, plain, packed, start)
        found.append(
            Member(name.decode("utf-8" if flags & 0x800 else "cp437"), start, plain, crc, method)
        )
        at += 46 + name_size + extra_size + comment_size
    return found


def _wide(extra: bytes, plain: int, packed: int, start: int) -> tuple[int, int, int]:
    """Fields that do not fit 32 bits stand in a ZIP64 extra field, in this order."""
    at = 0
    while at + 4 <= len(extra):
        tag, size = struct.unpack_from("<HH", extra, at)
        if tag == 1:
            field, values = extra[at + 4 : at + 4 + size], []
            for value in (plain, packed, start):
                if value == FULL:
                    value, field = struct.unpack_from("<Q", field)[0], field[8:]
                values.append(value)
            return tuple(values)
        at += 4 + size
    return plain, packed, start


def data_offset(read_at, member: Member) -> int:
    """Where the bytes of a stored member begin; its local header may have another extra field."""
    if member.method != 0:
        raise BadArchive(f"{member.name} is compressed and cannot be range-read")
    raw = _need(read_at(member.offset, 30), 30, "local header")
    if raw[:4] != LOCAL:
        raise BadArchive(f"no local header of {member.name}")
    name_size, extra_size = struct.unpack_from("<HH", raw, 26)
    return member.offset + 30 + name_size + extra_size
