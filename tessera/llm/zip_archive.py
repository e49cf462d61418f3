"""ZIP containers of stored members: a small writer, and a reader that only reads ranges.

The reader finds the end record, the ZIP64 end record where there is one, and walks the central
directory; the bytes of a member are then a range of the file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

Read = Callable[[int, int], bytes]
_LIMIT16, _LIMIT32 = 0xFFFF, 0xFFFFFFFF


@dataclass(frozen=True)
class Member:
    name: str
    method: int  # 0: stored
    crc: int
    compressed: int
    size: int
    header: int  # where the local header begins


def write_stored(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP file of stored members; ``zip64`` writes the ZIP64 records even where not needed."""
    out, directory = bytearray(), bytearray()
    for name, data in members:
        label, crc, at = name.encode(), zlib.crc32(data), len(out)
        wide = zip64 or len(data) >= _LIMIT32 or at >= _LIMIT32
        size = _LIMIT32 if wide else len(data)
        local = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if wide else b""
        out += struct.pack("<4s5H3L2H", b"PK\x03\x04", 45 if wide else 20, 0x800, 0, 0, 0x21, crc, size, size, len(label), len(local)) + label + local
        out += data
        central = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if wide else b""
        directory += struct.pack(
            "<4s6H3L5H2L", b"PK\x01\x02", 45, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, size, size, len(label), len(central), 0, 0, 0, 0, _LIMIT32 if wide else at
        ) + label + central
    at, n = len(out), len(members)
    out += directory
    if zip64 or n >= _LIMIT16 or at >= _LIMIT32:
        end = len(out)
        out += struct.pack("<4sQ2H2L4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, len(directory), at)
        out += struct.pack("<4sLQL", b"PK\x06\x07", 0, end, 1)
        n, at, size = _LIMIT16, _LIMIT32, _LIMIT32
    else:
        size = len(directory)
    return bytes(out + struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, n, n, size, at, 0))


def directory(read: Read, length: int) -> dict[str, Member]:
    """Members by name, from the central directory at the end of a file of ``length`` bytes."""
    tail_at = max(0, length - 65557)
    tail = read(tail_at, length - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and end + 22 + int.from_bytes(tail[end + 20 : end + 22], "little") != len(tail):
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise ValueError("no end of a central directory")
    n, size, at = struct.unpack("<H2L", tail[end + 10 : end + 20])
    if _LIMIT16 == n or _LIMIT32 in (size, at):
        locator = read(tail_at + end - 20, 20)
        if locator[:4] == b"PK\x06\x07":
            record = read(struct.unpack("<Q", locator[8:16])[0], 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record where its locator points")
            n, size, at = struct.unpack("<3Q", record[32:56])
    data, found, i = read(at, size), {}, 0
    for _ in range(n):
        if data[i : i + 4] != b"PK\x01\x02":
            raise ValueError("the central directory is damaged")
        method, = struct.unpack("<H", data[i + 10 : i + 12])
        crc, compressed, plain = struct.unpack("<3L", data[i + 16 : i + 28])
        name_n, extra_n, note_n = struct.unpack("<3H", data[i + 28 : i + 34])
        header, = struct.unpack("<L", data[i + 42 : i + 46])
        name = data[i + 46 : i + 46 + name_n].decode()
        extra = data[i + 46 + name_n : i + 46 + name_n + extra_n]
        while len(extra) >= 4:
            kind, n_bytes = struct.unpack("<HH", extra[:4])
            if kind == 1:
                wide = list(struct.unpack(f"<{n_bytes // 8}Q", extra[4 : 4 + n_bytes // 8 * 8]))
                plain = wide.pop(0) if plain == _LIMIT32 else plain
                compressed = wide.pop(0) if compressed == _LIMIT32 else compressed
                header = wide.pop(0) if header == _LIMIT32 else header
            extra = extra[4 + n_bytes :]
        found[name] = Member(name, method, crc, compressed, plain, header)
        i += 46 + name_n + extra_n + note_n
    return found


def data_offset(read: Read, member: Member) -> int:
    """Where a stored member's bytes begin; the local header may have other extra fields."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed; its records cannot be read by range")
    local = read(member.header, 30)
    if local[:4] != b"PK\x03\x04":
        raise ValueError(f"no local header of {member.name}")
    name_n, extra_n = struct.unpack("<2H", local[26:30])
    return member.header + 30 + name_n + extra_n
