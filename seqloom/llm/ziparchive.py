"""ZIP archives of stored members: a writer, and a reader that needs only ranges of bytes.

The reader parses the end record, the ZIP64 locator and end record where there are any, and the
central directory; a stored member is then a range of the archive, and so is any part of it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

_FULL32, _FULL16 = 0xFFFFFFFF, 0xFFFF


def write(members: list[tuple[str, bytes]], zip64: bool = False, comment: bytes = b"") -> bytes:
    """An archive of stored members. ZIP64 fields are used where sizes need them, or everywhere if asked for."""
    parts, directory, at = [], [], 0
    for name, data in members:
        raw, crc, n = name.encode(), zlib.crc32(data), len(data)
        wide = zip64 or n >= _FULL32 or at >= _FULL32
        size = _FULL32 if wide else n
        local_extra = struct.pack("<HHQQ", 1, 16, n, n) if wide else b""
        local = struct.pack("<4s5H3I2H", b"PK\3\4", 45 if wide else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(local_extra)) + raw + local_extra
        extra = struct.pack("<HHQQQ", 1, 24, n, n, at) if wide else b""
        directory.append(struct.pack("<4s6H3I5H2I", b"PK\1\2", 45, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, _FULL32 if wide else at) + raw + extra)
        parts += (local, data)
        at += len(local) + n
    central = b"".join(directory)
    end = b""
    if zip64 or len(members) >= _FULL16 or at >= _FULL32:
        end = struct.pack("<4sQ2H2I4Q", b"PK\6\6", 44, 45, 45, 0, 0, len(members), len(members), len(central), at) + struct.pack("<4sIQI", b"PK\6\7", 0, at + len(central), 1)
        counts = (_FULL16, _FULL16, _FULL32, _FULL32)
    else:
        counts = (len(members), len(members), len(central), at)
    return b"".join([*parts, central, end, struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, *counts, len(comment)), comment])


@dataclass
class Member:
    name: str
    method: int
    size: int
    crc: int
    header_at: int


class Archive:
    """``read_at(offset, length)`` gives bytes of an archive of ``size`` bytes."""

    def __init__(self, read_at: Callable[[int, int], bytes], size: int):
        self.read_at, self.size = read_at, size
        self.members = {m.name: m for m in self._directory()}

    def _directory(self) -> list[Member]:
        tail_at = max(0, self.size - 22 - _FULL16)
        tail = self.read_at(tail_at, self.size - tail_at)
        at = tail.rfind(b"PK\5\6")
        while at >= 0 and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail):
            at = tail.rfind(b"PK\5\6", 0, at)  # those signs within the comment
        if at < 0:
            raise ValueError("no end of a central directory")
        _, _, _, _, n, length, start, _ = struct.unpack("<4s4H2IH", tail[at : at + 22])
        if _FULL16 == n or _FULL32 in (length, start):
            locator = self.read_at(tail_at + at - 20, 20) if tail_at + at >= 20 else b""
            if locator[:4] == b"PK\6\7":
                end = self.read_at(int.from_bytes(locator[8:16], "little"), 56)
                if end[:4] != b"PK\6\6":
                    raise ValueError("no ZIP64 end record where the locator says")
                n, length, start = struct.unpack("<3Q", end[32:56])
        raw, out, at = self.read_at(start, length), [], 0
        for _ in range(n):
            if raw[at : at + 4] != b"PK\1\2":
                raise ValueError("the central directory is broken")
            method, crc, packed, size, n_name, n_extra, n_comment, header_at = struct.unpack("<10xH4xIIIHHH8xI", raw[at : at + 46])
            name, extra = raw[at + 46 : at + 46 + n_name].decode(), raw[at + 46 + n_name : at + 46 + n_name + n_extra]
            k = 0
            while k + 4 <= len(extra):
                kind, m = struct.unpack("<HH", extra[k : k + 4])
                if kind == 1:  # 64-bit values, only of the fields that are full
                    wide = iter(struct.unpack(f"<{m // 8}Q", extra[k + 4 : k + 4 + m // 8 * 8]))
                    size = next(wide) if size == _FULL32 else size
                    packed = next(wide) if packed == _FULL32 else packed
                    header_at = next(wide) if header_at == _FULL32 else header_at
                k += 4 + m
            out.append(Member(name, method, size, crc, header_at))
            at += 46 + n_name + n_extra + n_comment
        return out

    def place(self, name: str) -> tuple[int, int]:
        """Offset and length of a stored member's bytes in the archive."""
        m = self.members[name]
        if m.method:
            raise ValueError(f"{name} is compressed; ranges of it cannot be read")
        head = self.read_at(m.header_at, 30)
        if head[:4] != b"PK\3\4":
            raise ValueError(f"no local header for {name}")
        return m.header_at + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"), m.size

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        at, size = self.place(name)
        return self.read_at(at + offset, max(0, min(size - offset, size if length is None else length)))


def of_bytes(data: bytes) -> Archive:
    view = memoryview(data)
    return Archive(lambda at, n: bytes(view[at : at + n]), len(data))


def of_uri(uri: str) -> Archive:
    """An archive in any store that Arrow's file systems reach (or a local path); only the ranges asked for are read."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    f = where.open_input_file(path)
    return Archive(lambda at, n: bytes(f.read_at(min(n, max(0, f.size() - at)), at)), f.size())
