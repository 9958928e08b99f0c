"""MPEG audio streams: a writer that carries bytes losslessly, and a reader for any layer and version.

The writer makes MPEG-1 Layer III, 48 kHz, mono, with checksums. Side information says that no
Huffman-coded data follow, so a player hears silence, and the bytes after it are ancillary data:
there the payload goes, in units of 192 bytes, one to four in a frame of 80, 160, 224 or 320 kbit/s.
Before the frames stand an ID3v2 tag and a frame with a variable-bitrate table.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import lru_cache

UNIT = 192
RATE, SIDE = 48_000, 17
#: units in a frame: (bitrate index, frame length)
BY_UNITS = {1: (6, 240), 2: (10, 480), 3: (12, 672), 4: (14, 960)}

_KBPS = {  # (MPEG-1?, layer): by bitrate index
    (True, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (True, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (True, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (False, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (False, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (False, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
_RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


_CRC = _crc_table()


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    c = 0xFFFF
    for b in data:
        c = (c << 8 & 0xFF00) ^ _CRC[c >> 8 ^ b]
    return c


@dataclass(frozen=True)
class Header:
    """What four bytes say of their frame."""

    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    kbps: int
    rate: int
    length: int
    samples: int
    checked: bool
    mono: bool
    bound: int  # subbands from here on are coded for both channels together (Layers I and II)

    @property
    def side(self) -> int:
        """Bytes of side information (Layer III)."""
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


@lru_cache(maxsize=4096)
def header(four: bytes) -> Header | None:
    """The frame that the four bytes begin, or None."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    index, rate = four[2] >> 4, four[2] >> 2 & 3
    if version == 1 or layer == 4 or index in (0, 15) or rate == 3:
        return None
    kbps, hz, pad = _KBPS[version == 3, layer][index], _RATES[version][rate], four[2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
    length = (12_000 * kbps // hz + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // hz + pad
    mode, joint = four[3] >> 6, 4 * (four[3] >> 4 & 3) + 4
    return Header(version, layer, kbps, hz, length, samples, not four[1] & 1, mode == 3, joint if mode == 1 else 32)


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _frame_start(index: int, side: bytes = bytes(SIDE)) -> bytes:
    head = bytes((0xFF, 0xFA, index << 4 | 1 << 2, 0xC0))
    return head + struct.pack(">H", crc16(head[2:] + side)) + side


_STARTS = {u: _frame_start(index) for u, (index, _) in BY_UNITS.items()}


def write(payload: bytes, tags: dict[str, str]) -> bytes:
    """A stream that carries ``payload``, a positive multiple of 192 bytes long; tags go into ID3v2 TXXX frames."""
    if not payload or len(payload) % UNIT:
        raise ValueError("the payload must be a positive multiple of 192 bytes")
    units = len(payload) // UNIT
    plan = [4] * (units // 4) + [units % 4] * (units % 4 > 0)
    body = b"".join(b"TXXX" + _syncsafe(len(v)) + b"\0\0" + v for v in (b"\3" + k.encode() + b"\0" + t.encode() for k, t in tags.items()))
    tag = b"ID3\4\0\0" + _syncsafe(len(body)) + body
    audio = 240 + sum(BY_UNITS[u][1] for u in (set(plan) and plan[-1:])) + 960 * (len(plan) - 1)
    # The table: for each hundredth of the time, the place as 256ths of the bytes. All but the last frame are of one length.
    toc = bytes(min(255, 256 * (240 + 960 * (len(plan) * p // 100)) // audio) for p in range(100))
    table = b"Xing" + struct.pack(">III", 7, len(plan), audio) + toc
    parts = [tag, (_STARTS[1] + table).ljust(240, b"\0")]
    at = 0
    for u in plan:
        size = u * UNIT
        parts += (_STARTS[u], payload[at : at + size], bytes(BY_UNITS[u][1] - 6 - SIDE - size))
        at += size
    return b"".join(parts)


@dataclass
class Stream:
    """What a stream holds. Offsets are those of audio frames; a frame with a variable-bitrate table is none."""

    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    version: int = 0
    layer: int = 0
    kbps: set = field(default_factory=set)
    checked: int = 0
    broken: int = 0
    skipped: int = 0  # bytes passed over until the next frame
    vbr_frames: int | None = None
    vbr_bytes: int | None = None
    toc: bytes = b""
    payload: list = field(default_factory=list)


def _read_tag(data: bytes, out: Stream) -> int:
    """Parse an ID3v2 tag; its length."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    size = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    end, at = 10 + size(data[6:10]), 10
    while at + 10 <= min(end, len(data)) and data[at]:
        n = size(data[at + 4 : at + 8]) if data[3] == 4 else int.from_bytes(data[at + 4 : at + 8])
        kind, value = data[at : at + 4], data[at + 10 : at + 10 + n]
        if kind[:1] == b"T" and value[:1] in (b"\0", b"\3"):
            words = value[1:].decode("utf-8" if value[0] == 3 else "latin-1", "replace").split("\0")
            out.tags[words[0] if kind == b"TXXX" else kind.decode("latin-1")] = words[1] if kind == b"TXXX" and len(words) > 1 else words[0]
        at += 10 + n
    return end


def _layer2_table(h: Header) -> tuple[list[int], int]:
    """Bits of each subband's allocation, and from which subband on both channels share it."""
    if h.version != 3:
        widths = [4] * 4 + [3] * 7 + [2] * 19
    else:
        each = h.kbps // (1 if h.mono else 2)
        if each <= 48:
            widths = [4] * 2 + [3] * (10 if h.rate == 32_000 else 6)
        elif h.rate == 48_000 or each <= 80:
            widths = [4] * 11 + [3] * 12 + [2] * 4
        else:
            widths = [4] * 11 + [3] * 12 + [2] * 7
    return widths, min(len(widths), h.bound)


def _covered_bits(h: Header, data: bytes, at: int) -> int:
    """How many bits from ``at`` on, behind the checksum, the checksum covers."""
    channels = 1 if h.mono else 2
    if h.layer == 3:
        return 8 * h.side
    if h.layer == 1:
        return 4 * (channels * h.bound + 32 - h.bound)
    widths, bound = _layer2_table(h)
    value, place, used = int.from_bytes(data[at : at + 64].ljust(64, b"\0")), 512, 0
    for i, w in enumerate(widths):
        shared = i >= bound
        for _ in range(1 if shared else channels):
            place -= w
            if value >> place & ((1 << w) - 1):
                used += 2 * (channels if shared else 1)
    return 512 - place + used


def checksum_holds(h: Header, data: bytes, at: int) -> bool:
    """Whether the stored checksum of the frame at ``at`` is that of its header and side information or allocation."""
    bits = _covered_bits(h, data, at + 6)
    whole, rest = divmod(bits, 8)
    c = crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + whole])
    for k in range(rest):
        bit = data[at + 6 + whole] >> 7 - k & 1 if at + 6 + whole < len(data) else 0
        c = (c << 1 ^ (0x8005 if (c >> 15 ^ bit) & 1 else 0)) & 0xFFFF
    return c == int.from_bytes(data[at + 4 : at + 6])


def _table(h: Header, data: bytes, at: int, start: int, out: Stream) -> bool:
    """Parse a Xing/Info table behind the side information or a VBRI table 32 bytes behind the header; whether there is one."""
    if data[start : start + 4] in (b"Xing", b"Info"):
        flags, place = int.from_bytes(data[start + 4 : start + 8]), start + 8
        out.vbr_frames = 0
        if flags & 1:
            out.vbr_frames, place = int.from_bytes(data[place : place + 4]), place + 4
        if flags & 2:
            out.vbr_bytes, place = int.from_bytes(data[place : place + 4]), place + 4
        if flags & 4:
            out.toc = data[place : place + 100]
        return True
    place = at + 36
    if data[place : place + 4] == b"VBRI" and place + 26 <= at + h.length:
        out.vbr_bytes, out.vbr_frames, entries, _, width = struct.unpack(">IIHHH", data[place + 10 : place + 24])
        out.toc = data[place + 26 : min(at + h.length, place + 26 + entries * width)]
        return True
    return False


def read(data: bytes) -> Stream:
    """Every frame of ``data``; where bytes are no frame, the next place where a frame and what follows it agree.

    Frames come first: ``TAG`` 128 bytes before the end is an ID3v1 tag only where no frame spans it.
    A stream without frames has rate 0 and no payload.
    """
    out = Stream()
    at, end = _read_tag(data, out), len(data)
    tag = end - 128 if end >= 128 and data[-128:-125] == b"TAG" else end

    def skip(at: int) -> int:
        to = data.find(b"\xff", at + 1, end)
        to = end if to < 0 else to
        if at < tag < to:
            to = tag
        out.skipped += to - at
        return to

    ends = lambda place: place in (tag, end)
    while at < end and at != tag:
        h = header(data[at : at + 4])
        if h is None or at + h.length > end:
            at = skip(at)
            continue
        follows = ends(at + h.length) or header(data[at + h.length : at + h.length + 4]) is not None
        if out.skipped and not out.offsets and not follows:
            at = skip(at)
            continue
        start = at + 4 + 2 * h.checked + h.side
        if h.checked:
            good = checksum_holds(h, data, at)
            if not good and not follows:  # neither its checksum nor what follows it says that this is a frame
                at = skip(at)
                continue
            out.checked += good
            out.broken += not good
        if out.offsets or out.vbr_frames is not None or h.layer != 3 or not _table(h, data, at, start, out):
            out.offsets.append(at)
            out.lengths.append(h.length)
            out.samples += h.samples
            out.rate, out.version, out.layer = h.rate, h.version, h.layer
            out.kbps.add(h.kbps)
            units = (h.length - (start - at)) // UNIT
            out.payload.append(data[start : start + units * UNIT])
        at += h.length
    return out
