"""Baseline JPEG with numpy: a lossless writer of byte payloads, and a reader of sequential Huffman-coded files.

The writer's samples are the format's quantised coefficients: with all quantisers 1, each payload byte is one non-zero
coefficient, three blocks (Y, Cb, Cr of one 8 x 8 unit) hold 192 bytes, and every unit is a restart interval. Its
Huffman codes give magnitude category s a code of 8 - s bits, so that code and magnitude fill one byte.

The reader parses markers, splits the scan at restart markers and decodes all intervals of many files at once: every
step takes one symbol of each interval, by table look-up of the next 16 bits.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

UNIT = 192
COLUMNS = 64
#: Intervals decoded at once.
LANES = 16_384
#: Widest bit window: a code (16) and a magnitude (16).
_PAD = 8


def _coefficient(b: np.ndarray) -> np.ndarray:
    b = b.astype(np.int16)
    return np.where(b < 127, b - 127, b - 126)


def _byte(c: np.ndarray) -> np.ndarray:
    return np.where(c < 0, c + 127, c + 126).astype(np.uint8)


def _codes() -> np.ndarray:
    """The coded byte of each payload byte; those of category 8 have their magnitude in a second one."""
    c = _coefficient(np.arange(256)).astype(int)
    out = np.empty(256, np.uint8)
    for i, v in enumerate(c):
        s = int(abs(v)).bit_length()
        out[i] = 0xFE if s == 8 else (((1 << 7 - s) - 1) << 1) << s | (v if v > 0 else v + (1 << s) - 1)
    return out


_CODED = _codes()
_SECOND = {254: 0x80, 255: 0x81}  # coefficients 128 and 129, as magnitudes of category 8
_TABLE = bytes([1] * 8 + [0] * 8) + bytes([7, 6, 5, 4, 3, 2, 1, 8])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def encode(payload: bytes) -> bytes:
    """A baseline JPEG whose coefficients are the payload; its length must be a positive multiple of 192."""
    units, rest = divmod(len(payload), UNIT)
    if rest or not units:
        raise ValueError("the payload must be a positive multiple of 192 bytes")
    wide = min(units, COLUMNS)
    high = -(-units // wide)
    if high * 8 > 65535:
        wide = -(-units // 8191)
        high = -(-units // wide)
        if wide > 8191:
            raise ValueError("the payload is larger than a JPEG can hold")
    data = np.zeros((wide * high, UNIT), np.uint8)
    data.ravel()[: len(payload)] = np.frombuffer(payload, np.uint8)
    rows = np.empty((wide * high, UNIT + 2), np.uint8)
    rows[:, :UNIT] = _CODED[data]
    rows[:, UNIT] = 0xFF
    rows[:, UNIT + 1] = 0xD0 + np.arange(wide * high) % 8
    wide_at = np.flatnonzero(data >= 254)
    scan = rows.ravel()
    if len(wide_at):
        at = wide_at + 2 * (wide_at // UNIT) + 1
        scan = np.insert(scan, at, np.where(data.ravel()[wide_at] == 254, _SECOND[254], _SECOND[255]).astype(np.uint8))
    head = b"".join(
        (
            b"\xff\xd8",
            _segment(0xFE, b"payload " + str(len(payload)).encode()),
            _segment(0xDB, b"\x00" + b"\x01" * 64),
            _segment(0xC0, struct.pack(">BHHB", 8, high * 8, wide * 8, 3) + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0])),
            _segment(0xC4, b"\x00" + _TABLE),
            _segment(0xC4, b"\x10" + _TABLE),
            _segment(0xDD, struct.pack(">H", 1)),
            _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])),
        )
    )
    return head + scan[:-2].tobytes() + b"\xff\xd9"


@dataclass
class Image:
    """A parsed file: frame, tables, and the byte ranges of its restart intervals in ``scan``."""

    width: int = 0
    height: int = 0
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, across, down, quantiser table
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[int, tuple[bytes, bytes]] = field(default_factory=dict)  # class << 4 | id: lengths, symbols
    chosen: dict[int, int] = field(default_factory=dict)  # component id: DC << 4 | AC table
    interval: int = 0
    comment: bytes = b""
    scan: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint8))
    starts: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    @property
    def units(self) -> tuple[int, int]:
        """Coded units across and down."""
        across, down = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        return -(-self.width // (8 * across)), -(-self.height // (8 * down))

    @property
    def order(self) -> tuple[int, ...]:
        """Component index of each block of a unit."""
        return tuple(i for i, p in enumerate(self.parts) for _ in range(p[1] * p[2]))

    @property
    def kind(self) -> tuple:
        """Files of one kind are decoded together."""
        return self.order, tuple(self.chosen[p[0]] for p in self.parts), tuple(sorted(self.tables.items()))


def parse(data: bytes) -> Image:
    """Markers of a baseline file with one interleaved scan."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    image, at = Image(), 2
    while True:
        if data[at] != 0xFF:
            raise ValueError(f"marker expected at byte {at}")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        length = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xFE:
            image.comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 64 << wide
                image.quantisers[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else "u1").astype(int)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                image.tables[body[0]] = body[1:17], body[17 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xC0:
            depth, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            if depth != 8:
                raise ValueError("samples of 8 bits only")
            image.parts = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * n, 3)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("baseline files only")
        elif marker == 0xDD:
            image.interval = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            if body[0] != len(image.parts):
                raise ValueError("one interleaved scan only")
            image.chosen = {body[i]: body[i + 1] for i in range(1, 1 + 2 * body[0], 2)}
            break
    raw = np.frombuffer(data, np.uint8, offset=at)
    marks = np.flatnonzero(raw == 0xFF)
    follow = raw[np.minimum(marks + 1, len(raw) - 1)]
    ends = marks[(follow != 0) & ((follow < 0xD0) | (follow > 0xD7))]
    if not len(ends):
        raise ValueError("the scan has no end")
    marks, follow = marks[marks < ends[0]], follow[marks < ends[0]]
    drop = np.zeros(ends[0], bool)
    drop[marks + 1] = True
    restart = marks[follow != 0]
    drop[restart] = True
    image.scan = raw[: ends[0]][~drop]
    image.starts = np.append(0, restart - np.searchsorted(np.flatnonzero(drop), restart)).astype(np.int64)
    return image


def _lookup(lengths: bytes, symbols: bytes) -> np.ndarray:
    """By the next 16 bits: code length << 8 | symbol, 0 if there is no such code."""
    out = np.zeros(1 << 16, np.int32)
    code = k = 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            first = code << 16 - n
            out[first : first + (1 << 16 - n)] = n << 8 | symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def coefficients(images: list[Image]) -> list[np.ndarray]:
    """Quantised coefficients of each image in zigzag order: one row of 64 for each block, in coded order."""
    out: list[np.ndarray] = [np.empty(0)] * len(images)
    kinds: dict[tuple, list[int]] = {}
    for i, x in enumerate(images):
        kinds.setdefault(x.kind, []).append(i)
    for (order, chosen, tables), members in kinds.items():
        by = dict(tables)
        table = np.concatenate([_lookup(*by[c >> 4]) for c in chosen] + [_lookup(*by[16 | c & 15]) for c in chosen])
        part = np.array(order)
        starts, units, base = [], [], 0
        for i in members:
            x = images[i]
            total = x.units[0] * x.units[1]
            each = x.interval or total
            n = -(-total // each)
            if len(x.starts) < n:
                raise ValueError("restart intervals are missing")
            starts.append(x.starts[:n] + base)
            u = np.full(n, each)
            u[-1] = total - each * (n - 1)
            units.append(u)
            base += len(x.scan) + _PAD
        pad = np.full(_PAD, 0xFF, np.uint8)
        buffer = np.concatenate([y for i in members for y in (images[i].scan, pad)])
        lanes, blocks = np.concatenate(starts), np.concatenate(units) * len(order)
        first = np.cumsum(blocks) - blocks
        flat = np.zeros((int(blocks.sum()), 64), np.int16)
        for a in range(0, len(lanes), LANES):
            _decode(buffer, lanes[a : a + LANES], first[a : a + LANES], blocks[a : a + LANES], part, table, len(chosen), flat)
        at = 0
        for i, u in zip(members, units, strict=True):
            n = int(u.sum()) * len(order)
            out[i] = flat[at : at + n]
            at += n
    return out


def _decode(buffer: np.ndarray, starts: np.ndarray, first: np.ndarray, blocks: np.ndarray, part: np.ndarray, table: np.ndarray, parts: int, out: np.ndarray) -> None:
    """One symbol of every interval at each step, until all are at their last block's end."""
    bit, row, end = starts * 8, first.copy(), first + blocks
    begin, k = first.copy(), np.zeros(len(starts), np.int64)
    before = np.zeros((len(starts), parts), np.int64)
    lane = np.arange(len(starts))
    flat, per_unit, last = out.ravel(), len(part), len(buffer) - 4
    wide = buffer.astype(np.uint32)

    def peek(bit: np.ndarray) -> np.ndarray:
        at = np.minimum(bit >> 3, last)
        return ((wide[at] << 16 | wide[at + 1] << 8 | wide[at + 2]) >> (8 - (bit & 7)).astype(np.uint32)).astype(np.int64) & 0xFFFF

    while len(row):
        p = part[(row - begin) % per_unit]
        dc = k == 0
        got = table[(np.where(dc, p, p + parts) << 16) + peek(bit)]
        length = got >> 8
        if not length.all():
            raise ValueError("a code that the tables don't have")
        bit = bit + length
        size, run = (got & 15).astype(np.int64), (got >> 4) & 15
        value = peek(bit) >> (16 - size)
        bit = bit + size
        value = np.where(value < (1 << size >> 1), value - (1 << size) + 1, value)
        if dc.any():
            d = np.flatnonzero(dc)
            before[lane[d], p[d]] += value[d]
            value[d] = before[lane[d], p[d]]
        zero = ~dc & (size == 0)
        k = k + np.where(dc, 0, run)
        if zero.any():
            put = np.flatnonzero(~zero)
            flat[row[put] * 64 + k[put]] = value[put]
            k = np.where(zero & (run < 15), 64, k + 1)
        else:
            flat[row * 64 + k] = value
            k = k + 1
        full = k >= 64
        if full.any():
            row = row + full
            k[full] = 0
            live = row < end
            if not live.all():
                bit, row, end, begin, k, lane = bit[live], row[live], end[live], begin[live], k[live], lane[live]


def payload(image: Image, coefs: np.ndarray) -> bytes:
    """What ``encode`` stored."""
    if not image.comment.startswith(b"payload "):
        raise ValueError("not a payload file")
    return _byte(coefs.ravel()[: int(image.comment[8:])]).tobytes()


def luminance(image: Image, coefs: np.ndarray) -> np.ndarray:
    """DC-only thumbnail: one sample of 0 to 255 for each luminance block."""
    across, down = image.units
    order = np.array(image.order)
    _, h, v, q = image.parts[0]
    dc = coefs[:, 0].reshape(down, across, len(order))[:, :, order == 0].reshape(down, across, v, h)
    dc = dc.transpose(0, 2, 1, 3).reshape(down * v, across * h)
    return np.clip(dc * int(image.quantisers[q][0]) / 8 + 128, 0, 255)


def _shrunk(grid: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Area means on a fixed grid; small sides are stretched."""
    for axis, n in ((0, rows), (1, columns)):
        m = grid.shape[axis]
        total = np.concatenate([np.zeros_like(grid.take([0], axis)), np.cumsum(grid, axis)], axis)
        low = np.arange(n) * m // n
        high = np.maximum(np.arange(1, n + 1) * m // n, low + 1)
        shape = [1, 1]
        shape[axis] = n
        grid = (total.take(high, axis) - total.take(low, axis)) / (high - low).reshape(shape)
    return grid


def thumbnail_hashes(grid: np.ndarray) -> tuple[str, str]:
    """Average and difference hash of a thumbnail, 64 bits each."""
    mean = _shrunk(grid, 8, 8)
    step = _shrunk(grid, 8, 9)
    bits = (mean > mean.mean(), step[:, 1:] > step[:, :-1])
    return tuple(np.packbits(b.ravel()).tobytes().hex() for b in bits)
