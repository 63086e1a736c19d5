"""Sorted-string-table files: prefix-compressed blocks, sparse block index, Bloom filter, footer.

Layout, all integers little-endian:

    block*   entries, then the CRC-32 of the entries (4 bytes)
    index    per block: length of its last key (2), last key, offset (8), length without CRC (4)
    bloom    number of probes (4), bits
    footer   index offset, index length, bloom offset, bloom length, entries (8 each), tag (4; the caller's), magic (8)

An entry is: varint length shared with the key before, varint length of the rest, varint value length, rest of the
key, value. A block's first key is whole. Keys may repeat; equal keys keep the order they were added in.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import xxhash

MAGIC = b"LGSST\x00\x00\x01"
BLOCK_BYTES = 64 << 10
BLOOM_BITS_PER_KEY = 10
BLOOM_PROBES = 7
_FOOTER = struct.Struct("<QQQQQI8s")


def key_of(doc_id: int | None) -> bytes:
    """Nine bytes that sort as the ids do, null first."""
    return b"\x00" * 9 if doc_id is None else b"\x01" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def _probes(hashes: np.ndarray, bits: int, probes: int) -> np.ndarray:
    step = hashes >> np.uint64(32) | np.uint64(1)
    return (hashes[:, None] + np.arange(probes, dtype=np.uint64) * step[:, None]) % np.uint64(bits)


class Writer:
    """Streams entries in key order to an open file; holds one block, the index and a hash for each key."""

    def __init__(self, file: BinaryIO, block_bytes: int = BLOCK_BYTES, tag: int = 0):
        self.file, self.block_bytes, self.tag = file, block_bytes, tag
        self.block: list[bytes] = []
        self.size = self.offset = self.entries = 0
        self.last: bytes | None = None
        self.index: list[bytes] = []
        self.hashes: list[int] = []

    def add(self, key: bytes, value: bytes) -> None:
        if self.last is not None and key < self.last:
            raise ValueError("keys must not fall")
        shared = 0
        if self.block and self.last is not None:
            for a, b in zip(key, self.last, strict=False):
                if a != b:
                    break
                shared += 1
        entry = b"".join((_varint(shared), _varint(len(key) - shared), _varint(len(value)), key[shared:], value))
        self.block.append(entry)
        self.size += len(entry)
        self.hashes.append(xxhash.xxh64_intdigest(key))
        self.last = key
        self.entries += 1
        if self.size >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if not self.block:
            return
        data = b"".join(self.block)
        self.file.write(data)
        self.file.write(struct.pack("<I", zlib.crc32(data)))
        self.index.append(struct.pack("<H", len(self.last)) + self.last + struct.pack("<QI", self.offset, len(data)))
        self.offset += len(data) + 4
        self.block, self.size = [], 0

    def close(self) -> int:
        """Write index, filter and footer; returns the file's bytes."""
        self._flush()
        index = b"".join(self.index)
        bits = np.zeros(max(8, len(self.hashes) * BLOOM_BITS_PER_KEY + 7 & ~7), np.uint8)
        if self.hashes:
            bits[_probes(np.array(self.hashes, np.uint64), len(bits), BLOOM_PROBES).ravel().astype(np.int64)] = 1
        bloom = struct.pack("<I", BLOOM_PROBES) + np.packbits(bits, bitorder="little").tobytes()
        at = self.offset
        self.file.write(index + bloom + _FOOTER.pack(at, len(index), at + len(index), len(bloom), self.entries, self.tag, MAGIC))
        return at + len(index) + len(bloom) + _FOOTER.size


class Reader:
    """Looks up and scans one file; ``file`` must be seekable."""

    def __init__(self, file: BinaryIO, size: int):
        self.file = file
        i_at, i_len, b_at, b_len, self.entries, self.tag, magic = _FOOTER.unpack(self._at(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a sorted-string table")
        raw = self._at(i_at, i_len)
        self.keys: list[bytes] = []
        self.blocks: list[tuple[int, int]] = []
        at = 0
        while at < len(raw):
            n = struct.unpack_from("<H", raw, at)[0]
            self.keys.append(raw[at + 2 : at + 2 + n])
            self.blocks.append(struct.unpack_from("<QI", raw, at + 2 + n))
            at += 14 + n
        bloom = self._at(b_at, b_len)
        self.probes = struct.unpack_from("<I", bloom)[0]
        self.bits = np.frombuffer(bloom, np.uint8, offset=4)

    def _at(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(length)

    def may_hold(self, key: bytes) -> bool:
        """False only if the key isn't in the file."""
        at = _probes(np.array([xxhash.xxh64_intdigest(key)], np.uint64), len(self.bits) * 8, self.probes)[0]
        return bool(np.all(self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1))

    def block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        offset, length = self.blocks[i]
        raw = self._at(offset, length + 4)
        data = raw[:length]
        if zlib.crc32(data) != struct.unpack("<I", raw[length:])[0]:
            raise ValueError(f"block {i} is damaged")
        key, at = b"", 0
        while at < length:
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + n]
            at += n

    def get(self, key: bytes) -> list[bytes]:
        """All values of a key: filter, binary search in the block index, then the blocks that may hold it."""
        out: list[bytes] = []
        if not self.may_hold(key):
            return out
        for i in range(bisect.bisect_left(self.keys, key), len(self.keys)):
            for k, v in self.block(i):
                if k == key:
                    out.append(v)
                elif k > key:
                    return out
        return out

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.blocks)):
            yield from self.block(i)
