"""Counting hashes across all rows by exchanging packed blocks.

Tasks pack the hashes of their rows into one binary block for each bucket of the hash space and ``BLOCK`` hashes, some
six bytes a hash; a bucket's blocks meet in one task, which counts equal hashes and sends those that occur more than
once back to their rows, again in packed blocks. Buckets and homes (groups of rows that get their hashes back together)
are as many as keep each within a few megabytes, one or two for each shuffle partition at least: each bucket may send each
home a block.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumengraph.llm import common

BLOCK = 1_000_000
#: Hashes in a bucket, bytes of text in a home, about.
BUCKET, HOME = 2_000_000, 8 << 20
SCHEMA = "slot int, block binary"
_LOW = np.uint64((1 << 40) - 1)
_HEAD = struct.Struct("<IqB")


def bits_for(hashes: int, partitions: int) -> int:
    """Bits of the bucket number; 24 at most, as 40 bits lie below them."""
    return min(24, max(2, 2 * partitions - 1, hashes // BUCKET).bit_length())


def homes_for(size: int, partitions: int) -> int:
    return max(partitions, size // HOME, 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def home_of(uid: np.ndarray, homes: int) -> np.ndarray:
    return (mixed(uid.astype(np.uint64)) % np.uint64(homes)).astype(np.int64)


def runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of equal values' runs."""
    if not len(sorted_):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
    return at, np.diff(np.append(at, len(sorted_)))


class Packer:
    """Collects (row, hashes) and yields blocks. Rows must come with successive uids; a gap starts a new block.

    Slots: bucket numbers, from 0; -1 - home for what is sent to a home as it is."""

    def __init__(self, bits: int):
        self.bits = bits
        self.hashes: list[np.ndarray] = []
        self.rows: list[int] = []
        self.base = self.next = 0
        self.size = 0

    def add(self, uid: int, hashes: np.ndarray) -> Iterator[tuple[int, bytes]]:
        if self.rows and (uid != self.next or self.size >= BLOCK):
            yield from self.flush()
        if not self.rows:
            self.base = uid
        self.next = uid + 1
        self.hashes.append(hashes)
        self.rows.append(len(hashes))
        self.size += len(hashes)

    def flush(self) -> Iterator[tuple[int, bytes]]:
        if self.size:
            h = np.concatenate(self.hashes)
            row = np.repeat(np.arange(len(self.rows), dtype=np.int64), self.rows)
            bucket = (h >> np.uint64(64 - self.bits)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, row = bucket[order], row[order]
            low = (h[order] >> np.uint64(24 - self.bits)) & _LOW
            at, n = runs(bucket)
            for a, m in zip(at.tolist(), n.tolist(), strict=True):
                step = np.diff(row[a : a + m], prepend=0)
                wide = int(step.max()) > 255
                part = low[a : a + m]
                body = (part.astype("<u4"), (part >> np.uint64(32)).astype(np.uint8), step.astype("<u4" if wide else "u1"))
                yield int(bucket[a]), _HEAD.pack(m, self.base, wide) + b"".join(x.tobytes() for x in body)
        self.hashes, self.rows, self.size = [], [], 0


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (the 40 bits below the bucket's) and uids of a bucket's block."""
    m, base, wide = _HEAD.unpack_from(block)
    at = _HEAD.size
    low = np.frombuffer(block, "<u4", m, at).astype(np.uint64) | np.frombuffer(block, np.uint8, m, at + 4 * m).astype(np.uint64) << np.uint64(32)
    step = np.frombuffer(block, "<u4" if wide else "u1", m, at + 5 * m)
    return low, base + np.cumsum(step, dtype=np.int64)


def pack_found(uid: np.ndarray, key: np.ndarray) -> bytes:
    """Sorted by uid: rows of (uid, number of keys), then keys."""
    at, n = runs(uid)
    u = uid[at]
    return struct.pack("<IIq", len(u), len(uid), u[0]) + np.diff(u, prepend=u[0]).astype("<u8").tobytes() + n.astype("<u4").tobytes() + key.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_found(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    rows, m, base = struct.unpack_from("<IIq", block)
    u = base + np.cumsum(np.frombuffer(block, "<u8", rows, 16).astype(np.int64))
    n = np.frombuffer(block, "<u4", rows, 16 + 8 * rows)
    key = np.ascontiguousarray(np.frombuffer(block, np.uint8, 8 * m, 16 + 12 * rows).reshape(8, m).T).view("<u8").ravel()
    return np.repeat(u, n), key


#: Bits of the count in a key: keys order by count, then hash.
COUNT_MAX = (1 << 15) - 1


def key_of(hash48: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.minimum(count, COUNT_MAX).astype(np.uint64) << np.uint64(48) | hash48


def batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["slot", "block"])


def batches(rows: Iterator[tuple[int, bytes]], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in record batches of some megabytes."""
    held, total = [], 0
    for r in rows:
        held.append(r)
        total += len(r[1])
        if total >= size:
            yield batch(held)
            held, total = [], 0
    if held:
        yield batch(held)


def repeated(packed: DataFrame, bits: int, homes: int) -> DataFrame:
    """From packed blocks, (home, blocks): what was sent there as it is (tag 0), and for each bucket ``pack_found`` of the
    keys of hashes that occur more than once (tag 1)."""
    # 40 bits of a bucket's hash are kept; with the bucket's number they are a hash of 48 bits in a key
    shift = np.uint64(max(0, bits - 8))

    @common.lean
    def count(key: tuple, table: pa.Table) -> pa.Table:
        slot = key[0].as_py()
        blocks = table.column("block").to_pylist()
        if slot < 0:
            out = [(-1 - slot, b"\x00" + b) for b in blocks]
        else:
            parts = [unpack(b) for b in blocks]
            low, uid = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(low)
            low, uid = low[order], uid[order]
            _, n = runs(low)
            keep = np.repeat(n > 1, n)
            low, uid, n = low[keep], uid[keep], np.repeat(n, n)[keep]
            out = []
            if len(low):
                keys = key_of((np.uint64(slot) << np.uint64(48 - bits) | low >> shift) if bits > 8 else (np.uint64(slot) << np.uint64(40) | low), n)
                home = home_of(uid, homes)
                order = np.lexsort((keys, uid, home))
                keys, uid, home = keys[order], uid[order], home[order]
                for a, m in zip(*(x.tolist() for x in runs(home)), strict=True):
                    out.append((int(home[a]), b"\x01" + pack_found(uid[a : a + m], keys[a : a + m])))
        return pa.Table.from_batches([batch(out)])

    return packed.groupBy("slot").applyInArrow(count, SCHEMA)


def table_size(df: DataFrame) -> int:
    """Bytes of the plan's input as Spark estimates them, 1 GB where it can't tell."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if 0 < n < 1 << 60 else 1 << 30


def partitions(df: DataFrame) -> int:
    return common.shuffle_partitions(df.sparkSession)
