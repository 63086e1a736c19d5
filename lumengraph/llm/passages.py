"""Which documents hold a passage of over ``WORDS`` words that repeats: so many successive words and one that are found elsewhere too.

Words are ``[^\\x20\\x09-\\x0D]+`` and compared byte for byte, whatever blanks lie between them; elsewhere is another place in any
document, the same one included. One pass over the texts and one exchange. A window is 51 words; of its 25 runs of 27 words
the one of least hash is its anchor, so that equal windows have equal anchors and meet in one task, at every size and
without choice of a sample. An anchor (one in 13 words) goes out with the hashes of all windows that have it. Windows are
equal if the hashes of their anchors (64 bits) and of themselves (48 bits more) are. Records that are the same within some megabytes of
text go out once, so that a passage that all documents have isn't one task's work.

Null and empty texts, and texts of fewer words than a window, hold none; repeated rows repeat each other.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumengraph.llm import blobs, common

WORDS = 50
WINDOW, RUN = WORDS + 1, 27
#: Bytes of texts that are hashed together, and words of a block of records.
_TEXTS, _BLOCK = 2 << 20, 4_000_000
#: Bytes of records in a bucket, about.
_BUCKET = 12 << 20
_BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
# odd, so that they have inverses modulo 2^64
_BYTE, _IN_RUN, _IN_WINDOW = 0xB5297A4D3F84D5A7, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93
_HEAD = struct.Struct("<IIq")
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n-1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, _TEXTS + (1 << 16)), base, np.uint64)
        p[0] = 1
        _powers[base] = have = np.cumprod(p, dtype=np.uint64)
    return have[:n]


def _sums(x: np.ndarray, base: int, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of x[first:end]."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * _power(base, len(x)), dtype=np.uint64)])
    return blobs.mixed((total[end] - total[first]) * _power(pow(base, -1, 1 << 64), len(x))[first])


class Records:
    """Anchors: class (hash), row of the text, number of windows; and of all windows the hashes, one anchor's after another's."""

    def __init__(self, parts: list[tuple[np.ndarray, ...]]):
        self.kind, self.row, self.n, self.windows = (np.concatenate(x) for x in zip(*parts, strict=True))

    def first_of_same(self) -> np.ndarray:
        """Of each record the first one that has the same class and windows."""
        starts = np.cumsum(self.n) - self.n
        own = blobs.mixed(self.kind + blobs.mixed(np.add.reduceat(self.windows, starts) + self.n.astype(np.uint64)))
        _, first, of = np.unique(own, return_index=True, return_inverse=True)
        return first[of]

    def take(self, at: np.ndarray) -> tuple[np.ndarray, ...]:
        n, starts = self.n[at], (np.cumsum(self.n) - self.n)[at]
        own = np.arange(int(n.sum())) + np.repeat(starts - (np.cumsum(n) - n), n)
        return self.kind[at], self.row[at], n, self.windows[own]


def records(texts: list[bytes], rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Kind, row, n and windows of the texts' anchors."""
    lens = np.array([len(t) for t in texts])
    b = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    blank = _BLANK[b]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    first, end = edge[::2], edge[1::2]
    word = _sums(b.astype(np.uint64) + np.uint64(1), _BYTE, first, end)
    # words of each text, and its windows
    cut = np.searchsorted(first, np.cumsum(np.append(1, lens + 1)))
    own = np.maximum(np.diff(cut) - WINDOW + 1, 0)
    p = np.arange(int(own.sum())) + np.repeat(cut[:-1] - (np.cumsum(own) - own), own)
    if not len(p):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    places = np.arange(len(word) - RUN + 1)
    run = _sums(word, _IN_RUN, places, places + RUN)
    # the least of 25 hashes' upper 40 bits, then the leftmost
    m = run & np.uint64(0xFFFFFFFFFF000000) | places.astype(np.uint64) if len(word) < 1 << 24 else None
    if m is None:
        order = np.empty(len(run), np.uint64)
        order[np.argsort(run, kind="stable")] = np.arange(len(run), dtype=np.uint64)
        m = order << np.uint64(32) | places.astype(np.uint64)
    full = m
    span = 1
    while span < 16:
        full = np.minimum(full[:-span], full[span:])
        span *= 2
    rest = WINDOW - RUN + 1 - span
    least = np.minimum(full[p], full[p + rest])
    at = (least & np.uint64(0xFFFFFF if len(word) < 1 << 24 else 0xFFFFFFFF)).astype(np.int64)
    change = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    n = np.diff(np.append(change, len(p)))
    windows = _sums(word, _IN_WINDOW, p, p + WINDOW) >> np.uint64(16)
    # least hashes are small ones: mixed again, buckets by their upper bits are even
    return blobs.mixed(run[at[change]]), rows[np.searchsorted(cut, p[change], side="right") - 1], n, windows


def _block(kind: np.ndarray, row: np.ndarray, n: np.ndarray, windows: np.ndarray) -> bytes:
    low = int(row.min())
    own = row - low
    wide = int(own.max()) >> 32 > 0
    body = (kind.astype("<u8"), n.astype("u1"), windows.astype("<u4"), (windows >> np.uint64(32)).astype("<u2"), own.astype("<u8" if wide else "<u4"))
    return _HEAD.pack(len(kind), len(windows), low) + b"".join(x.tobytes() for x in body)


def _unblock(x: bytes) -> tuple[np.ndarray, ...]:
    k, m, low = _HEAD.unpack_from(x)
    at = _HEAD.size
    kind, n = np.frombuffer(x, "<u8", k, at), np.frombuffer(x, np.uint8, k, at + 8 * k).astype(np.int64)
    at += 9 * k
    windows = np.frombuffer(x, "<u4", m, at).astype(np.uint64) | np.frombuffer(x, "<u2", m, at + 4 * m).astype(np.uint64) << np.uint64(32)
    at += 6 * m
    return kind, low + np.frombuffer(x, "<u8" if len(x) - at == 8 * k else "<u4", k, at).astype(np.int64), n, windows


def _repeated_rows(r: Records) -> np.ndarray:
    """Rows of windows that are in the records twice."""
    order = np.argsort(r.kind)
    at, n = blobs.runs(r.kind[order])
    several = order[np.repeat(n > 1, n)]
    kind, row, n, windows = r.take(several)
    kind, row = np.repeat(kind, n), np.repeat(row, n)
    order = np.lexsort((windows, kind))
    kind, row, windows = kind[order], row[order], windows[order]
    same = (kind[1:] == kind[:-1]) & (windows[1:] == windows[:-1])
    return np.unique(row[np.append(same, False) | np.append(False, same)]) if len(row) else row


def holders(docs: DataFrame) -> DataFrame:
    """uid (``common.row_ids`` of ``docs``, a scan of files) of each document that holds a repeated passage of over ``WORDS`` words."""
    size, parts = blobs.table_size(docs), blobs.partitions(docs)
    bits = min(24, max(2, parts - 1, 4 * size // _BUCKET).bit_length())

    @common.lean
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(found: list[tuple[np.ndarray, ...]]) -> Iterator[tuple[int, bytes]]:
            r = Records(found)
            if not len(r.kind):
                return
            first = r.first_of_same()
            repeats = np.flatnonzero(first != np.arange(len(first)))
            if len(repeats):
                known = np.unique(r.row[np.append(repeats, first[repeats])])
                home = blobs.home_of(known, 1 << bits)
                order = np.argsort(home, kind="stable")
                for a, n in zip(*(x.tolist() for x in blobs.runs(home[order])), strict=True):
                    yield -1 - int(home[order[a]]), known[order[a : a + n]].tobytes()
            out = np.flatnonzero(first == np.arange(len(first)))
            bucket = (r.kind[out] >> np.uint64(64 - bits)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            kind, row, n, windows = r.take(out[order])
            ends = np.append(0, np.cumsum(n))
            for a, k in zip(*(x.tolist() for x in blobs.runs(bucket[order])), strict=True):
                yield int(bucket[order[a]]), _block(kind[a : a + k], row[a : a + k], n[a : a + k], windows[ends[a] : ends[a + k]])

        def slots() -> Iterator[tuple[int, bytes]]:
            found: list[tuple[np.ndarray, ...]] = []
            held = 0
            for b in common.slices(batches, 256):
                uid, texts = b.column(0).to_numpy(), common.utf8(b.column(1))
                a = 0
                while a < len(texts):
                    z, many = a, 0
                    while z < len(texts) and (z == a or many + len(texts[z]) < _TEXTS):
                        many += len(texts[z])
                        z += 1
                    found.append(records(texts[a:z], uid[a:z]))
                    held += len(found[-1][3])
                    a = z
                if held >= _BLOCK:
                    yield from sent(found)
                    found, held = [], 0
            if found:
                yield from sent(found)

        yield from blobs.batches(slots())

    @common.lean
    def count(key: tuple, table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_pylist()
        if key[0].as_py() < 0:
            uid = np.unique(np.frombuffer(b"".join(blocks), np.int64))
        else:
            uid = _repeated_rows(Records([_unblock(x) for x in blocks]))
        return pa.table({"uid": pa.array(uid, pa.int64())})

    rows = docs.select(common.row_ids(docs).alias("uid"), "text")
    return rows.mapInArrow(pack, blobs.SCHEMA).groupBy("slot").applyInArrow(count, "uid long").distinct()
