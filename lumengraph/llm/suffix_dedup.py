"""Operator 10, suffix-array dedup: bytes covered by a 400-byte string that starts elsewhere too.

A sparse suffix array. Of each window of 400 bytes, the 16-byte gram of least hash among its first 128 is the anchor;
equal windows have their anchor at the same offset, so that only suffixes that start at anchors (one in 64 bytes) need
sorting, each with the bytes before it that its windows reach. Of those, only anchors whose next 273 bytes start an
anchor elsewhere too (counted exactly in ``blobs``) can have a repeated window; only their suffixes are shuffled.

Sampled splitters range-partition the suffixes by their leading bytes (equal ones of one group of documents travel as
one row with all places); each bucket sorts its suffixes by multikey quicksort over words of eight bytes. What a suffix
shares with its neighbours, to the right and to the left, decides its windows. In clusters of three or more suffixes
with undecided windows, the windows are looked up by 64-bit hashes and compared by bytes; those of suffixes that start like
a bucket's first or last one, and so may lie in other buckets too, are looked up by hashes across all buckets, and what
is found there counts if a 128-bit cryptographic digest of the window is found twice. A key that repeats in very many
documents so never meets in one task.

Strings of another length than 400 bytes can be asked for (``dedup``); what is said of 128, 64 and 273 bytes above then follows
``Sizes``.

Null and empty texts, and texts under 400 bytes, keep all bytes; repeated rows repeat each other and go whole if they
have 400 bytes; null ids are carried; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengraph.llm import blobs, common, passages

LENGTH, REACH, GRAM = 400, 128, 16
#: Leading bytes by which suffixes are dealt into ranges; those that have them in common are split by a hash of the key, and
#: equal keys by one of their places.
LEAD = 24
#: Bytes of suffix keys in a bucket, about.
BUCKET_BYTES = 12 << 20
#: Bytes of texts whose anchors are found together.
_TEXTS = 1 << 20
_PLACE = np.dtype([("uid", "<i8"), ("at", "<i8")])
_RANGE = np.dtype([("uid", "<i8"), ("first", "<i8"), ("last", "<i8")])
PARTS = "uid long, doc_id long, n_bytes long, text binary, sha string, key binary, low int, high int, places binary"
RANGES = "uid long, ranges binary"
FOUND = f"{RANGES}, digest binary"
RESULT = "uid long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


class Sizes(NamedTuple):
    """Bytes of a window, of its starts among which the anchor is, after an anchor in any window, and of a suffix's key."""

    length: int
    reach: int
    sure: int
    key: int

    @classmethod
    def of(cls, length: int) -> Sizes:
        # clusters have more bytes in common than those by which suffixes are dealt; keys are whole words of eight bytes
        if length <= LEAD:
            raise ValueError(f"windows have more than {LEAD} bytes")
        reach = min(REACH, 1 << (length - LEAD).bit_length() - 1)
        return cls(length, reach, length - reach + 1, -(-(length + reach) // 8) * 8)


_USUAL = Sizes.of(LENGTH)
SURE, KEY = _USUAL.sure, _USUAL.key


def anchors(texts: list[bytes], sizes: Sizes = _USUAL) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text the anchors' places, and the first and last window start that each governs."""
    none = (np.empty(0, np.int64),) * 3
    long_ones = [i for i, t in enumerate(texts) if len(t) >= sizes.length]
    found: dict[int, tuple] = {}
    while long_ones:
        part, size = [], 0
        while long_ones and (not part or size < _TEXTS):
            part.append(long_ones.pop(0))
            size += len(texts[part[-1]])
        found.update(zip(part, _anchors([texts[i] for i in part], sizes), strict=True))
    return (found.get(i, none) for i in range(len(texts)))


def _anchors(texts: list[bytes], sizes: Sizes) -> list[tuple]:
    lens = np.array([len(t) for t in texts])
    starts = np.cumsum(lens) - lens
    b = np.frombuffer(b"".join(texts) + bytes(sizes.length), np.uint8)
    x = b[:-1].astype(np.uint64) | b[1:].astype(np.uint64) << np.uint64(8)
    x = x[:-2] | x[2:] << np.uint64(16)
    x = x[:-4] | x[4:] << np.uint64(32)
    h = blobs.mixed(x[:-8] * np.uint64(0x9E3779B97F4A7C15) ^ blobs.mixed(x[8:]))
    # the hash's upper 32 bits, then the place: the least is the leftmost of the least hashes
    m = h & np.uint64(0xFFFFFFFF00000000) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span < sizes.reach:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    windows = lens - sizes.length + 1
    p = np.arange(int(windows.sum())) + np.repeat(starts - (np.cumsum(windows) - windows), windows)
    at = (m[p] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    change = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    place, first, last = at[change], p[change], p[np.append(change[1:], len(p)) - 1]
    cut = np.searchsorted(place, starts)
    return [tuple(v[a:z] - s for v in (place, first, last)) for a, z, s in zip(cut, np.append(cut[1:], len(place)), starts, strict=True)]


def _sure_hashes(text: bytes, places: np.ndarray, sizes: Sizes) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(text[a : a + sizes.sure]) for a in places.tolist()], np.uint64)


def multikey_quicksort(words: np.ndarray, tie: list) -> np.ndarray:
    """Order of rows of big-endian words, column by column; ``tie`` sorts the small ranges."""
    order = np.arange(len(words))
    stack = [(0, len(words), 0)]
    while stack:
        low, high, depth = stack.pop()
        if high - low < 2 or depth == words.shape[1]:
            continue
        own = order[low:high]
        if high - low <= 24:
            order[low:high] = sorted(own.tolist(), key=tie.__getitem__)
            continue
        column = words[own, depth]
        pivot = np.partition(column, len(column) // 2)[len(column) // 2]
        less, more = own[column < pivot], own[column > pivot]
        equal = own[column == pivot]
        a, z = low + len(less), high - len(more)
        order[low:a], order[a:z], order[z:high] = less, equal, more
        stack += [(low, a, depth), (a, z, depth + 1), (z, high, depth)]
    return order


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the common start of each pair of rows."""
    differ = x != y
    return np.where(differ.any(1), differ.argmax(1), x.shape[1])


class Bucket:
    """Sorted suffixes of one range, and what is decided about their windows.

    A window is known by its offset: how far before the anchor it starts."""

    def __init__(self, keys: list[bytes], low: list[int], high: list[int], places: list[bytes], sizes: Sizes = _USUAL):
        self.length = length = sizes.length
        raw = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, sizes.key)
        order = multikey_quicksort(raw.view(">u8"), keys)
        raw = raw[order]
        self.low, self.high = np.array(low)[order], np.array(high)[order]
        self.places = [places[i] for i in order]
        self.raw, n = raw, len(raw)
        many = np.array([len(p) > _PLACE.itemsize for p in self.places])
        right = np.minimum(_common(raw[1:, :length], raw[:-1, :length]), length - np.maximum(self.low[1:], self.low[:-1]))
        left = np.minimum(_common(raw[1:, length:], raw[:-1, length:]), np.minimum(self.high[1:], self.high[:-1]))
        # decided offsets: those of the row itself if it has several places, else shared with the row before or after
        none = (np.ones(n, np.int64), np.zeros(n, np.int64))
        self.spans = []
        for shift in (0, 1):
            a, z = none[0].copy(), none[1].copy()
            rows = slice(1, n) if shift == 0 else slice(0, n - 1)
            a[rows], z[rows] = np.maximum(self.low[rows], length - right), np.minimum(self.high[rows], left)
            self.spans.append((a, z))
        self.spans.append((np.where(many, self.low, 1), np.where(many, self.high, 0)))
        self.cluster = np.cumsum(np.append(False, right < sizes.sure)) if n else np.empty(0, np.int64)

    def decided(self, i: int) -> np.ndarray:
        """Whether each offset from low to high is."""
        out = np.zeros(self.high[i] - self.low[i] + 1, bool)
        for a, z in self.spans:
            if a[i] <= z[i]:
                out[a[i] - self.low[i] : z[i] - self.low[i] + 1] = True
        return out

    def text(self, i: int) -> bytes:
        """What the windows of row i cover; that of the offset high starts first."""
        high = int(self.high[i])
        return self.raw[i, self.length : self.length + high][::-1].tobytes() + self.raw[i, : self.length - int(self.low[i])].tobytes()

    def resolve(self) -> Iterator[tuple[int, np.ndarray, list[int] | None]]:
        """(row, decided, hashes): hashes of windows for other buckets to compare, of clusters with the leading bytes of the first or
        last suffix, which other buckets may have too."""
        n = len(self.low)
        lead = self.raw[:, :LEAD]
        shared = (lead == lead[:1]).all(1) | (lead == lead[-1:]).all(1)
        starts = np.flatnonzero(np.append(True, np.diff(self.cluster) > 0)) if n else []
        ends = np.append(starts[1:], n) if n else []
        for a, z in zip(starts, ends, strict=True):
            done = {i: self.decided(i) for i in range(a, z)}
            outer = bool(shared[a])
            if not outer and (z - a < 3 or all(d.all() for d in done.values())):
                yield from ((i, d, None) for i, d in done.items())
                continue
            owner: dict[int | tuple[int, bytes], tuple[int, int]] = {}
            asked: dict[int, list[int]] = {}
            texts = {i: self.text(i) for i in done}
            for i, text in texts.items():
                last = len(done[i]) - 1
                asked[i] = []
                for k in range(last + 1):
                    window = text[last - k : last - k + self.length]
                    h = xxhash.xxh3_64_intdigest(window)
                    j, m = owner.setdefault(h, (i, k))
                    if (j, m) != (i, k) and _window(texts[j], m, len(done[j]), self.length) != window:
                        j, m = owner.setdefault((h, window), (i, k))
                    if (j, m) != (i, k):
                        done[j][m] = done[i][k] = True
                    # each distinct window goes out once
                    asked[i].append(h if (j, m) == (i, k) else 0)
            yield from ((i, d, asked[i] if outer else None) for i, d in done.items())


def _window(text: bytes, k: int, offsets: int, length: int) -> bytes:
    """The window of the k-th of so many ascending offsets in a bucket's ``text``."""
    return text[offsets - 1 - k : offsets - 1 - k + length]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def _placed(flags: np.ndarray, low: int, places: bytes) -> np.ndarray:
    """Window ranges of decided offsets at each place."""
    at = np.frombuffer(places, _PLACE)
    out = np.empty((len(at), len(r := _runs(flags))), _RANGE)
    for k, (a, z) in enumerate(r):
        out["uid"][:, k], out["first"][:, k], out["last"][:, k] = at["uid"], at["at"] - (low + z), at["at"] - (low + a)
    return out.ravel()


def _by_uid(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    r = np.concatenate(found) if found else np.empty(0, _RANGE)
    r = r[np.argsort(r["uid"], kind="stable")]
    at, n = blobs.runs(r["uid"])
    yield pa.RecordBatch.from_arrays([pa.array(r["uid"][at]), pa.array([r[a : a + m].tobytes() for a, m in zip(at, n, strict=True)], pa.binary())], names=["uid", "ranges"])


def _suffixes(docs: DataFrame, sizes: Sizes) -> DataFrame:
    """A table of PARTS: suffixes (key set), documents that have some (text set), and all others (sha set)."""
    size, parts = blobs.table_size(docs), blobs.partitions(docs)
    bits, homes = blobs.bits_for(2 * size // (sizes.reach // 2), parts), blobs.homes_for(2 * size, parts)
    rows = docs.select(common.row_ids(docs).alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text")

    @common.lean
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def slots() -> Iterator[tuple[int, bytes]]:
            p = blobs.Packer(bits)
            for b in common.slices(batches, 256):
                texts = common.utf8(b.column(1))
                for uid, text, (place, _, _) in zip(b.column(0).to_pylist(), texts, anchors(texts, sizes), strict=True):
                    yield from p.add(uid, _sure_hashes(text, place, sizes))
            yield from p.flush()

        yield from blobs.batches(slots())

    @common.lean
    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot = pa.array(blobs.home_of(b.column(0).to_numpy(), homes).astype(np.int32))
            yield pa.RecordBatch.from_arrays([slot, b.column(0), b.column(1), pa.array(common.utf8(b.column(2)), pa.binary())], names=["slot", "uid", "doc_id", "text"])

    # a hash of 48 bits, as ``blobs.repeated`` gives
    mask = np.uint64((1 << 48) - 1)
    kept_bits = np.uint64(16) if bits > 8 else np.uint64(24 - bits)

    @common.lean
    def build(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = [blobs.unpack_found(x[1:]) for x in right.column("block").to_pylist()]
        uid = np.concatenate([f[0] for f in found]) if found else np.empty(0, np.int64)
        keys = np.concatenate([f[1] for f in found]) & mask if found else np.empty(0, np.uint64)
        order = np.argsort(uid, kind="stable")
        uid, keys = uid[order], keys[order]
        out: list[tuple] = []
        same: dict[tuple[bytes, int, int], list[bytes]] = {}
        uids, ids, texts = (left.column(c).to_pylist() for c in ("uid", "doc_id", "text"))
        hot = set(uid.tolist())
        spots = dict(zip([u for u in uids if u in hot], anchors([t for u, t in zip(uids, texts, strict=True) if u in hot], sizes), strict=True))
        for u, doc_id, text in zip(uids, ids, texts, strict=True):
            if u not in hot:
                out.append((u, doc_id, len(text), None, hashlib.sha256(text).hexdigest(), None, None, None, None))
                continue
            place, first, last = spots[u]
            own = keys[np.searchsorted(uid, u) : np.searchsorted(uid, u, side="right")]
            h = _sure_hashes(text, place, sizes) >> kept_bits
            hit = np.isin(h, own)
            out.append((u, doc_id, len(text), text, None, None, None, None, None))
            for a, p, q in zip(place[hit].tolist(), first[hit].tolist(), last[hit].tolist(), strict=True):
                low, high = a - q, a - p
                k = text[a : q + sizes.length].ljust(sizes.length, b"\0") + text[p:a][::-1].ljust(sizes.key - sizes.length, b"\0")
                same.setdefault((k, low, high), []).append(struct.pack("<qq", u, a))
        out += [(None, None, None, None, None, k, low, high, b"".join(at)) for (k, low, high), at in same.items()]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]
        columns = list(zip(*out, strict=True)) if out else [()] * len(kinds)
        return pa.table({x.split()[0]: pa.array(c, k) for x, c, k in zip(PARTS.split(", "), columns, kinds, strict=True)})

    back = blobs.repeated(rows.select("uid", "text").mapInArrow(pack, blobs.SCHEMA), bits, homes)
    texts = rows.mapInArrow(home, "slot int, uid long, doc_id long, text binary")
    return common.write_table(texts.groupBy("slot").cogroup(back.groupBy("slot")).applyInArrow(build, PARTS), "suffixes", compression="zstd")


def _repeated_ranges(suffixes: DataFrame, sizes: Sizes) -> DataFrame:
    """RANGES: first and last window start of repeated windows, some rows for each uid."""
    parts = blobs.partitions(suffixes)
    size = blobs.table_size(suffixes)
    n = max(parts, 4 * size // BUCKET_BYTES)
    bits, homes = blobs.bits_for(size // 64, parts), blobs.homes_for(size, parts)

    @common.lean
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]

        def slots() -> Iterator[tuple[int, bytes]]:
            if not rows:
                return
            bucket, p, base = Bucket(*map(list, zip(*rows, strict=True)), sizes), blobs.Packer(bits), TaskContext.get().partitionId() << 33
            done: list[np.ndarray] = []
            sent = 0
            for i, flags, hashes in bucket.resolve():
                low, places = int(bucket.low[i]), bucket.places[i]
                if flags.any():
                    done.append(_placed(flags, low, places))
                if hashes is not None and any(hashes):
                    uid = base + sent
                    sent += 1
                    asked = np.array(hashes, "<u8")
                    yield from p.add(uid, asked[asked > 0])
                    home = int(blobs.home_of(np.array([uid]), homes)[0])
                    yield -1 - home, b"\x01" + struct.pack("<qII", uid, low, len(asked)) + asked.tobytes() + flags.tobytes() + bucket.text(i) + places
            yield from p.flush()
            if done:
                r = np.concatenate(done)
                home = blobs.home_of(r["uid"], homes)
                order = np.argsort(home, kind="stable")
                for a, m in zip(*(x.tolist() for x in blobs.runs(home[order])), strict=True):
                    yield -1 - int(home[order[a]]), b"\x00" + r[order[a : a + m]].tobytes()

        yield from blobs.batches(slots())

    mask = np.uint64((1 << 48) - 1)
    kept_bits = np.uint64(16) if bits > 8 else np.uint64(24 - bits)

    @common.lean
    def gather(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Decided ranges, and for each window that other buckets may have its digest and the ranges that it decides."""
        blocks = [x for b in batches for x in b.column("block").to_pylist()]
        found = [blobs.unpack_found(x[1:]) for x in blocks if x[0]]
        pairs = {(u, h) for f in found for u, h in zip(f[0].tolist(), (f[1] & mask).tolist(), strict=True)}
        for b in _by_uid([np.frombuffer(x, _RANGE, offset=2) for x in blocks if x[0] == 0 and x[1] == 0]):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, pa.binary())], names=["uid", "ranges", "digest"])
        digests, ranges = [], []
        for x in blocks:
            if x[0] == 0 and x[1] == 1:
                uid, low, n = struct.unpack_from("<qII", x, 2)
                flags, text, places = x[18 + 8 * n : 18 + 9 * n], x[18 + 9 * n : 17 + 10 * n + sizes.length], x[17 + 10 * n + sizes.length :]
                for k, h in enumerate(np.frombuffer(x, "<u8", n, 18).tolist()):
                    if h and (uid, h >> int(kept_bits)) in pairs:
                        digests.append(hashlib.blake2b(_window(text, k, n, sizes.length), digest_size=16).digest())
                        ranges.append(b"" if flags[k] else _placed(np.ones(1, bool), low + k, places).tobytes())
        yield pa.RecordBatch.from_arrays([pa.nulls(len(digests), pa.int64()), pa.array(ranges, pa.binary()), pa.array(digests, pa.binary())], names=["uid", "ranges", "digest"])

    @common.lean
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _by_uid([np.frombuffer(b"".join(b.column(0).to_pylist()), _RANGE)])

    rows = suffixes.filter("key IS NOT NULL").select("key", "low", "high", "places")
    # places come last, so that a key that very many groups of documents have is split too
    dealt = rows.repartitionByRange(n, F.substring("key", 1, LEAD), F.xxhash64("key"), F.xxhash64("places"))
    packed = dealt.mapInArrow(sort, blobs.SCHEMA)
    found = common.write_table(blobs.repeated(packed, bits, homes).groupBy("slot").applyInArrow(gather, FOUND), "found", compression="zstd")
    windows = found.filter("digest IS NOT NULL")
    twice = windows.groupBy("digest").agg(F.count("*").alias("c")).filter("c > 1").select("digest")
    more = windows.filter("length(ranges) > 0").join(twice, "digest", "left_semi").select("ranges").mapInArrow(split, RANGES)
    return found.filter("digest IS NULL").select("uid", "ranges").union(more)


def removed(text: bytes, ranges: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes, as (start, end)."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(zip(ranges["first"].tolist(), (ranges["last"] + length).tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(z, out[-1][1])
        else:
            out.append((a, z))
    return out


def _words(text: bytes, a: int, z: int) -> int:
    """Words that lie in text[a:z] whole."""
    cut = [text[i - 1 : i + 1] for i in (a, z) if 0 < i < len(text)]
    return len(text[a:z].split()) - sum(x.split() == [x] for x in cut)


def _whole_characters(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs without the parts of characters at their ends."""
    out = []
    for a, z in runs:
        while a < z and text[a] & 0xC0 == 0x80:
            a += 1
        while z > a and z < len(text) and text[z] & 0xC0 == 0x80:
            z -= 1
        out.append((a, z))
    return out


def _kept(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    ends = [0, *(z for _, z in runs)]
    return b"".join(text[a:z] for a, z in zip(ends, [*(a for a, _ in runs), len(text)], strict=True))


def _release(spark: SparkSession) -> None:
    """Drop the shuffle files of the step before this one too: those of the last one only go at the second collection of garbage."""
    for _ in range(2):
        common.release(spark)


def dedup(docs: DataFrame, texts: bool = False, length: int = LENGTH, words: int = 0) -> DataFrame:
    """uid (``common.row_ids`` of ``docs``), doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document; with ``texts`` also ``kept``, the text without
    the removed bytes (parts of characters stay), null where nothing was removed.

    Bytes that repeated strings of ``length`` bytes cover are removed; with ``words``, runs of such bytes stay that have at most so many
    whole words and fewer than 400 bytes. A passage of more words has 2 * words + 1 bytes or more: at that length none is missed."""
    sizes = Sizes.of(length)
    parts = _suffixes(common.stored(docs), sizes)
    _release(docs.sparkSession)
    ranges = common.write_table(_repeated_ranges(parts, sizes), "ranges", compression="zstd")
    _release(docs.sparkSession)

    @common.lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, 256):
            rows = []
            for uid, doc_id, text, blocks in zip(*(c.to_pylist() for c in b.columns), strict=True):
                runs = removed(text, np.frombuffer(b"".join(blocks or ()), _RANGE), length)
                if words:
                    runs = [(a, z) for a, z in runs if z - a >= LENGTH or _words(text, a, z) > words]
                sha = hashlib.sha256(_kept(text, runs)).hexdigest()
                kept = _kept(text, _whole_characters(text, runs)) if texts and runs else None
                rows.append((uid, doc_id, len(text), sum(z - a for a, z in runs), len(runs), sha, kept))
            kinds = [pa.int64()] * 5 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in RESULT.split(", ")])

    some = parts.filter("text IS NOT NULL").select("uid", "doc_id", "text")
    some = some.join(ranges.groupBy("uid").agg(F.collect_list("ranges").alias("ranges")), "uid", "left")
    some = some.select("uid", "doc_id", "text", "ranges").mapInArrow(cut, RESULT)
    rest = parts.filter("sha IS NOT NULL").select(
        "uid", "doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"), F.lit(None).cast("binary").alias("kept")
    )
    out = some.unionByName(rest)
    return out if texts else out.drop("kept")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.stored(common.documents(spark, sf_dir))
    held = common.write_table(passages.holders(docs), "passages").withColumn("held", F.lit(1))
    _release(spark)
    out = dedup(docs).join(held, "uid", "left")
    return out.select("*", (F.col("n_removed") > 0).cast("int").alias("has_repeats"), F.col("held").isNotNull().cast("int").alias("has_passages")).drop("uid", "held")
