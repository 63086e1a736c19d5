"""Operator 4, n-gram Jaccard join: documents whose sets of word n-grams are alike, and their components.

A set's shingles are put in one order for all documents, rare first (by the number of documents that have them, which
``blobs`` counts exactly). Two sets of Jaccard similarity t or more share a shingle within their first
n - ceil(t n) + 1; so shingles that no other document has fill most prefixes and need never be joined. Documents of
equal sets are one node. Nodes are joined on prefix shingles under the length and the positional filter, each pair is
verified once, after the suffix filter, by the exact intersection of what both share with others.

So as not to make all pairs of a group of near copies, the join has two steps. First every node is paired with one hub of
each of its prefix shingles: the node with the fewest shingles of its own, the likeliest origin of the rest. The pairs
that hold give components. Then only shingles whose nodes aren't all in one component are joined in full, and only
nodes of different components. Whatever pair is left out lies within one component already, so that components are
exact; links within them are left out.

Null and empty texts, and texts without words, have no shingle and link with nothing; fewer words than n are one
shingle; repeated rows are copies, and each has its row; a null id counts as a row, never as the least id unless its
component has no other; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengraph.llm import blobs, common
from lumengraph.llm.components import components

#: Bits of a node's parities.
BITS = 512
#: Words that a worker's cache may hold.
CACHE = 200_000
META = np.dtype([("uid", "<i8"), ("doc_id", "<i8"), ("null", "?"), ("n", "<i4"), ("sig1", "<i8"), ("sig2", "<i8")])
PROFILES = "uid long, doc_id long, n int, sig1 long, sig2 long, free int, shared binary, prefix array<long>, bits array<long>"
#: Bytes of one output batch of profiles.
_OUT = 8 << 20


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


class Shingles:
    """Distinct n-gram hashes of texts, 64 bits, ascending."""

    def __init__(self, words: int):
        self.words, self.cache = words, _Words()
        self.factors = blobs.mixed(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)

    def of(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        if len(self.cache) > CACHE:
            self.cache.clear()
        found = [t.lower().split() for t in texts]
        h = np.fromiter(map(self.cache.__getitem__, chain.from_iterable(found)), np.uint64, sum(map(len, found)))
        k, at = self.words, 0
        s = h * self.factors[0]
        for i in range(1, min(k, len(h))):
            s[:-i] += h[i:] * self.factors[i]
        s = blobs.mixed(s)
        for words in found:
            n = len(words)
            if n >= k:
                own = np.sort(s[at : at + n - k + 1])
                yield own[np.append(True, own[1:] != own[:-1])]
            elif n:
                yield blobs.mixed(np.array([(h[at : at + n] * self.factors[:n]).sum() + np.uint64(n)], np.uint64))
            else:
                yield np.empty(0, np.uint64)
            at += n


def profiles(docs: DataFrame, percent: int, words: int) -> DataFrame:
    """A row for each document: PROFILES. shared: keys of its shingles that others have too, in the common order; free:
    how many it has alone; prefix: the shared ones within its prefix; bits: ``_parities`` of the shared ones."""
    size, parts = blobs.table_size(docs), blobs.partitions(docs)
    bits, homes = blobs.bits_for(size // 3, parts), blobs.homes_for(2 * size, parts)
    rows = docs.select(common.row_ids(docs).alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text")

    @common.lean
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def slots() -> Iterator[tuple[int, bytes]]:
            s, p = Shingles(words), blobs.Packer(bits)
            for b in common.slices(batches, 256):
                meta = np.zeros(b.num_rows, META)
                uids, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
                for i, (uid, doc_id, h) in enumerate(zip(uids, ids, s.of(common.utf8(b.column(2))), strict=True)):
                    meta[i] = uid, doc_id or 0, doc_id is None, len(h), h.sum().astype(np.int64), blobs.mixed(h ^ np.uint64(0x5851F42D4C957F2D)).sum().astype(np.int64)
                    yield from p.add(uid, h)
                home = blobs.home_of(meta["uid"], homes)
                order = np.argsort(home, kind="stable")
                for a, m in zip(*(x.tolist() for x in blobs.runs(home[order])), strict=True):
                    yield -1 - int(home[order[a]]), meta[order[a : a + m]].tobytes()
            yield from p.flush()

        yield from blobs.batches(slots())

    @common.lean
    def profile(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [x for b in batches for x in b.column("block").to_pylist()]
        meta = np.concatenate([np.frombuffer(x, META, offset=1) for x in blocks if x[0] == 0])
        found = [blobs.unpack_found(x[1:]) for x in blocks if x[0]]
        uid = np.concatenate([f[0] for f in found]) if found else np.empty(0, np.int64)
        keys = np.concatenate([f[1] for f in found]) if found else np.empty(0, np.uint64)
        meta = meta[np.argsort(meta["uid"])]
        order = np.lexsort((keys, uid))
        uid, keys = uid[order], keys[order]
        low, high = np.searchsorted(uid, meta["uid"]), np.searchsorted(uid, meta["uid"], side="right")
        n, free = meta["n"], meta["n"] - (high - low)
        first = np.where(n > 0, n - (n * percent + 99) // 100 + 1, 0) - free  # so many of the shared ones
        at = 0
        while at < len(meta):
            cut, total = at, 0
            while cut < len(meta) and (cut == at or total < _OUT):
                total += 8 * int(high[cut] - low[cut])
                cut += 1
            r = range(at, cut)
            bits = _parities(keys[low[at] : high[cut - 1]], np.repeat(np.arange(cut - at), high[at:cut] - low[at:cut]), cut - at)
            m = meta[at:cut]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(m["uid"]),
                    pa.array(m["doc_id"], mask=m["null"]),
                    pa.array(m["n"]),
                    pa.array(m["sig1"]),
                    pa.array(m["sig2"]),
                    pa.array(free[at:cut].astype(np.int32)),
                    pa.array([keys[low[i] : high[i]].tobytes() for i in r], pa.binary()),
                    pa.array([keys[low[i] : low[i] + max(0, first[i])].astype(np.int64) for i in r], pa.list_(pa.int64())),
                    pa.array(list(bits), pa.list_(pa.int64())),
                ],
                names=[x.split()[0] for x in PROFILES.split(", ")],
            )
            at = cut

    packed = rows.mapInArrow(pack, blobs.SCHEMA)
    back = blobs.repeated(packed, bits, homes)
    return common.write_table(back.groupBy("slot").applyInArrow(profile, PROFILES), "profiles", compression="zstd")


def _parities(keys: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """For each row, ``BITS`` bits as 64-bit words: whether an odd number of its keys hash to the bit. Bits in which two rows
    differ are at most as many as the keys that only one of them has."""
    at = row * BITS + (blobs.mixed(keys) % np.uint64(BITS)).astype(np.int64)
    odd = (np.bincount(at, minlength=rows * BITS) & 1).astype(np.uint8).reshape(rows, BITS)
    return np.packbits(odd, axis=1).view("<i8")


def overlap_bound(x: np.ndarray, y: np.ndarray, depth: int = 2) -> int:
    """At most so many keys in both ascending arrays: halves around a pivot can share no more than the smaller has."""
    if depth == 0 or not len(x) or not len(y):
        return min(len(x), len(y))
    mid = len(x) // 2
    cut = int(np.searchsorted(y, x[mid]))
    return overlap_bound(x[:mid], y[:cut], depth - 1) + overlap_bound(x[mid:], y[cut:], depth - 1)


def verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those that hold, by exact intersections."""
    x = nodes.select(F.col("uid").alias("a"), F.col("n").alias("n_a"), F.col("shared").alias("x"))
    y = nodes.select(F.col("uid").alias("b"), F.col("n").alias("n_b"), F.col("shared").alias("y"))

    @common.lean
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n_a, n_b = (batch.column(i).to_pylist() for i in range(4))
            keep = []
            for i, (p, q) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                p, q = np.frombuffer(p, "<u8"), np.frombuffer(q, "<u8")
                least = -(-percent * (n_a[i] + n_b[i]) // (100 + percent))
                if overlap_bound(p, q) >= least and len(np.intersect1d(p, q, assume_unique=True)) >= least:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([v[i] for i in keep], pa.int64()) for v in (a, b)], names=["a", "b"])

    return pairs.join(x, "a").join(y, "b").select("a", "b", "n_a", "n_b", "x", "y").mapInArrow(check, "a long, b long")


def _may_hold(x: str, y: str, percent: int, bits: bool):
    """Length, positional and suffix filter of two nodes (n, free, i, bits) at a prefix shingle that both have: those before it
    that others have too, and those from it on, bound the overlap; so do the parities of the shared ones, which take
    the suffix filter's place in the join."""
    need = f"{percent} * ({x}.n + {y}.n)"
    long_enough = f"100 * least({x}.n, {y}.n) >= {percent} * greatest({x}.n, {y}.n)"
    at = f"(least({x}.i - {x}.free, {y}.i - {y}.free) + least({x}.n - {x}.i, {y}.n - {y}.i)) * {100 + percent} >= {need}"
    if not bits:
        return F.expr(f"{long_enough} AND {at}")
    differ = " + ".join(f"bit_count({x}.bits[{k}] ^ {y}.bits[{k}])" for k in range(BITS // 64))
    return F.expr(f"{long_enough} AND {at} AND ({x}.n - {x}.free + {y}.n - {y}.free - ({differ})) * {100 + percent} >= 2 * {need}")


def linked(docs: DataFrame, percent: int = 75, words: int = 5) -> DataFrame:
    """uid, doc_id, n_shingles, component_id, component of every document; uid: ``common.row_ids`` of ``docs``; component: a
    number of the group that also tells those apart that have no id."""
    p = profiles(common.stored(docs), percent, words)
    common.release(docs.sparkSession)
    sig = ["n", "sig1", "sig2"]
    reps = common.write_table(p.filter("n > 0").groupBy(*sig).agg(F.min("uid").alias("node"), F.min("doc_id").alias("least")), "nodes")
    nodes = p.filter(F.size("prefix") > 0).join(reps.select(F.col("node").alias("uid")), "uid", "left_semi")
    nodes = common.write_table(nodes.select("uid", "n", "free", "shared", "prefix", "bits"), "node-sets", compression="zstd")
    at = nodes.select("uid", "n", "free", F.posexplode("prefix").alias("i", "token")).withColumn("i", F.col("i") + F.col("free"))
    at = common.write_table(at, "prefixes", compression="zstd")

    hubs = at.groupBy("token").agg(F.min(F.struct("free", "uid", "n", "i")).alias("hub"), F.count("*").alias("c")).filter("c > 1").select("token", "hub")
    first = at.alias("x").join(hubs, "token").filter("x.uid <> hub.uid").filter(_may_hold("x", "hub", percent, bits=False))
    first = common.write_table(first.select(F.least("x.uid", "hub.uid").alias("a"), F.greatest("x.uid", "hub.uid").alias("b")).distinct(), "pairs")
    links = common.write_table(verified(first, nodes, percent), "links")
    labels = components(links)

    known = labels.select(F.col("node").alias("uid"), "label")
    named = at.join(known, "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    named = common.write_table(named, "prefixes", compression="zstd")
    sizes = named.groupBy("token", "label").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("token").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("labels")).filter("labels > 1").select("token", "main")
    rest = named.join(mixed, "token").join(nodes.select("uid", "bits"), "uid")
    rest = common.write_table(rest, "prefixes", compression="zstd")
    x, y = rest.filter("label <> main").alias("x"), rest.alias("y")  # of two nodes, one isn't in the shingle's main component
    more = x.join(y, F.expr("x.token = y.token AND x.label <> y.label AND (y.label = y.main OR x.uid < y.uid)")).filter(_may_hold("x", "y", percent, bits=True))
    more = more.select(F.least("x.uid", "y.uid").alias("a"), F.greatest("x.uid", "y.uid").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    new = common.write_table(verified(common.write_table(more, "pairs"), nodes, percent), "links")
    if not new.isEmpty():
        labels = components(links.union(new))

    reps = reps.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    reps = common.write_table(reps, "nodes")
    groups = common.write_table(reps.groupBy("label").agg(F.min("least").alias("component_id")), "components")
    named = common.write_table(reps.join(groups, "label").select(*sig, "component_id", F.col("label").alias("component")), "nodes")
    p = p.select("uid", "doc_id", *sig)
    full = p.filter("n > 0").join(named, sig).select("uid", "doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "component")
    empty = p.filter("n = 0").select("uid", "doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("uid").alias("component"))
    return full.unionByName(empty)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(common.documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
