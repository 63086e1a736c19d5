"""Operator 1, token-ID output: sorted-string-table shards.

Documents are range-partitioned and sorted by id; each task encodes its texts and streams them into shards
(``sstable``) in the cluster's shared folder, keyed by document id, each value the document's ids as little-endian
unsigned integers of 16 bits where the vocabulary allows it, else 32 (the file's tag has the width). A manifest table lists the shards in key order with their token totals, so that a
document's place in the whole stream is its shard's offset plus what its shard holds before it. A task that is run
again writes files of new names; only those of the manifest count.

Null text encodes as empty (the end id alone); a null id sorts first; rows with equal ids are kept, by text hash;
further columns are ignored; an empty table gives no shard and an empty result.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumengraph.llm import common, sstable
from lumengraph.llm.rank_merge import byte_letters

#: Words that a worker's cache may hold.
CACHE = 600_000
#: A shard is closed at this size.
SHARD_BYTES = 128 << 20
END_ID = 1
MANIFEST = "part int, seq int, path string, bytes long, docs long, tokens long, first binary, last binary"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"
_PLAIN = re.compile(r"[A-Za-z]+\Z")
# Letters whose lower case has context or several characters, and controls that only Python splits at.
_ODD = re.compile("[\u03a3\u0130]")
_CONTROL = re.compile("[\x1c-\x1f]")
_TAIL = re.compile(r"[.,;:!?)\]}\"]+\Z")


class _Words(dict):
    """From a word (no ASCII space inside) to its ids as bytes, filled on demand."""

    def __init__(self, tok):
        self.tok, self.model = tok, tok.model
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})

    def piece(self, text: str) -> bytes:
        """Ids of one normalised pre-token."""
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(self.letters)
        return b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(text))

    def __missing__(self, word: str) -> bytes:
        if _PLAIN.match(word):
            out = self.piece(word.lower())
        else:
            tail = _TAIL.search(word)
            core = word[: tail.start()] if tail else word
            if tail and core.isalpha() and not _ODD.search(core) and unicodedata.is_normalized("NFC", core):
                out = self[core] + self.piece(tail[0])
            elif word.isalpha() and not _ODD.search(word) and unicodedata.is_normalized("NFC", word):
                out = self.piece("".join(c.lower() for c in word))
            else:
                norm = self.tok.normalizer.normalize_str(word)
                out = b"".join(b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(p)) for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(norm))
        self[word] = out
        return out


class Encoder:
    """Ids of whole texts by a file of the tokenizers library. For the lower-casing, word-end kind, whose pre-tokens
    never cross white space, words are encoded once each by the library's own steps; else, and for texts that hold a
    special string, the text goes through the library whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.by_word = getattr(self.tok.model, "end_of_word_suffix", None) == "</w>" and self.tok.normalizer is not None
        self.words = _Words(self.tok)
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not self.by_word or self.special and self.special.search(text):
            return b"".join(i.to_bytes(4, "little") for i in self.tok.encode(text, add_special_tokens=False).ids)
        if len(self.words) > CACHE:
            self.words.clear()
        return b"".join(map(self.words.__getitem__, re.split("[\t-\r ]+", text) if _CONTROL.search(text) else text.split()))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


def write_shards(docs: DataFrame, path: str, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, str]:
    """Encode and write all documents; the manifest (part, seq, path, bytes, docs, tokens, first and last key, and offset: tokens before the shard), and the folder."""
    spark = docs.sparkSession
    folder = common.uri(common.scratch(spark, "token-shards"))
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq = encoder(path), TaskContext.get().partitionId(), 0
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out = None

        def close() -> pa.RecordBatch:
            nbytes = out.close()
            out.file.close()
            return pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "path": [name], "bytes": [nbytes], "docs": [out.entries], "tokens": [tokens], "first": [first], "last": [out.last]}
            )

        for b in common.slices(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if out is None:
                    name = f"{root}/part-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.sst"
                    out, tokens, first = sstable.Writer(store.open_output_stream(name), tag=enc.width), 0, sstable.key_of(doc_id)
                ids = enc.encode(text or "") + end
                tokens += len(ids) // 4
                out.add(sstable.key_of(doc_id), np.frombuffer(ids, "<u4").astype("<u2").tobytes() if enc.width == 2 else ids)
                if out.offset + out.size >= shard_bytes:
                    yield close()
                    out, seq = None, seq + 1
        if out is not None:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tie = F.xxhash64("text")
    found = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie).mapInArrow(run, MANIFEST)
    shards = common.write_table(found, "token-manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard only
    return shards.withColumn("offset", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long"))), folder


def ids32(value: bytes, width: int) -> bytes:
    """A stored value as unsigned 32-bit ids."""
    return value if width == 4 else np.frombuffer(value, "<u2").astype("<u4").tobytes()


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for b in batches:
            for row in b.to_pylist():
                start = row["offset"]
                ids, starts, sizes, sums = [], [], [], []
                with store.open_input_file(row["path"]) as f:
                    r = sstable.Reader(f, row["bytes"])
                    for key, value in r.scan():
                        value = ids32(value, r.tag)
                        ids.append(sstable.id_of(key))
                        starts.append(start)
                        sizes.append(len(value) // 4)
                        sums.append(zlib.crc32(value))
                        start += len(value) // 4
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, sizes, sums)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, min(manifest.count(), 20_000))
    return manifest.select("path", "bytes", "offset").repartition(n, "path").mapInArrow(run, ROWS)


def lookup(manifest: DataFrame, folder: str, doc_ids: list[int | None]) -> dict[int | None, list[bytes]]:
    """Values of a few ids: in the shards whose keys reach around them, by Bloom filter and binary search (point reads; for whole
    tables use read_shards)."""
    asked = manifest.sparkSession.createDataFrame([(i, bytearray(sstable.key_of(i))) for i in dict.fromkeys(doc_ids)], "doc_id long, key binary")
    near = manifest.join(F.broadcast(asked), F.col("key").between(F.col("first"), F.col("last"))).select("part", "seq", "path", "bytes", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for b in batches:
            rows = []
            for r in b.to_pylist():
                with store.open_input_file(r["path"]) as f:
                    t = sstable.Reader(f, r["bytes"])
                    rows += [(r["part"], r["seq"], r["doc_id"], k, ids32(v, t.tag)) for k, v in enumerate(t.get(sstable.key_of(r["doc_id"])))]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "seq", "doc_id", "place", "ids"])

    found = near.mapInArrow(run, "part int, seq int, doc_id long, place int, ids binary").collect()  # values of the asked ids
    out: dict[int | None, list[bytes]] = {i: [] for i in doc_ids}
    for r in sorted(found, key=lambda r: (r.part, r.seq, r.place)):
        out[r.doc_id].append(bytes(r.ids))
    return out


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest, folder = write_shards(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return read_shards(manifest, folder)
