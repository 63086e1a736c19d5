"""Operator 2, SentencePiece encoding and decoding by a relational lattice.

Texts are cut where no piece of the vocabulary can cross (between two characters that no piece has side by side, as
before spaces), which leaves short units that repeat. The distinct units become a lattice in Spark: their substrings up
to the longest piece are exploded and equi-joined to the piece table, the edges grouped by unit, and a path is folded
over them with the higher-order function ``aggregate``. Successive rows of a file are a chunk; each chunk gets the ids of
its units as a dictionary in the shared folder, which the second pass over the texts reads; no text is shuffled.

Both passes hold texts as arrays of code points, units as their starts, and find units by a 64-bit hash; what is found is
compared by code points, so that a meeting of hashes can't give wrong ids. Memory is bounded by blocks of ``BLOCK``
characters and the dictionary of one chunk.

The fold depends on the file. A BPE file's scores are merge ranks, not log-probabilities: the path of the greatest sum
(Viterbi) isn't what the library gives for such a file, so for it the fold takes merges in the order of their
scores, leftmost first, over a bit mask of the unit's open boundaries, which gives exactly the library's ids. For a unigram file the
fold is Viterbi's. Characters without a piece become their bytes. Units above ``LONGEST`` characters, which a mask of 63
bits can't hold, are encoded by the library in place.

Null and empty texts have no ids; repeated rows each give a row; null ids are carried; further columns are ignored; an
empty table gives an empty result. Decoding gives back every text but those that hold the space mark U+2581 itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengraph.llm import blobs, common

MARK = "▁"
LONGEST = 60
#: Characters by which the pieces that may start at a place are looked up first.
HEAD = 4
#: Bytes of text that share one dictionary, about.
CHUNK = 16 << 20
#: Characters of texts that are held as arrays together; longer texts are cut at spaces.
BLOCK = 1 << 18
#: Units that are hashed together.
UNITS = 1 << 14
#: Units that all chunks share in one dictionary: those in most chunks, at most so many.
COMMON = 200_000
#: Bytes of a file of dictionaries, about; of a row group in it.
FILE, GROUP = 64 << 20, 2 << 20
#: Pieces that the joined side may have for it to be broadcast.
BROADCAST = 1_000_000
#: Different characters in pieces for which a table of all pairs is held.
ALPHABET = 8192
ENCODED = "doc_id long, ids array<int>"


class Model:
    """What a SentencePiece file holds."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        n = spec.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix or not n.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only files that keep texts as they are, with a space mark before each text, are supported")
        self.kind = spec.trainer_spec.model_type  # 1: unigram, 2: BPE
        if self.kind not in (1, 2):
            raise ValueError("unigram and BPE files only")
        if not spec.trainer_spec.byte_fallback:
            raise ValueError("only files with pieces for bytes are supported")
        p = spec.SentencePiece
        self.normal = [(x.piece, i, float(x.score)) for i, x in enumerate(spec.pieces) if x.type in (p.NORMAL, p.USER_DEFINED)]
        self.byte_ids = {int(x.piece[3:5], 16): i for i, x in enumerate(spec.pieces) if x.type == p.BYTE}
        self.ids = {x: i for x, i, _ in self.normal}
        # what each id stands for; control and unknown pieces for nothing
        own = [b""] * len(spec.pieces)
        for x, i, _ in self.normal:
            own[i] = x.replace(MARK, " ").encode()
        for b, i in self.byte_ids.items():
            own[i] = bytes([b])
        self.own = np.frombuffer(b"".join(own), np.uint8)
        self.own_size = np.array([len(x) for x in own], np.int64)
        self.own_start = np.cumsum(self.own_size) - self.own_size
        # characters of pieces have numbers from 1; beside: which may stand side by side in a piece
        pairs = {x[i : i + 2] for x, _, _ in self.normal for i in range(len(x) - 1)}
        self.number = np.zeros(0x110000, np.uint16)
        letters = sorted({ord(c) for x in pairs for c in x})
        if len(letters) >= ALPHABET:
            raise ValueError(f"pieces of more than {ALPHABET} different characters")
        self.number[letters] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        self.beside = np.zeros(self.width * self.width, bool)
        self.beside[[int(self.number[ord(x[0])]) * self.width + int(self.number[ord(x[1])]) for x in pairs]] = True
        self.before_mark = {x[0] for x in pairs if x[1] == MARK}
        self.spread = blobs.mixed(np.arange(1, 0x110001, dtype=np.uint64))
        self.odd = np.multiply.accumulate(np.full(256, 0x9E3779B97F4A7C15, np.uint64))
        n.add_dummy_prefix = False
        self.library = SentencePieceProcessor(model_proto=spec.SerializeToString())

    def parts(self, texts: list[str | None]) -> Iterator[tuple[list[str], list[int]]]:
        """Texts with marks in parts of some ``BLOCK`` characters, and the text of each; a longer text is cut before a mark."""
        held: list[str] = []
        of: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            rest = MARK + t.replace(" ", MARK) if t else ""
            while rest:
                cut = len(rest)
                if cut > BLOCK:
                    cut = self._cut(rest)
                held.append(rest[:cut])
                of.append(i)
                size += cut
                rest = rest[cut:]
                if size >= BLOCK:
                    yield held, of
                    held, of, size = [], [], 0
        if held:
            yield held, of

    def _cut(self, text: str) -> int:
        """A place near ``BLOCK`` where a unit ends for sure, else the text's end."""
        at = text.rfind(MARK, 1, BLOCK)
        while at > 0 and (text[at - 1] == MARK or text[at - 1] in self.before_mark):
            at = text.rfind(MARK, 1, at)
        return at if at > 0 else len(text)

    def cut(self, parts: list[str]) -> Units:
        """Units of successive parts."""
        chars = code_points("".join(parts))
        k = self.number[chars].astype(np.int32)
        ends = np.cumsum([len(x) for x in parts])
        first = np.ones(len(chars), bool)
        first[1:] = ~self.beside[k[:-1] * self.width + k[1:]]
        first[ends[:-1]] = True
        start = np.flatnonzero(first)
        return self.hashed(chars, start, np.searchsorted(start, ends))

    def hashed(self, chars: np.ndarray, start: np.ndarray, ends: np.ndarray) -> Units:
        size = np.diff(np.append(start, len(chars)))
        most = int(size.max()) if len(size) else 0
        while len(self.odd) < most:
            self.odd = np.multiply.accumulate(np.full(2 * len(self.odd), 0x9E3779B97F4A7C15, np.uint64))
        h = np.empty(len(start), np.uint64)
        for a in range(0, len(start), UNITS):  # so that little more than the code points is held
            own, z = start[a : a + UNITS], min(a + UNITS, len(start))
            part = chars[own[0] : start[z] if z < len(start) else len(chars)]
            at = np.arange(len(part)) - np.repeat(own - own[0], size[a:z])
            h[a:z] = np.add.reduceat(self.spread[part] * self.odd[at], own - own[0])
        return Units(chars, start, size, blobs.mixed(h), ends)

    def ids_of(self, piece: str) -> list[int]:
        """A piece's id, or those of its bytes."""
        if piece in self.ids:
            return [self.ids[piece]]
        return [self.byte_ids[b] for b in piece.encode()]

    def decoded(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """UTF-8 of the texts whose ids end at ``ends``."""
        size = self.own_size[ids]
        flat = self.own[ragged(self.own_start[ids], size)].tobytes()
        upto = np.append(0, np.cumsum(size))[np.append(0, ends)].tolist()
        return [flat[a + 1 : z] for a, z in zip(upto, upto[1:])]


class Units:
    """Units of some texts: all code points, where each starts, its size and hash; at ``ends`` those of a text end."""

    def __init__(self, chars: np.ndarray, start: np.ndarray, size: np.ndarray, hash_: np.ndarray, ends: np.ndarray):
        self.chars, self.start, self.size, self.hash, self.ends = chars, start, size, hash_, ends

    def differ(self, own: np.ndarray, other: Units, theirs: np.ndarray) -> np.ndarray:
        """Which of the units ``own`` aren't the units ``theirs`` of the other."""
        out = self.size[own] != other.size[theirs]
        same = np.flatnonzero(~out)
        size = self.size[own[same]]
        wrong = self.chars[ragged(self.start[own[same]], size)] != other.chars[ragged(other.start[theirs[same]], size)]
        if wrong.any():
            out[same[np.unique(np.repeat(np.arange(len(same)), size)[wrong])]] = True
        return out

    def strings(self, own: np.ndarray) -> pa.StringArray:
        size = self.size[own]
        chars = self.chars[ragged(self.start[own], size)]
        wide = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
        ends = np.append(0, np.cumsum(wide))[np.append(0, np.cumsum(size))].astype(np.int32)
        return pa.StringArray.from_buffers(len(own), pa.py_buffer(ends), pa.py_buffer(chars.tobytes().decode("utf-32-le").encode()))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers from each start, so many."""
    upto = np.cumsum(size)
    return np.repeat(start - upto + size, size) + np.arange(int(upto[-1]) if len(upto) else 0)


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def _flat(column: pa.ChunkedArray) -> tuple[bytes, np.ndarray]:
    """All bytes of a column without nulls, and each value's size."""
    c = column.combine_chunks()
    if not len(c):
        return b"", np.empty(0, np.int64)
    ends = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
    return c.buffers()[2][int(ends[0]) : int(ends[-1])].to_pybytes(), np.diff(ends).astype(np.int64)


class Dictionary:
    """Ids of distinct units, by hash."""

    def __init__(self, m: Model, tables: list[pa.Table]):
        t = pa.concat_tables(tables) if tables else pa.table({"unit": pa.array([], pa.string()), "ids": pa.array([], pa.binary())})
        raw, _ = _flat(t.column("unit"))
        size = pc.utf8_length(t.column("unit")).to_numpy().astype(np.int64)
        self.units = m.hashed(code_points(raw.decode()), np.cumsum(size) - size, np.empty(0, np.int64))
        raw, size = _flat(t.column("ids"))
        self.ids, self.size = np.frombuffer(raw, "<i4"), size // 4
        self.start = np.cumsum(self.size) - self.size
        self.order = np.argsort(self.units.hash, kind="stable")
        self.sorted = self.units.hash[self.order]

    def find(self, units: Units, own: np.ndarray) -> np.ndarray:
        """Places of the units ``own``, -1 of those that aren't there."""
        if not len(self.sorted):
            return np.full(len(own), -1)
        at = np.searchsorted(self.sorted, units.hash[own])
        at[at == len(self.sorted)] = 0
        out = self.order[at]
        hit = self.sorted[at] == units.hash[own]
        hit[hit] = ~units.differ(own[hit], self.units, out[hit])
        return np.where(hit, out, -1)


def encode_units(units: DataFrame, path: str) -> DataFrame:
    """(unit, uses, pieces) of distinct units (unit, uses) of up to ``LONGEST`` characters; a piece that the vocabulary lacks is one character."""
    m, spark = model(path), units.sparkSession
    least = 2 if m.kind == 2 else 1  # merges make pieces of two characters and more
    ranks = {c: i for i, c in enumerate(sorted({-s for _, _, s in m.normal}))}
    table = spark.createDataFrame([(t, ranks[-s], -s) for t, _, s in m.normal if len(t) >= least], "piece string, rank long, cost double")
    reach: dict[str, int] = {}
    for t, _, _ in m.normal:
        if len(t) >= HEAD:
            reach[t[:HEAD]] = max(len(t), reach.get(t[:HEAD], 0))
    heads = spark.createDataFrame(list(reach.items()) or [("", 0)], "head string, reach int")
    if len(m.normal) <= BROADCAST:
        table, heads = F.broadcast(table), F.broadcast(heads)
    n = F.length("unit")
    starts = units.select("unit", F.explode(F.sequence(F.lit(0), n - 1)).alias("start"))
    starts = starts.withColumn("head", F.substring("unit", F.col("start") + 1, F.lit(HEAD))).join(heads, "head", "left")
    upto = F.least(F.coalesce("reach", F.lit(HEAD - 1)), n - F.col("start"))
    spans = starts.filter(upto >= least).select("unit", "start", F.explode(F.sequence(F.lit(least), upto)).alias("len"))
    edges = spans.withColumn("piece", F.substring("unit", F.col("start") + 1, F.col("len"))).join(table, "piece")
    end = F.col("start") + F.col("len")
    if m.kind == 2:
        ends = _left(1, F.col("start")) + _left(1, end)
        edge = F.struct((F.col("rank") * 64 + F.col("start")).alias("order"), ends.alias("ends"), (_left(2, end) - _left(1, F.col("start"))).alias("span"))
    else:
        edge = F.struct("cost", "start", end.alias("end"))
    lattice = edges.groupBy("unit").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    empty = F.array().cast(lattice.schema["edges"].dataType)
    lattice = units.join(lattice, "unit", "left").select("unit", "uses", F.coalesce("edges", empty).alias("edges"))
    lattice = lattice.select("unit", "uses", (_merged(n) if m.kind == 2 else _viterbi(n, max((-s for _, _, s in m.normal), default=0.0) + 10)).alias("cuts"))
    pieces = F.transform(F.slice("cuts", 1, F.size("cuts") - 1), lambda a, i: F.substring("unit", a + 1, F.get("cuts", i + 1) - a))
    return lattice.select("unit", "uses", pieces.alias("pieces"))


def _left(value: int, by: Column) -> Column:
    return F.call_function("shiftleft", F.lit(value).cast("long"), by)


def _merged(n: Column) -> Column:
    """Open boundaries left when all merges are done, ascending: each merge is the edge of least rank, then start, whose
    ends are open with one open boundary between."""

    def step(mask: Column, _: Column) -> Column:
        able = F.filter("edges", lambda e: (F.bit_count(mask.bitwiseAND(e["span"])) == 3) & (mask.bitwiseAND(e["ends"]) == e["ends"]))
        first = F.get(able, F.lit(0))
        # what lies between the ends is closed
        return mask.bitwiseAND(F.bitwise_not(F.coalesce(first["span"] - first["ends"], F.lit(0).cast("long"))))

    mask = F.aggregate(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), _left(2, n) - 1, step)
    bits = F.sequence(F.lit(0), n)
    return F.element_at(F.transform(F.array(mask), lambda m: F.filter(bits, lambda i: F.call_function("shiftright", m, i).bitwiseAND(F.lit(1).cast("long")) == 1)), 1)


def _viterbi(n: Column, worst: float) -> Column:
    """Boundaries of the path of least cost, of equal ones that whose last piece starts first, in the library's single precision;
    a character without a piece costs ``worst``."""
    state = "array<struct<cost:float,start:int,cuts:array<int>>>"

    def step(best: Column, i: Column) -> Column:
        def into(start: Column, cost: Column) -> Column:
            before = F.get(best, start)
            return F.struct((before["cost"] + cost.cast("float")).cast("float").alias("cost"), start.cast("int").alias("start"), F.concat(before["cuts"], F.array(i)).alias("cuts"))

        found = F.transform(F.filter("edges", lambda e: e["end"] == i), lambda e: into(e["start"], e["cost"]))
        return F.concat(best, F.array(F.array_min(F.concat(found, F.array(into(i - 1, F.lit(worst)))))))

    zero = F.array(F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("start"), F.array(F.lit(0)).alias("cuts"))).cast(state)
    return F.element_at(F.aggregate(F.sequence(F.lit(1), n), zero, step), -1)["cuts"]


def _looked_up(m: Model, units: Units, books: list[Dictionary]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all units, and how many of each."""
    _, first, back = np.unique(units.hash, return_index=True, return_inverse=True)
    # units that only have another's hash are looked up on their own
    odd = np.flatnonzero(units.differ(np.arange(len(back)), units, first[back]))
    if len(odd):
        back[odd] = len(first) + np.arange(len(odd))
        first = np.append(first, odd)
    flat, size, left = [np.empty(0, np.int32)], np.zeros(len(first), np.int64), np.arange(len(first))
    start, total = np.zeros(len(first), np.int64), 0
    for book in books:
        at = book.find(units, first[left])
        hit = at >= 0
        start[left[hit]], size[left[hit]] = book.start[at[hit]] + total, book.size[at[hit]]
        flat.append(book.ids)
        total += len(book.ids)
        left = left[~hit]
    if len(left):
        for i, u in zip(left.tolist(), units.strings(first[left]).to_pylist(), strict=True):
            own = np.array(m.library.encode(u.replace(MARK, " ")), np.int32)
            start[i], size[i] = total, len(own)
            flat.append(own)
            total += len(own)
    n = size[back]
    return np.concatenate(flat)[ragged(start[back], n)], n


class _Encoder:
    """Both passes over the texts of stored rows (uid, doc_id, text)."""

    def __init__(self, path: str, shift: int, slots: int = 0, folder: str = ""):
        self.path, self.shift, self.slots, self.folder = path, shift, slots, folder

    def chunked(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        for b in common.slices(batches, 256):
            chunk = b.column(0).to_numpy() >> self.shift
            edge = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
            for a, z in zip(edge, edge[1:]):
                if z > a:
                    yield int(chunk[a]), b.slice(a, z - a)

    def distinct(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(chunk, unit), each pair once for a task; units above LONGEST aren't needed."""
        m, now, seen = model(self.path), None, np.empty(0, np.uint64)
        for chunk, b in self.chunked(batches):
            if chunk != now:
                now, seen = chunk, np.empty(0, np.uint64)
            for part, _ in m.parts(b.column(2).to_pylist()):
                units = m.cut(part)
                found, first = np.unique(units.hash, return_index=True)
                at = np.searchsorted(seen, found)
                new = np.append(seen, np.uint64(0))[at] != found if len(seen) else np.ones(len(found), bool)
                new[at == len(seen)] = True
                seen = np.insert(seen, at[new], found[new])
                own = first[new]
                own = own[units.size[own] <= LONGEST]
                for a in range(0, len(own), 50_000):
                    words = units.strings(own[a : a + 50_000])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), chunk)), words], names=["chunk", "unit"])

    def ids(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """doc_ids, ids of these texts, and where each text's end."""
        m, now, books = model(self.path), None, []
        store, root = fs.FileSystem.from_uri(self.folder)
        for chunk, b in self.chunked(batches):
            if chunk != now:
                books = []  # before the next is read
                now, books = chunk, [_common(self.path, self.folder), Dictionary(m, _tables(store, f"{root}/slot={chunk % self.slots}", chunk))]
            count, flat = np.zeros(b.num_rows, np.int64), [np.empty(0, np.int32)]
            for part, of in m.parts(b.column(2).to_pylist()):
                units = m.cut(part)
                own, n = _looked_up(m, units, books)
                flat.append(own)
                upto = np.append(0, np.cumsum(n))
                np.add.at(count, of, np.diff(upto[np.append(0, units.ends)]))
            yield b.column(1), np.concatenate(flat), np.cumsum(count)


@lru_cache(maxsize=1)
def _common(path: str, folder: str) -> Dictionary:
    store, root = fs.FileSystem.from_uri(folder)
    return Dictionary(model(path), _tables(store, f"{root}/slot=common", None))


def _tables(store: fs.FileSystem, folder: str, chunk: int | None) -> list[pa.Table]:
    """Rows (unit, ids) of one chunk, of the row groups that may have it; a chunk of empty texts may have no file."""
    out = []
    for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        if not f.base_name.endswith(".parquet"):
            continue
        file = pq.ParquetFile(store.open_input_file(f.path))
        for g in range(file.num_row_groups):
            if chunk is None:
                out.append(file.read_row_group(g, ["unit", "ids"]))
                continue
            at = file.metadata.row_group(g)
            s = next(at.column(i).statistics for i in range(at.num_columns) if at.column(i).path_in_schema == "chunk")
            if s is None or s.min <= chunk <= s.max:
                t = file.read_row_group(g, ["chunk", "unit", "ids"])
                out.append(t.filter(pc.equal(t.column("chunk"), chunk)).select(["unit", "ids"]))
    return out


def _prepared(docs: DataFrame, path: str) -> tuple[DataFrame, _Encoder]:
    """Rows (uid, doc_id, text), and what encodes them: the dictionaries are written here."""
    docs, spark = common.stored(docs), docs.sparkSession
    rows = docs.select(common.row_ids(docs).alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    # a file's bytes are about half of its texts'
    each = 2 * blobs.table_size(docs) // max(1, docs.count())
    shift = max(7, (CHUNK // max(1, each)).bit_length() - 1)

    @common.lean
    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            ids = [np.fromiter(chain.from_iterable(map(m.ids_of, x)), "<i4").tobytes() for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary())], names=["unit", "uses", "ids"])

    pairs = common.write_table(rows.mapInArrow(common.lean(_Encoder(path, shift).distinct), "chunk long, unit string"), "units", compression="zstd")
    with common.setting(spark, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "20000"):
        uses = pairs.groupBy("unit").agg(F.count("*").alias("uses"))
        cut = encode_units(uses, path)
        units = common.write_table(cut.mapInArrow(numbered, "unit string, uses long, ids binary"), "unit-ids", compression="zstd")
    common.release(spark)
    level = F.floor(F.log2("uses") * 8).alias("level")
    often, total = None, 0
    for r in units.groupBy(level).agg(F.count("*").alias("c")).orderBy(F.desc("level")).collect():  # a few hundred at most
        total += r.c
        if total > COMMON:
            break
        often = r.level
    folder = common.uri(common.scratch(spark, "dictionaries"))
    rare = units if often is None else units.filter(level < often)
    left = pairs
    if often is not None:
        shared = units.filter(level >= often).select("unit", "ids")
        shared.coalesce(1).write.option("compression", "zstd").parquet(f"{folder}/slot=common")
        left = pairs.join(F.broadcast(shared.select("unit")), "unit", "left_anti")  # COMMON rows at most
    slots = max(blobs.partitions(docs), 32 * pairs.count() // FILE, 1)
    known = left.join(rare, "unit").select(F.pmod("chunk", F.lit(slots)).alias("slot"), "chunk", "unit", "ids")
    known = known.repartition(slots, "slot").sortWithinPartitions("slot", "chunk")
    known.write.mode("append").option("compression", "zstd").option("parquet.block.size", GROUP).partitionBy("slot").parquet(folder)
    common.release(spark)
    return rows, _Encoder(path, shift, slots, folder)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids of every text, as ENCODED."""
    rows, encoder = _prepared(docs, path)

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, ids, ends in encoder.ids(batches):
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([doc_ids, lists], names=["doc_id", "ids"])

    return rows.mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of (doc_id, ids)."""

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in common.slices(batches, 256):
            lists = b.column(1)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            texts = [x.decode(errors="replace") for x in m.decoded(lists.flatten().to_numpy(zero_copy_only=False), ends)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def summary(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers), decoded_crc32 (of the decoded text's UTF-8)
    of every text, in the pass that encodes."""
    rows, encoder = _prepared(docs, path)

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for doc_ids, ids, ends in encoder.ids(batches):
            raw, at = ids.astype("<i4").tobytes(), [0, *ends.tolist()]
            crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(at, at[1:])]
            back = [zlib.crc32(x) for x in m.decoded(ids, ends)]
            yield pa.RecordBatch.from_arrays([doc_ids, *(pa.array(x, pa.int64()) for x in (np.diff(at), crc, back))], names=["doc_id", "n_tokens", "ids_crc32", "decoded_crc32"])

    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, decoded_crc32 long")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(common.documents(spark, sf_dir), model_path())
