"""Vector distances, ranked retrieval and the nearest-neighbour graph."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in one block of the nearest-neighbour grid.
BLOCK = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def similarity(distance: Column) -> Column:
    """1 for distance 0, towards 0 far away."""
    return 1 / (1 + F.greatest(distance, F.lit(0.0)))


def normalized(v: Column) -> Column:
    """Unit length; vectors within 0.001 of it stay as they are, those shorter than 1e-12 become null."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm <= 1e-12, F.lit(None)).when(F.abs(norm - 1) > 1e-3, F.transform(v, lambda x: x / norm)).otherwise(v)


def literal(vector: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def topk(chunks: DataFrame, query: Column, k: int, keys: Sequence[str] = ("vec_id",)) -> DataFrame:
    """The k rows nearest to one vector, with their ``distance``: a bounded heap in each task, then one of the heaps."""
    return chunks.withColumn("distance", squared_l2(F.col("vector"), query)).orderBy("distance", *keys).limit(k)


def _grid(left: DataFrame, right: DataFrame, cell, schema: str) -> DataFrame:
    """``cell`` of every pair of blocks of rows on either side, (id, vector) on the left and (other, with) on the right; blocks are as
    many as hold ``BLOCK`` rows each."""
    rows, columns = (max(1, -(-x.count() // BLOCK)) for x in (left, right))

    def places(key: str, n: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    a = left.select("id", "vector", places("id", rows).alias("r"), every(columns).alias("c"))
    b = right.select("other", "with", places("other", columns).alias("column"), every(rows).alias("row"))
    return a.groupBy("r", "c").cogroup(b.groupBy("row", "column")).applyInArrow(cell, schema)


def _matrix(t: pa.Table, column: str = "vector") -> np.ndarray:
    return np.array(t.column(column).to_pylist(), np.float64)


def nearest(queries: DataFrame, chunks: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """(query_index, vec_id, distance, rank) of the k nearest of each row of ``queries`` (query_index, vector), ties by key.

    A grid of blocks, each multiplied with numpy, which keeps k candidates a query."""

    def cell(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return pa.table({"query_index": pa.array([], pa.int64()), key: pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        a, b = _matrix(x), _matrix(y, "with")
        d = np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0)
        n = min(k, d.shape[1])
        p, q = np.nonzero(d <= np.partition(d, n - 1, axis=1)[:, n - 1 : n] + 1e-9)  # ties too
        return pa.table({"query_index": x.column("id").to_numpy()[p], key: y.column("other").to_numpy()[q], "distance": ((a[p] - b[q]) ** 2).sum(1)})

    left = queries.select(F.col("query_index").cast("long").alias("id"), "vector")
    right = chunks.select(F.col(key).cast("long").alias("other"), F.col("vector").alias("with"))
    found = _grid(left, right, cell, f"query_index long, {key} long, distance double")
    rank = F.row_number().over(Window.partitionBy("query_index").orderBy(F.round("distance", 9), key))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def best_by_note(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(note_id, note_path, query_index, sim, chunk_index): of each note, for each row of ``queries`` (query_index, vector), the
    likest chunk, ties to the first. ``BLOCK`` queries at once go with the function; each Arrow batch sends one row a note and query."""
    asked = queries.orderBy("query_index").toArrow()  # the chunks of one note
    out = None
    for at in range(0, max(1, asked.num_rows), BLOCK):
        part = asked.slice(at, BLOCK)
        index, matrix = part.column("query_index").to_numpy().astype(np.int64), _matrix(part)

        def run(batches: Iterator[pa.RecordBatch], index=index, matrix=matrix) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows or not len(index):
                    continue
                note, chunk = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 2))
                v = np.array(b.column(3).to_pylist(), np.float64)
                sim = 1 / (1 + np.array([((v - q) ** 2).sum(1) for q in matrix]))
                order = np.lexsort((chunk, note))
                first = np.flatnonzero(np.append(True, np.diff(note[order]) != 0))
                for q, own in zip(index.tolist(), np.round(sim, 9)[:, order], strict=True):
                    top = np.maximum.reduceat(own, first)
                    hit = np.flatnonzero(own == np.repeat(top, np.diff(np.append(first, len(order)))))
                    hit = hit[np.searchsorted(hit, first)]  # the first of each note's likest
                    at = order[hit]
                    yield pa.RecordBatch.from_arrays([pa.array(note[at]), b.column(1).take(pa.array(at)), pa.array(np.full(len(at), q)), pa.array(sim[np.flatnonzero(index == q)[0], at]), pa.array(chunk[at])], names=["note_id", "note_path", "query_index", "sim", "chunk_index"])

        found = chunks.select("note_id", "note_path", "chunk_index", "vector").mapInArrow(run, "note_id long, note_path string, query_index long, sim double, chunk_index long")
        out = found if out is None else out.unionByName(found)
    first = F.struct(F.round("sim", 9), -F.col("chunk_index"))
    return out.groupBy("note_id", "note_path", "query_index").agg(F.max("sim").alias("sim"), F.max_by("chunk_index", first).alias("chunk_index"))


def knn_graph(chunks: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """(i, j, sim, rank): the k greatest dot products of each row with others, ties by j.

    The matrix of all products is cut into a grid of blocks; each cell multiplies two blocks with numpy and keeps k
    candidates a row, so that k x blocks rows are ranked for each row, not all products."""

    def cell(x: pa.Table, y: pa.Table) -> pa.Table:
        i, j = x.column("id").to_numpy(), y.column("other").to_numpy()
        if not len(i) or not len(j):
            return pa.table({"i": pa.array([], pa.int64()), "j": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
        a, b = _matrix(x), _matrix(y, "with")
        s = a @ b.T
        s[i[:, None] == j[None]] = -np.inf
        n = min(k, len(j))
        cut = -np.partition(-s, n - 1, axis=1)[:, n - 1]
        p, q = np.nonzero((s >= cut[:, None] - 1e-12) & np.isfinite(s))
        return pa.table({"i": i[p], "j": j[q], "sim": (a[p] * b[q]).sum(1)})

    left = chunks.select(F.col(key).cast("long").alias("id"), "vector")
    right = chunks.select(F.col(key).cast("long").alias("other"), F.col("vector").alias("with"))
    near = _grid(left, right, cell, "i long, j long, sim double")
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.round("sim", 9).desc(), "j"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k)


def one_dimension(chunks: DataFrame, vector: str = "vector") -> int:
    """The size that all vectors have; an error if they differ."""
    low, high = chunks.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if low != high:
        raise ValueError(f"vectors of {low} to {high} dimensions")
    return low or 0


def save_graph(graph: DataFrame, path: str) -> None:
    """(i, j, sim, rank) as Parquet; readers see all or nothing."""
    graph.select("i", "j", "sim", "rank").write.mode("overwrite").parquet(path)


def load_graph(spark, path: str) -> DataFrame:
    """What ``save_graph`` wrote: ranks from 1 without gaps, no row its own neighbour, neighbours that have rows."""
    g = spark.read.schema("i long, j long, sim double, rank int").parquet(path)
    rows = g.groupBy("i").agg(F.max("rank").alias("most"), F.count_distinct("rank").alias("n"), F.min("rank").alias("least"))
    if not rows.filter("most <> n OR least <> 1").isEmpty() or not g.filter("i = j OR sim IS NULL").isEmpty():
        raise ValueError(f"{path} holds no graph")
    if not g.join(rows.select(F.col("i").alias("j")), "j", "left_anti").isEmpty():
        raise ValueError(f"{path}: neighbours without rows")
    return g
