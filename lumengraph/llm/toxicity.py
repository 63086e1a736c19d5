"""Operator 7, toxicity: a factorization machine over hashed terms.

A text's features are its distinct lower-case terms, hashed; a logistic factorization machine learns a weight for each
and a factor vector whose inner products weigh pairs of terms, such as an insult with the mention of a group. It is
fitted on the driver with AdaGrad on a bounded sample of labelled rows (``SAMPLE`` of smallest id hash). Features are the
terms that tell the labels of these rows apart, alone or as one of a pair: of the ``TERMS`` commonest terms all pairs are
looked at, so that terms that only count together are kept. The model is a few numbers for each feature and goes with
the scoring function to all rows, in one pass without a shuffle.

Null and empty texts have no features and get the score of the bias; terms unseen in training have no weight; repeated
rows each give a row, and of a labelled id's rows one is learned from; a null id counts as the empty string in the held-out
rule; rows of null label or without a label aren't learned from; with one class only, all scores are that class's
share; further columns are carried, but not those named like the new ones; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengraph.llm import common

BITS, FACTORS = 18, 8
#: Labelled rows that the fit uses at most.
SAMPLE = 20_000
EPOCHS, RATE, BATCH, RIDGE = 12, 0.15, 128, 1e-6
#: A term is a feature if it is in so many of the rows, and its chi-square against the label is so large (1 degree of freedom);
LEAST_ROWS, LEAST_CHI2 = 5, 15.0
#: or if a pair that it is in is: chi-square and rows of the pair, and how many times the chi-square of either term alone.
PAIR_CHI2, PAIR_ROWS, PAIR_GAIN = 60.0, 10, 1.5
#: Commonest terms of which all pairs are looked at; rows of which they are counted at once.
TERMS, PAIR_BLOCK = 2048, 1024
#: Terms that a worker's cache may hold.
CACHE = 50_000
_TERM = re.compile(r"[^\W\d_]+")


class Terms(dict):
    """From a term to its feature."""

    def __missing__(self, term: str) -> int:
        out = self[term] = xxhash.xxh64_intdigest(term.encode()) >> (64 - BITS)
        return out

    def of(self, text: str | None) -> np.ndarray:
        """Distinct features of a text, ascending."""
        if len(self) > CACHE:
            self.clear()
        found = set(_TERM.findall(text.lower())) if text else ()
        return np.array(sorted(set(map(self.__getitem__, found))), np.int64)


@lru_cache(maxsize=1)
def terms() -> Terms:
    """One for each worker process."""
    return Terms()


def _chi2(seen: np.ndarray, bad: np.ndarray, n: float, p: float) -> np.ndarray:
    """Of being in ``seen`` rows, ``bad`` of them of the p among n that have label 1."""
    return n * (bad * n - seen * p) ** 2 / np.maximum(seen * (n - seen) * p * (n - p), 1)


def _rows(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, their values (each row has norm 1) and row starts of the rows that have features, and these rows."""
    lens = np.array([len(r) for r in rows], np.int64)
    full = np.flatnonzero(lens)
    lens = lens[full]
    idx = np.concatenate([rows[i] for i in full]) if len(full) else np.empty(0, np.int64)
    return idx, np.repeat(1 / np.sqrt(lens), lens).astype(np.float32), np.cumsum(lens) - lens, full


class FactorizationMachine:
    """Logistic, of second order: bias + sum w x + sum over pairs <v, v'> x x'. Rows are ascending arrays of hashed terms."""

    def __init__(self, seed: int = 7):
        self.bias, self.seed = 0.0, seed
        self._keep(np.empty(0, np.int64))

    def _keep(self, features: np.ndarray) -> None:
        self.features = features
        self.w = np.zeros(len(features), np.float32)
        self.v = np.random.default_rng(self.seed).normal(0, 0.02, (len(features), FACTORS)).astype(np.float32)

    def places(self, row: np.ndarray) -> np.ndarray:
        """Places of a row's features among those of the model."""
        if not len(self.features):
            return np.empty(0, np.int64)
        at = np.searchsorted(self.features, row)
        at[at == len(self.features)] = 0
        return at[self.features[at] == row]

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        return self._margins([self.places(r) for r in rows])

    def _margins(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(rows), self.bias, np.float64)
        idx, x, starts, full = _rows(rows)
        if len(full):
            vx = self.v[idx] * x[:, None]
            s, q = np.add.reduceat(vx, starts), np.add.reduceat(vx * vx, starts)
            out[full] += np.add.reduceat(self.w[idx] * x, starts) + 0.5 * (s * s - q).sum(1)
        return out

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return _share(self.margins(rows))

    def fit(self, rows: list[np.ndarray], y: np.ndarray, seed: int = 11) -> None:
        """Choose features, then AdaGrad over mini-batches in a fixed random order."""
        n, p = len(y), float(y.sum())
        share = (p + 0.5) / (n + 1)
        self.bias = float(np.log(share / (1 - share)))
        if not 0 < p < n:
            return
        self._keep(_features(rows, y))
        rows = [self.places(r) for r in rows]
        gw, gv, gb = np.full(len(self.w), 1e-6, np.float32), np.full(self.v.shape, 1e-4, np.float32), 1e-6
        order = np.random.default_rng(seed)
        for _ in range(EPOCHS):
            shuffled = order.permutation(len(rows))
            for a in range(0, len(rows), BATCH):
                own = shuffled[a : a + BATCH]
                part = [rows[i] for i in own]
                error = _share(self._margins(part)) - y[own]
                gb += float(error.sum()) ** 2
                self.bias -= RATE * float(error.sum()) / np.sqrt(gb)
                idx, x, starts, full = _rows(part)
                if not len(full):
                    continue
                lens = np.diff(np.append(starts, len(idx)))
                vx = self.v[idx] * x[:, None]
                s = np.repeat(np.add.reduceat(vx, starts), lens, axis=0)
                e = (np.repeat(error[full], lens).astype(np.float32) * x)[:, None]
                grad = np.concatenate([e, e * (s - vx)], axis=1)
                sort = np.argsort(idx, kind="stable")
                at = np.flatnonzero(np.append(True, np.diff(idx[sort]) > 0))
                grad = np.add.reduceat(grad[sort], at)
                f = idx[sort][at]
                dw, dv = grad[:, 0] + RIDGE * self.w[f], grad[:, 1:] + RIDGE * self.v[f]
                gw[f] += dw * dw
                gv[f] += dv * dv
                self.w[f] -= RATE * dw / np.sqrt(gw[f])
                self.v[f] -= RATE / 3 * dv / np.sqrt(gv[f])


def _share(margins: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margins, -40, 40)))


def _counts(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows, and rows of label 1, that have each hashed term."""
    flat = np.concatenate([np.empty(0, np.int64), *rows])
    return np.bincount(flat, minlength=1 << BITS), np.bincount(flat, np.repeat(y, [len(r) for r in rows]), 1 << BITS)


def _alone(seen: np.ndarray, bad: np.ndarray, n: float, p: float) -> np.ndarray:
    """Terms that tell the labels apart by themselves."""
    return np.flatnonzero((seen >= LEAST_ROWS) & (_chi2(seen, bad, n, p) >= LEAST_CHI2))


def _common(seen: np.ndarray) -> np.ndarray:
    """The terms whose pairs are looked at."""
    most = np.argsort(-seen, kind="stable")[:TERMS]
    return np.sort(most[seen[most] >= PAIR_ROWS])


def _features(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Terms that tell the labels apart alone, or in a pair that does so better than either of its terms."""
    n, p = len(y), float(y.sum())
    seen, bad = _counts(rows, y)
    own = _common(seen)
    place = np.full(1 << BITS, -1)
    place[own] = np.arange(len(own))
    both, both_bad = np.zeros((2, len(own), len(own)), np.float32)
    for a in range(0, len(rows), PAIR_BLOCK):
        block, label = rows[a : a + PAIR_BLOCK], y[a : a + PAIR_BLOCK] > 0
        x = np.zeros((len(block), len(own)), np.float32)
        at = place[np.concatenate(block)]
        row = np.repeat(np.arange(len(block)), [len(r) for r in block])
        x[row[at >= 0], at[at >= 0]] = 1
        both += x.T @ x
        x = x[label]
        both_bad += x.T @ x
    found = [_alone(seen, bad, n, p)]
    alone = _chi2(seen[own], bad[own], n, p)
    for i in range(len(own)):
        pair = _chi2(both[i].astype(np.float64), both_bad[i].astype(np.float64), n, p)
        hit = (both[i] >= PAIR_ROWS) & (pair >= PAIR_CHI2) & (pair >= PAIR_GAIN * np.maximum(alone, alone[i]))
        hit[i] = False
        if hit.any():
            found += [own[i : i + 1], own[hit]]
    return np.unique(np.concatenate(found))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> FactorizationMachine:
    """A model of ``labels`` (doc_id, toxic), from at most ``sample`` labelled rows that aren't held out. Their features are
    written once; the driver gets counts of hashed terms, then of each row the terms that may be features."""
    usable = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    drawn = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))

    @common.lean
    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = terms().of
        for b in common.slices(batches):
            found = [of(t).astype("<i4").tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(found, pa.binary()), b.column(2).cast(pa.int32())], names=["doc_id", "features", "toxic"])

    def unpacked(b: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray]:
        return [np.frombuffer(x, "<i4").astype(np.int64) for x in b.column(0).to_pylist()], b.column(1).to_numpy().astype(np.float64)

    @common.lean
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, bad, n, p = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS), 0, 0
        for b in common.slices(batches):
            rows, y = unpacked(b)
            s, t = _counts(rows, y)
            seen, bad, n, p = seen + s, bad + t, n + len(y), p + int(y.sum())
        at = np.flatnonzero(seen)
        columns = np.append(at, -1).astype(np.int32), np.append(seen[at], n), np.append(bad[at], p).astype(np.int64)  # -1: all rows
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["feature", "seen", "bad"])

    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").mapInArrow(featured, "doc_id long, features binary, toxic int")
    rows = common.write_table(rows.groupBy("doc_id").agg(F.min("features").alias("features"), F.max("toxic").alias("toxic")), "labelled")
    counts = rows.select("features", "toxic").mapInArrow(counted, "feature int, seen long, bad long").groupBy("feature").agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad")).toArrow()
    feature, *sums = (counts.column(c).to_numpy() for c in ("feature", "seen", "bad"))
    model = FactorizationMachine()
    if not len(feature):
        return model
    n, p = (float(x[feature == -1][0]) for x in sums)
    seen, bad = (np.bincount(feature[feature >= 0], x[feature >= 0], 1 << BITS) for x in sums)
    able = np.union1d(_alone(seen, bad, n, p), _common(seen))

    @common.lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            found = [np.intersect1d(np.frombuffer(x, "<i4"), able, assume_unique=True).astype("<i4").tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary()), b.column(2)], names=["doc_id", "features", "toxic"])

    drawn_rows = rows.mapInArrow(cut, "doc_id long, features binary, toxic int").toArrow().sort_by("doc_id")
    flat = np.frombuffer(b"".join(drawn_rows.column("features").to_pylist()), "<i4").astype(np.int64)
    ends = np.cumsum([0, *(len(x) // 4 for x in drawn_rows.column("features").to_pylist())])
    model.fit([flat[a:z] for a, z in zip(ends, ends[1:])], drawn_rows.column("toxic").to_numpy().astype(np.float64))
    return model


def score(docs: DataFrame, model: FactorizationMachine, threshold: float = 0.5, out: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The columns of ``docs`` but those of ``out``, with score (0 to 1) and whether it reaches the threshold."""
    docs = docs.drop(*out)
    names = docs.columns
    at = names.index("text")

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = terms().of
        for b in common.slices(batches, 256):
            s = model.scores([of(t) for t in b.column(at).to_pylist()])
            new = [pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*names, *out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, {out[0]} double, {out[1]} int")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(docs, common.documents(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
