"""Embedding of texts: pluggable embedders, inputs and what comes back, pooling."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumengraph.functions import text

#: Texts to vectors, in order; any callable that can be sent to executors.
Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def embed_text(breadcrumb: Column, content: Column, prefix: str = "", most_bytes: int = 0) -> Column:
    """What an embedder gets: prefix, breadcrumb and content, cut to ``most_bytes`` at a character's end (0: whole)."""
    whole = F.concat(F.lit(prefix), breadcrumb, F.lit("\n\n"), content)
    return text.first_bytes(whole, most_bytes) if most_bytes else whole


def reordered(count: int, found: Sequence[tuple[int, Sequence[float]]], dimension: int | None = None) -> list[Sequence[float]]:
    """Vectors by their index; every index from 0 once, all of one dimension."""
    if count == 0:
        return []
    if len(found) != count:
        raise ValueError(f"{len(found)} vectors for {count} texts")
    found = sorted(found, key=lambda x: x[0])
    if [i for i, _ in found] != list(range(count)):
        raise ValueError("indices aren't 0 and on")
    sizes = {len(v) for _, v in found}
    wanted = dimension or len(found[0][1])
    if sizes != {wanted} or not wanted:
        raise ValueError(f"vectors of dimensions {sorted(sizes)}, {wanted} expected")
    return [v for _, v in found]


@dataclass(frozen=True)
class Limits:
    """What a server says about itself; None where it doesn't."""

    input_length: int | None = None
    batch_tokens: int | None = None
    client_batch: int | None = None
    batch_requests: int | None = None

    def batch_and_requests(self, requests: int) -> tuple[int, int]:
        """Texts in a call, and calls at once."""
        batch = max(1, (self.batch_tokens or 4096) // (self.input_length or 512))
        batch = batch if self.client_batch is None else min(batch, self.client_batch)
        return batch, requests if self.batch_requests is None else max(1, min(requests, self.batch_requests))


def batch_limit(message: str) -> int | None:
    """The number after "maximum allowed batch size" in a server's error."""
    m = re.search(r"maximum allowed batch size\D*(\d+)", message)
    return int(m[1]) if m else None


@dataclass
class HttpEmbedder:
    """POST {model, input} to ``url``; waits and tries again on 429 and server errors; halves to the server's batch limit."""

    url: str
    model: str
    batch: int = 32
    retries: int = 3
    wait: float = 0.5
    dimension: int | None = None

    def _post(self, texts: Sequence[str]) -> list[tuple[int, list[float]]]:
        body = json.dumps({"model": self.model, "input": list(texts)}).encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=120) as answer:
            return [(d["index"], d["embedding"]) for d in json.load(answer)["data"]]

    def __call__(self, texts: Sequence[str]) -> list[Sequence[float]]:
        out: list[Sequence[float]] = []
        at, tries = 0, 0
        while at < len(texts):
            part = texts[at : at + self.batch]
            try:
                out += reordered(len(part), self._post(part), self.dimension)
                at, tries = at + len(part), 0
            except urllib.error.HTTPError as e:
                limit = batch_limit(e.read().decode(errors="replace"))
                if limit and limit < self.batch:
                    self.batch = limit
                elif (e.code == 429 or e.code >= 500) and tries < self.retries:
                    time.sleep(self.wait * 2**tries)
                    tries += 1
                else:
                    raise
            except urllib.error.URLError:
                if tries >= self.retries:
                    raise
                time.sleep(self.wait * 2**tries)
                tries += 1
        return out


def hashed_words(dimension: int = 64) -> Embedder:
    """Unit vectors of signed word hashes: a fixed embedder that needs no model."""
    import zlib

    def embed(texts: Sequence[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dimension))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dimension] += 1 - 2 * (h >> 16 & 1)
        norm = np.sqrt((out * out).sum(1))[:, None]
        return (out / np.where(norm > 0, norm, 1)).tolist()

    return embed


def embedded(rows: DataFrame, embed: Embedder, source: str = "embed_text") -> DataFrame:
    """The rows with ``vector``: one call for each Arrow batch."""
    names = rows.columns
    at = names.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = embed([t or "" for t in b.column(at).to_pylist()]) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float64()))], names=[*names, "vector"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, vector array<double>")


def pooled(vectors: Column, mask: Column) -> Column:
    """Mean of the vectors whose mask is 1, of length 1."""
    own = F.filter(F.zip_with(vectors, mask, lambda v, m: F.when(m == 1, v)), lambda v: v.isNotNull())
    total = F.aggregate(F.slice(own, 2, F.greatest(F.size(own) - 1, F.lit(0))), F.get(own, F.lit(0)), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    mean = F.transform(total, lambda x: x / F.size(own))
    norm = F.sqrt(F.aggregate(mean, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(mean, lambda x: x / norm)
