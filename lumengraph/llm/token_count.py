"""Operator 5, token counts: rank-synchronous array merging.

Texts are cut into pre-tokens; the distinct new ones of a slice of documents are merged together as ragged numpy
arrays (``rank_merge``) and their surviving symbols counted; a document's count is the sum over its pre-tokens.
One pass over the scan: no shuffle, and no state but a bounded cache of pre-token counts in each worker.

Null text counts as empty (0 tokens); repeated rows each give a row; further columns are ignored; an empty table
gives an empty result. Special strings of the tokenizer inside a text are one token, as the library has it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from lumengraph.llm import common
from lumengraph.llm.rank_merge import RankMerger

#: Entries that a worker's cache may hold.
CACHE = 400_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
# The pre-token pattern of the tokenizer's byte-level format (fixed value), and the same for texts of ASCII only.
_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


class TokenCounter:
    """Exact token counts of texts for one byte-level BPE file."""

    def __init__(self, path: str):
        self.merger = RankMerger(path)
        self.special = re.compile("|".join(map(re.escape, self.merger.specials))) if self.merger.specials else None
        self.cache: dict[str, int] = {}

    def pieces(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and the number of special strings."""
        find = (_ASCII if text.isascii() else _PATTERN).findall
        if self.special is None or not self.special.search(text):
            return find(text), 0
        parts = self.special.split(text)
        return [x for p in parts for x in find(p)], len(parts) - 1

    def count(self, texts: list[str]) -> list[int]:
        cut = [self.pieces(t) for t in texts]
        if len(self.cache) > CACHE:
            self.cache.clear()
        new = [x for x in set().union(*(x for x, _ in cut)) if x not in self.cache]
        self.cache.update(zip(new, self.merger.count([x.encode() for x in new]).tolist(), strict=True))
        get = self.cache.__getitem__
        return [sum(map(get, x)) + n for x, n in cut]


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    """One for each worker process."""
    return TokenCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, UTF-8 bytes, tokens, and whether the tokens exceed ``limit``; ``path``: a tokenizer file that all executors have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in common.slices(batches, 256):
            texts = [x or "" for x in b.column(1).to_pylist()]
            n = c.count(texts)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
