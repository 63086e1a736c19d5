"""Operator 9, media columns: baseline JPEG.

Each text's UTF-8 bytes, padded with spaces to a positive multiple of 192, become a baseline JPEG in a binary column
(``jpeg``: the payload's bytes are its coefficients, so nothing is lost). Reading parses the markers, Huffman-decodes
the scans, and reconstructs the payload, the dimensions and a DC-only luminance thumbnail with its hashes. Two passes
without a shuffle; the files lie in a Parquet table in the shared folder between them.

Null and empty texts are 192 spaces; repeated rows each give a row; null ids are carried; further columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lumengraph.llm import common, jpeg

MEDIA = "doc_id long, n_bytes long, media binary"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, thumbnail_hash string"
#: Bytes of media decoded at once in a worker.
BATCH = 2 << 20


def padded(text: bytes) -> bytes:
    return text.ljust(max(1, -(-len(text) // jpeg.UNIT)) * jpeg.UNIT, b" ")


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, 256):
            texts = common.utf8(b.column(1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array([jpeg.encode(padded(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, MEDIA)


def features(media: DataFrame) -> DataFrame:
    """What the stored files hold; columns as FEATURES."""
    names = [x.split()[0] for x in FEATURES.split(", ")]

    def decoded(files: list[bytes]) -> Iterator[tuple]:
        images = [jpeg.parse(f) for f in files]
        for f, image, coefs in zip(files, images, jpeg.coefficients(images), strict=True):
            p = jpeg.payload(image, coefs)
            mean, step = jpeg.thumbnail_hashes(jpeg.luminance(image, coefs))
            size = f"{image.width}x{image.height}"
            yield len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(f), hashlib.sha256(f).hexdigest(), f"{size}:{mean}:{step}", image.width, image.height, f"{mean}{step}"

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        done = [(i, n, *x) for (i, n, _), x in zip(rows, decoded([r[2] for r in rows]), strict=True)]
        kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[k.split()[1]]) for c, k in zip(zip(*done, strict=True), FEATURES.split(", "), strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for b in common.slices(batches, 64):
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows.append(r)
                size += len(r[2])
                if size >= BATCH:
                    yield batch(rows)
                    rows, size = [], 0
        if rows:
            yield batch(rows)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(common.write_table(to_media(common.documents(spark, sf_dir)), "media", compression="zstd"))
