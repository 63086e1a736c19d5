"""Note, chunk and link views over the generic tables, with the same as DuckDB text.

``notes`` stand on documents and labels, ``chunks`` on embeddings (four to a note), ``links`` are arithmetic edges
between the notes of ``chunks``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengraph.sources.tables import table

NOTES_SQL = """
    SELECT d.doc_id, d.source || '/' || d.lang || '/' || CAST(d.doc_id AS VARCHAR) || '.md' AS source_file, d.text AS full_text,
           substr(replace(d.text, chr(10), ' '), 1, 40) AS title,
           list_concat(list_concat([d.lang], CASE WHEN l.quality = 1 THEN ['quality'] ELSE CAST([] AS VARCHAR[]) END),
                       CASE WHEN l.toxic = 1 THEN ['toxic'] ELSE CAST([] AS VARCHAR[]) END) AS tags,
           CAST(1704067200 + (d.doc_id * 7919) % 2592000 AS DOUBLE) AS last_modified
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""
CHUNKS_SQL = """
    SELECT vec_id, vec_id // 4 AS note_id, 'f' || CAST((vec_id // 4) % 5 AS VARCHAR) || '/n' || CAST(vec_id // 4 AS VARCHAR) || '.md' AS note_path,
           vec_id % 4 AS chunk_index, CAST(embedding AS DOUBLE[]) AS vector
    FROM embeddings
"""
LINKS_SQL = """
    SELECT n AS src, (n * 3 + 1) % c AS dst
    FROM (SELECT DISTINCT vec_id // 4 AS n FROM embeddings), (SELECT count(DISTINCT vec_id // 4) AS c FROM embeddings)
    WHERE n % 2 = 0 AND (n * 3 + 1) % c <> n
"""


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    marks = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    none = F.array().cast("array<string>")
    tags = F.concat(F.array("lang"), F.when(F.col("quality") == 1, F.array(F.lit("quality"))).otherwise(none), F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).otherwise(none))
    return d.join(marks, "doc_id", "left").select(
        "doc_id",
        F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source_file"),
        F.col("text").alias("full_text"),
        F.substring(F.replace("text", F.lit("\n"), F.lit(" ")), 1, 40).alias("title"),
        tags.alias("tags"),
        (F.lit(1704067200) + (F.col("doc_id") * 7919) % 2592000).cast("double").alias("last_modified"),
    )


def note_path(note_id):
    return F.concat(F.lit("f"), (note_id % 5).cast("string"), F.lit("/n"), note_id.cast("string"), F.lit(".md"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.expr("vec_id div 4")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", note.alias("note_id"), note_path(note).alias("note_path"), (F.col("vec_id") % 4).alias("chunk_index"), F.col("embedding").cast("array<double>").alias("vector")
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 4").alias("src")).distinct()
    count = n.agg(F.count("*").alias("c"))  # one row
    dst = (F.col("src") * 3 + 1) % F.col("c")
    return n.filter("src % 2 = 0").join(F.broadcast(count)).select("src", dst.alias("dst")).filter("src <> dst")
