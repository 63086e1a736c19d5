"""Snapshot differences, keyed merges and reindex plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_time(old: DataFrame, present: DataFrame, key: str = "source_file") -> DataFrame:
    """Rows of ``present`` (key, file_mtime) whose stored time (key, file_mtime) is missing or more than a second off: those that need hashing."""
    was = old.select(key, F.col("file_mtime").alias("was"))
    near = F.abs(F.col("file_mtime") - F.col("was")) <= 1
    return present.join(was, key, "left").filter(~F.coalesce(near, F.lit(False))).drop("was")


def categories(found: DataFrame) -> DataFrame:
    """(change, notes)."""
    return found.groupBy("change").agg(F.count("*").alias("notes"))


#: Parts of a key that are ranked on their own first.
SHARES = 64


def newest(rows: DataFrame, key: str, order: str, n: int, rank: str = "rank") -> DataFrame:
    """Of each key the ``n`` rows of greatest ``order``, with their rank: what a retention keeps. Shares of a key are cut to ``n`` before
    they meet."""
    share = F.pmod(F.xxhash64(order), F.lit(SHARES))
    first = F.row_number().over(Window.partitionBy(key, "_share").orderBy(F.desc(order)))
    kept = rows.withColumn("_share", share).withColumn(rank, first).filter(F.col(rank) <= n).drop("_share")
    return kept.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter(F.col(rank) <= n)


def detect(old: DataFrame, new: DataFrame, key: str = "source_file") -> DataFrame:
    """(key, change): added, modified or deleted, by ``content_hash``; unchanged rows are left out."""
    a, b = old.select(key, F.col("content_hash").alias("was")), new.select(key, F.col("content_hash").alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "modified")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).filter("change IS NOT NULL")


def merge(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key it doesn't have."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def replace_chunks(old: DataFrame, new: DataFrame, touched: DataFrame, key: str = "note_path") -> DataFrame:
    """All chunks of touched notes give way to the new ones, so that a note that shrank leaves none behind."""
    return old.join(touched.select(key).distinct(), key, "left_anti").unionByName(new)


def delete(old: DataFrame, gone: DataFrame, key: str = "source_file") -> DataFrame:
    return old.join(gone.select(key).distinct(), key, "left_anti")


def reindex_plan(stored: DataFrame, present: DataFrame, asked: DataFrame, key: str = "source_file") -> DataFrame:
    """(key, action): for asked paths (``path``, a file or a folder) what to reindex, and what to delete as it is gone. A note is joined
    by its own path and those of the folders above it."""
    wanted = asked.select(F.rtrim(F.col("path"), F.lit("/")).alias("above")).distinct()

    def inside(notes: DataFrame) -> DataFrame:
        parts = F.split(key, "/")
        above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
        return notes.select(key, F.explode(above).alias("above")).join(wanted, "above", "left_semi").select(key).distinct()

    there, gone = inside(present), inside(stored).join(present.select(key), key, "left_anti")
    return there.withColumn("action", F.lit("reindex")).unionByName(gone.withColumn("action", F.lit("delete")))
