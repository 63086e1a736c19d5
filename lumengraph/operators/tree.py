"""Folder trees: counts, a depth, and a budget of entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def folders(notes: DataFrame, path: str = "path") -> DataFrame:
    """(folder, depth, notes, total): own and total notes of every folder; the root is "" at depth 0."""
    parts = notes.select(F.split(path, "/").alias("s"))
    each = parts.select("s", F.explode(F.sequence(F.lit(0), F.size("s") - 1)).alias("depth"))
    own = (F.col("depth") == F.size("s") - 1).cast("long")
    return each.select(F.array_join(F.slice("s", F.lit(1), F.col("depth")), "/").alias("folder"), "depth", own.alias("own")).groupBy("folder", "depth").agg(F.sum("own").alias("notes"), F.count("*").alias("total"))


def limited(notes: DataFrame, depth: int, size: int, files: bool = False, path: str = "path") -> DataFrame:
    """(place, entry, is_dir, depth, notes): the first ``size`` entries below the root, depth first, a folder's files before its
    folders, each by name; nothing below ``depth`` shows or counts. ``notes`` of a folder are its own. The root has place 0 and the
    notes that are shown or could be."""
    f = folders(notes, path)
    kept = f.filter(F.col("depth").between(1, depth)).select(F.col("folder").alias("entry"), F.lit(True).alias("is_dir"), F.col("depth").cast("int").alias("depth"), "notes")
    if files:
        inside = F.size(F.split(path, "/"))
        kept = kept.union(notes.filter(inside - 1 <= depth).select(F.col(path), F.lit(False), inside.cast("int"), F.lit(None).cast("long")))
    # files (a mark below all names) before folders at every level
    last, above = F.element_at(F.split("entry", "/"), -1), F.slice(F.split("entry", "/"), F.lit(1), F.size(F.split("entry", "/")) - 1)
    key = F.concat(F.transform(above, lambda x: F.concat(F.lit("\x02"), x)), F.array(F.concat(F.when(F.col("is_dir"), F.lit("\x02")).otherwise(F.lit("\x01")), last)))
    top = kept.withColumn("key", key).orderBy("key").limit(size)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("key")).cast("int")  # of size rows
    root = f.filter(F.col("depth") <= depth).agg(F.coalesce(F.sum("notes"), F.lit(0).cast("long")).alias("notes"))
    root = root.select(F.lit(0).alias("place"), F.lit("").alias("entry"), F.lit(True).alias("is_dir"), F.lit(0).alias("depth"), "notes")
    return root.union(top.select(place.alias("place"), "entry", "is_dir", "depth", "notes"))
