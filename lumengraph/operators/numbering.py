"""Dense numbers over sorted rows, without a single task that sees them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumengraph.sources.scratch import materialized


def dense(df: DataFrame, keys: Sequence[str], name: str = "id") -> DataFrame:
    """The rows with a number from 0 in the order of ``keys``: ranges are sorted and written, one file each, and a row's number is
    its place in its file plus what the files before it hold."""
    rows = materialized(df.repartitionByRange(*keys).sortWithinPartitions(*keys))
    placed = rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    sizes = placed.groupBy("_file").agg(F.count("*").alias("_n"), F.min(F.struct(*keys)).alias("_first"))
    before = Window.partitionBy(F.lit(0)).orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    sizes = sizes.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_before"))
    return placed.join(F.broadcast(sizes), "_file").withColumn(name, F.col("_before") + F.col("_place")).drop("_file", "_place", "_before")


def of_values(df: DataFrame, column: str, name: str) -> DataFrame:
    """The rows with the dense number of their value of ``column``."""
    return df.join(dense(df.select(column).distinct(), [column], name), column)
