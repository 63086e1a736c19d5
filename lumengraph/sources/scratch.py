"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, tag: str) -> str:
    """A new folder under ``spark.checkpoint.dir`` (a temporary one where a local session leaves that unset, as in tests)."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lumengraph-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def materialized(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: plans that use a frame at every level stay short, and no executor's loss costs
    more than a read."""
    spark = df.sparkSession
    path = folder(spark, "level")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
