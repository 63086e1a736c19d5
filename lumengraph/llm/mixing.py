"""Operator 6, mixing sources to target weights.

Every document gets a hash-random key; documents are dealt into ranges of the key within their source, sorted there,
and get the number of words before them in their source: a prefix sum in three levels (row in range, range in block
of ranges, block in source), so that a source with a third of all rows is spread over many tasks. A source's budget
is cut out of the endlessly repeated sequence of its documents: each epoch takes a document whole, but for the one
at the cut, of which the words up to the budget count.

Budgets: sources by code point, null last, have the weights in turn and share ``ratio`` times all words; none is above
``max_epochs`` times its own words, and what it can't take the others share by weight. The share per weight unit at
which this balances is found over the sources sorted by the share at which each is full.

Null text has size 0, and takes nothing; the key is of id and text, so that rows of one id, or of none, are spread too, and
only rows equal in both, which are interchangeable, have one key; further columns are ignored; an empty table gives an empty result.
Only DataFrame functions; what has a single partition is a row for each source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumengraph.llm import common

#: Rows of a source in one range of keys, about; ranges in one block.
RANGE_ROWS, BLOCK_RANGES = 512, 1024


def sizes(docs: DataFrame) -> DataFrame:
    """uid, doc_id, source, src (the source as a key that is never null), size in words, and the hash-random key."""
    return docs.select(
        common.row_ids(docs).alias("uid"),
        F.col("doc_id").cast("long").alias("doc_id"),
        "source",
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("src"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(common.SPACE)).cast("long").alias("size"),
        F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("#"), F.coalesce("text", F.lit("")))).alias("key"),
    )


def budgets(sized: DataFrame, ratio: float = 1.5, weights: Sequence[int] = (3, 1, 2), max_epochs: int = 2) -> DataFrame:
    """src, source_size, target of each source of (source, src, size)."""
    every = Window.partitionBy(F.lit(0))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    s = sized.groupBy("source", "src").agg(F.sum("size").alias("source_size")).withColumn("weight", weight).withColumn("full", F.lit(max_epochs) * F.col("source_size"))
    rank = F.row_number().over(every.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last()))
    s = s.withColumn("rank", rank)
    before = every.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(ratio) * F.sum("source_size").over(every) - F.coalesce(F.sum("full").over(before), F.lit(0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    s = s.withColumn("unit", left / open_weight)
    found = F.min(F.when(F.col("full") / F.col("weight") >= F.col("unit"), F.struct("rank", "unit"))).over(every)["unit"]
    return s.select("src", "source_size", F.least(F.col("full").cast("double"), found * F.col("weight")).alias("target"))


def mix(docs: DataFrame, ratio: float = 1.5, weights: Sequence[int] = (3, 1, 2), max_epochs: int = 2) -> DataFrame:
    """uid (``common.row_ids`` of ``docs``), doc_id, size, source_size, target, taken of every document.

    Sums of ranges and of blocks are written, so that each plan has few exchanges; rows are shuffled once."""
    sized = common.write_table(sizes(common.stored(docs)), "mix-sizes")
    ranges = -(-sized.count() // RANGE_ROWS)
    at = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32)) * F.lit(float(max(1, ranges)))).cast("long")
    dealt = sized.withColumn("range", at)
    upto, none = (Window.unboundedPreceding, -1), F.lit(0).cast("long")

    def before(value: str, keys: list[str], *order: str) -> Column:
        return F.coalesce(F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*upto)), none)

    sums = dealt.groupBy("source", "src", "range").agg(F.sum("size").alias("size")).withColumn("block", F.floor(F.col("range") / BLOCK_RANGES))
    sums = common.write_table(sums, "mix-ranges")
    blocks = common.write_table(sums.groupBy("source", "src", "block").agg(F.sum("size").alias("size")), "mix-blocks")
    b = blocks.select("src", "block", before("size", ["src"], "block").alias("to_block")).join(budgets(blocks, ratio, weights, max_epochs), "src")
    starts = sums.select("src", "block", "range", before("size", ["src", "block"], "range").alias("in_block")).join(b, ["src", "block"])
    starts = common.write_table(starts.select("src", "range", (F.col("to_block") + F.col("in_block")).alias("to_range"), "source_size", "target"), "mix-starts")
    out = dealt.withColumn("in_range", before("size", ["src", "range"], "key", "size")).join(starts, ["src", "range"])
    budget = F.floor(F.col("target") + 0.5)
    first = F.col("to_range") + F.col("in_range")
    taken = sum((F.greatest(none, F.least(F.col("size"), budget - F.col("source_size") * e - first)) for e in range(max_epochs)), none)
    return out.select("uid", "doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.documents(spark, sf_dir)).drop("uid")


ORACLE = r"""
WITH d AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
           md5(coalesce(CAST(doc_id AS VARCHAR), '') || '#' || coalesce(text, '')) AS key
    FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source),
w AS (SELECT source, source_size, CASE (n - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS cap, n FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY CAST(cap AS DOUBLE) / weight, n) AS rank FROM w),
u AS (
    SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM w)
               - coalesce(sum(cap) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS unit
    FROM r),
f AS (SELECT unit FROM u WHERE CAST(cap AS DOUBLE) / weight >= unit ORDER BY rank LIMIT 1),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), (SELECT unit FROM f) * weight) AS target FROM u),
p AS (
    SELECT doc_id, source, size,
           coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c
    FROM d)
SELECT p.doc_id, p.size, t.source_size, CAST(t.target AS DOUBLE) AS target,
       CAST(greatest(0, least(p.size, floor(t.target + 0.5) - p.c))
            + greatest(0, least(p.size, floor(t.target + 0.5) - t.source_size - p.c)) AS BIGINT) AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
"""
