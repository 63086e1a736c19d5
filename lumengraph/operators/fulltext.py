"""Full-text search: tokens, postings, BM25, and its fusion with vector search."""

from __future__ import annotations

from collections.abc import Sequence

import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumengraph.sources.scratch import materialized

K1, B = 1.2, 0.75
#: Folders of postings, and tasks that share one while it is written.
BUCKETS, SHARES = 32, 4


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits of any script."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda t: t != "")


def words(query: str) -> list[str]:
    """The terms of a query, as ``tokens`` cuts them."""
    return list(dict.fromkeys(t for t in regex.split(r"[^\p{L}\p{N}]+", query.lower()) if t))


def postings(docs: DataFrame, key: str = "doc_id", text: str = "full_text") -> DataFrame:
    """(term, key, tf, length): the inverted index."""
    d = docs.select(key, tokens(F.col(text)).alias("t")).select(key, F.size("t").alias("length"), F.explode("t").alias("term"))
    return d.groupBy("term", key, "length").agg(F.count("*").alias("tf"))


def _uses(term: str) -> Column:
    return F.size(F.filter("t", lambda x: x == term))


def _idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def _gain(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def bm25(docs: DataFrame, terms: Sequence[str], key: str = "doc_id", text: str = "full_text") -> DataFrame:
    """(key, bm25) of documents with any of the terms, without an index: one pass over the texts, of which each document's length
    and counts of the terms are written."""
    terms = list(dict.fromkeys(t.lower() for t in terms))
    if not terms:
        return docs.select(key, F.lit(0.0).alias("bm25")).limit(0)
    d = docs.select(key, tokens(F.col(text)).alias("t"))
    d = materialized(d.select(key, F.size("t").alias("length"), *(_uses(w).alias(f"tf{i}") for i, w in enumerate(terms))))
    stats = d.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))

    def part(i: int) -> Column:
        tf = F.col(f"tf{i}")
        return F.when(tf > 0, _idf(F.col("n"), F.col(f"df{i}")) * _gain(tf, F.col("length"), F.col("mean"))).otherwise(0.0)

    hit = F.greatest(*(F.col(f"tf{i}") for i in range(len(terms))), F.lit(0)) > 0
    score = sum((part(i) for i in range(1, len(terms))), part(0))
    return d.filter(hit).join(F.broadcast(stats)).select(key, score.alias("bm25"))  # stats: one row


class Index:
    """Postings in folders of term hashes, sorted by term, and the documents' number and mean length: a query reads the row groups
    of its terms only."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    @classmethod
    def build(cls, docs: DataFrame, path: str, key: str = "doc_id", text: str = "full_text", buckets: int = BUCKETS) -> Index:
        out = cls(docs.sparkSession, path, key)
        bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
        rows = postings(docs, key, text).withColumn("bucket", bucket)
        rows = rows.repartition("bucket", F.pmod(F.xxhash64(key), F.lit(SHARES))).sortWithinPartitions("bucket", "term")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{out.path}/postings")
        sizes = docs.agg(F.count("*").alias("n"), F.avg(F.size(tokens(F.col(text)))).alias("mean"), F.lit(buckets).alias("buckets"))
        sizes.write.mode("overwrite").parquet(f"{out.path}/sizes")
        return out

    def rows(self, terms: Sequence[str]) -> DataFrame:
        """Postings of the terms."""
        terms = list(dict.fromkeys(t.lower() for t in terms))
        count = self.spark.read.parquet(f"{self.path}/sizes").first().buckets
        places = self.spark.range(1).select(F.explode(F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")).alias("t"))
        at = [r.b for r in places.select(F.pmod(F.xxhash64("t"), F.lit(count)).alias("b")).distinct().collect()]  # as many as terms
        return self.spark.read.parquet(f"{self.path}/postings").filter(F.col("bucket").isin(at) & F.col("term").isin(terms))

    def bm25(self, terms: Sequence[str]) -> DataFrame:
        """(key, bm25) of documents with any of the terms."""
        hits = self.rows(terms)
        df = hits.groupBy("term").agg(F.count("*").alias("df"))
        sizes = self.spark.read.parquet(f"{self.path}/sizes").select("n", "mean")
        part = _idf(F.col("n"), F.col("df")) * _gain(F.col("tf"), F.col("length"), F.col("mean"))
        # a row for each term, and one row
        return hits.join(F.broadcast(df), "term").join(F.broadcast(sizes)).groupBy(self.key).agg(F.sum(part).alias("bm25"))


def ranked(found: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """The best ``limit``, with rank_score 1 - (rank - 1) / limit."""
    top = found.orderBy(F.round("bm25", 9).desc(), key).limit(limit)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.round("bm25", 9).desc(), key))
    return top.withColumn("rank_score", 1 - (rank - 1) / F.lit(limit))


def minmax(value: Column, over: Window) -> Column:
    """0 to 1 over the window; 1 where all values are equal."""
    low, high = F.min(value).over(over), F.max(value).over(over)
    return F.when(high == low, F.lit(1.0)).otherwise((value - low) / (high - low))


def fuse(near: DataFrame, found: DataFrame, limit: int, key: str = "doc_id", weight: float = 0.6, dedup: str = "best") -> DataFrame:
    """(key, score) of vector hits (key, distance) and full-text hits (key, rank_score): each key's best hit (or, for dedup "last", its worst), both sides scaled
    to 0..1, ``weight`` for nearness. Both sides are as many as was asked for. A side without rows leaves the other's scores as they are."""
    every = Window.partitionBy(F.lit(0))
    a = near.groupBy(key).agg((F.min if dedup == "best" else F.max)("distance").alias("distance")).withColumn("near", 1 - minmax(F.col("distance"), every))
    a = a.withColumn("near", F.when(F.max("distance").over(every) == F.min("distance").over(every), F.lit(1.0)).otherwise(F.col("near")))
    b = found.withColumn("text", minmax(F.col("rank_score"), every))
    both = a.join(b, key, "full_outer")
    n = both.withColumn("a", F.count("distance").over(every)).withColumn("b", F.count("rank_score").over(every))
    fused = weight * F.coalesce("near", F.lit(0.0)) + (1 - weight) * F.coalesce("text", F.lit(0.0))
    score = F.when(F.col("b") == 0, F.col("distance")).when(F.col("a") == 0, F.col("rank_score")).otherwise(fused)
    # distances, of vector hits alone, are better the lower they are
    order = F.when(F.col("b") == 0, F.round(score, 9)).otherwise(-F.round(score, 9))
    return n.select(key, score.alias("score"), order.alias("order")).orderBy("order", key).limit(limit).drop("order")
