"""Operator 8, document fingerprints: bottom-k sketches of shingle hashes.

A text's words are its lower-case runs without ASCII white space; its shingles are five successive words (a text with
fewer has its whole sequence as one); its sketch holds the ``k`` smallest distinct 64-bit shingle hashes in ascending
order. Sketches of parts merge into the sketch of the whole; two sketches estimate resemblance, containment and the
number of distinct shingles.

The query pairs each document with the next by id: documents are dealt into ranges of (id, place in the files) by sampled
splitters, the first document of each range is also sent to the range before it (the very first to the last), and each
range looks one row ahead. One shuffle of the texts; what the driver holds is some numbers for each shuffle partition.
As places split equal ids too, no id makes a range larger than others.

Null texts count as empty, with an empty sketch; two empty sketches have likeness 1, an empty and another 0; a null id
sorts last; rows with equal ids follow one another by their place in the files; further columns are ignored; an empty
table gives an empty result. Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumengraph.llm import common

K, WORDS = 128, 5
#: Ranges for each shuffle partition, and rows that are sampled for each range.
RANGES, SAMPLED = 4, 50
_LAST = (1 << 63) - 1


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where it is used inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Distinct shingle hashes of a text, ascending."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(common.SPACE), F.lit(0))

    def shingles(h: Column) -> Column:
        n = F.size(h) - (words - 1)
        rolled = F.transform(F.slice(h, 1, F.greatest(n, F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(h, i + j) for j in range(1, words))))
        whole = F.array(F.aggregate(h, F.lit(42).cast("long"), lambda a, x: F.xxhash64(a, x)))
        return F.when(F.size(h) == 0, F.array().cast("array<long>")).when(n < 1, whole).otherwise(rolled)

    return F.sort_array(F.array_distinct(_let(F.transform(found, lambda x: F.xxhash64(x)), shingles)))


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """The text's ``k`` smallest shingle hashes."""
    return F.slice(shingle_hashes(text, words), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both parts together (shingles across the seam aside)."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity."""
    both = _let(merge(a, b, k), lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too."""
    n = _let(merge(a, b, k), lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(F.array_intersect(u, a)))
    return F.when(F.size(a) == 0, F.lit(1.0)).when(F.size(b) == 0, F.lit(0.0)).otherwise(F.coalesce(n, F.lit(0.0)))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    share = (F.element_at(a, -1).cast("double") + float(1 << 63)) / float(1 << 64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def as_text(a: Column) -> Column:
    """A sketch as hexadecimal digits, 16 for each hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def with_next(d: DataFrame, carried: list[str], ranges: int, made: dict[str, Column] | None = None) -> DataFrame:
    """Adds the columns ``made``, and next_<column> of the row that follows by (at, uid), which are distinct; the first row's for the
    last. What is made is made once for each row, after the rows that are sent twice were found."""
    firsts, made = _firsts(d, ranges), made or {}
    if not firsts:
        d = d.withColumns(made)
        return d.select("*", *(F.lit(None).cast(d.schema[c].dataType).alias(f"next_{c}") for c in carried))
    n, spark, kind = len(firsts), d.sparkSession, "struct<at:bigint,uid:bigint>"
    # two levels, so that a row passes few of them though there are many
    step = max(1, int(n**0.5))
    levels = spark.createDataFrame([(firsts[::step], [firsts[i : i + step] for i in range(0, n, step)])], f"tops array<{kind}>, groups array<array<{kind}>>")

    def upto(values: Column) -> Column:
        return F.size(F.filter(values, lambda s: s <= F.struct("at", "uid")))

    top = upto(F.col("tops")) - 1
    rows = d.join(F.broadcast(levels)).withColumn("range", top * step + upto(F.get("groups", top)) - 1).drop("tops", "groups")  # levels: one row
    before = spark.createDataFrame([(at, uid, (i - 1) % n) for i, (at, uid) in enumerate(firsts)], "at long, uid long, range int")
    ahead = d.join(F.broadcast(before), ["at", "uid"]).select(*d.columns, "range")  # a row for each range
    rows = rows.withColumn("halo", F.lit(False)).unionByName(ahead.withColumn("halo", F.lit(True))).withColumns(made)
    w = Window.partitionBy("range").orderBy("halo", "at", "uid")
    return rows.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in carried)).filter(~F.col("halo")).drop("halo", "range")


def _firsts(d: DataFrame, ranges: int) -> list[tuple[int, int]]:
    """The first row of each range: the least (at, uid), and sampled ones, ascending; none of an empty table."""
    keys = d.select("at", "uid")
    every = max(1, keys.count() // (SAMPLED * ranges))
    drawn = keys.filter(F.pmod(F.xxhash64("uid"), F.lit(every)) == 0).toArrow().sort_by([("at", "ascending"), ("uid", "ascending")])  # so many for each range
    least = keys.agg(F.min(F.struct("at", "uid")).alias("r")).first().r
    cuts = zip(*(drawn.column(c).to_numpy()[SAMPLED::SAMPLED].tolist() for c in ("at", "uid")), strict=True)
    return [] if least is None else sorted({(least.at, least.uid), *cuts})


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, fingerprint of each document (``as_text`` of its sketch)."""
    return docs.select("doc_id", as_text(sketch(F.col("text"), k)).alias("fingerprint"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.stored(common.documents(spark, sf_dir))
    at = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("at")
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), at, common.row_ids(docs).alias("uid"))
    d = with_next(d, ["text", "sketch"], RANGES * common.shuffle_partitions(spark), {"sketch": sketch(F.col("text"))})
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    d = d.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    d = d.withColumn("edited_sketch", sketch(F.col("edited")))
    return d.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        distinct_count(F.col("sketch")).alias("n_shingles_estimate"),
    )
