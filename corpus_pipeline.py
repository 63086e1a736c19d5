"""A training corpus from ``documents``: five stages, each written as Parquet and read again by the next.

toxicity: documents that the classifier rejects go. jaccard_join: of each group of near copies the document of least id
stays. suffix_dedup: passages of over 50 words, or of 400 bytes, that repeat are cut out of texts. mixing: each document comes as often as the mix
of sources takes of it, none, once or twice; the one at a source's budget is kept whole. sentencepieces: token ids.

Decisions are joined to the texts by sort and merge at every size: a plan that broadcasts them where they are few moves no text
there, and would hide what larger tables move.

A stage gets the rows that its predecessor kept. Rows are told apart by their place in the table, so that null and repeated
ids are carried; further columns are kept up to the last stage; an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengraph.llm import common, jaccard_join, mixing, sentencepieces, suffix_dedup, toxicity

_LAST = (1 << 63) - 1
#: Repeated passages of more words are cut; at one byte a word and one between, they have 2 * WORDS + 1 bytes at least.
WORDS = 50


def _free(docs: DataFrame, *names: str) -> list[str]:
    """Names of new columns that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    return [next(n for n in (f"_{name}{'_' * i}" for i in range(len(taken) + 1)) if n not in taken) for name in names]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    model = toxicity.fit(docs, common.documents(spark, sf_dir, "labels"))
    score, toxic = _free(docs, "score", "toxic")
    return toxicity.score(docs, model, out=(score, toxic)).filter(F.col(toxic) == 0).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    docs, (uid,) = common.stored(docs), _free(docs, "uid")
    found = jaccard_join.linked(docs)
    first = found.groupBy("component").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("id"), "uid")).alias("first"))
    kept = common.write_table(first.select(F.col("first.uid").alias(uid)), "kept")
    return docs.withColumn(uid, common.row_ids(docs)).join(kept.hint("merge"), uid, "left_semi").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    docs, (uid, kept) = common.stored(docs), _free(docs, "uid", "kept")
    found = suffix_dedup.dedup(docs, texts=True, length=2 * WORDS + 1, words=WORDS).filter("kept IS NOT NULL").select(F.col("uid").alias(uid), F.col("kept").cast("string").alias(kept))
    found = common.write_table(found, "kept-texts", compression="zstd")
    out = docs.withColumn(uid, common.row_ids(docs)).join(found.hint("merge"), uid, "left").withColumn("text", F.coalesce(kept, "text"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    docs, (uid, copies) = common.stored(docs), _free(docs, "uid", "copies")
    taken = mixing.mix(docs).filter("taken > 0").select(F.col("uid").alias(uid), F.ceil(F.col("taken") / F.col("size")).cast("int").alias(copies))
    taken = common.write_table(taken, "taken")
    every = F.explode(F.sequence(F.lit(1), F.col(copies))).alias(uid)
    return docs.withColumn(uid, common.row_ids(docs)).join(taken.hint("merge"), uid).select(*docs.columns, every).select(*docs.columns)


def to_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    out = sentencepieces.encode(docs, sentencepieces.model_path())
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("sentencepieces", to_token_ids),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.write_table(stage(spark, docs, sf_dir), f"pipeline-{name}", compression="zstd")
    return docs
