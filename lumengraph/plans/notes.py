"""Browsing, tags, full text, hybrid search and listings over the ``notes`` view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengraph.operators import fulltext, predicates, search, vectors
from lumengraph.plans.catalog import query
from lumengraph.sources import scratch, vault, views
from lumengraph.sources.tables import table

_N = f"n AS ({views.NOTES_SQL})"
_SHOWN = "source_file, title, last_modified"
_LOW, _HIGH = 1704500000.0, 1705500000.0


@query("browse_range", f"WITH {_N} SELECT {_SHOWN} FROM n WHERE last_modified BETWEEN {_LOW} AND {_HIGH} ORDER BY last_modified, source_file LIMIT 50")
def browse_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.notes(spark, sf_dir).filter(predicates.modified_between(F.col("last_modified"), _LOW, _HIGH))
    return n.orderBy("last_modified", "source_file").limit(50).select("source_file", "title", "last_modified")


@query("browse_folder", f"WITH {_N} SELECT {_SHOWN} FROM n WHERE starts_with(source_file, 'src1/de/') AND strpos(substr(source_file, 9), '/') = 0")
def browse_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.notes(spark, sf_dir).filter(predicates.in_folder(F.col("source_file"), "src1/de", recursive=False)).select("source_file", "title", "last_modified")


@query("browse_tags", f"WITH {_N} SELECT {_SHOWN} FROM n WHERE list_contains(tags, 'de') AND list_contains(tags, 'quality')")
def browse_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.notes(spark, sf_dir).filter(predicates.has_tags(F.col("tags"), ["#DE", "Quality"])).select("source_file", "title", "last_modified")


_TAGS = "SELECT unnest(tags) AS tag, source_file FROM n"


@query("list_tags_counts", f"WITH {_N} SELECT tag, count(*) AS files FROM ({_TAGS}) GROUP BY tag")
def list_tags_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.notes(spark, sf_dir).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "tag")


@query("list_tags_full", f"WITH {_N}, t AS (SELECT * FROM ({_TAGS}) WHERE starts_with(source_file, 'src2/')) SELECT tag, files, source_file FROM t JOIN (SELECT tag, count(*) AS files FROM t GROUP BY tag) USING (tag)")
def list_tags_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each file of a tag, so that a common tag's files needn't meet."""
    t = views.notes(spark, sf_dir).filter(predicates.in_folder(F.col("source_file"), "src2")).select(F.explode("tags").alias("tag"), "source_file")
    return t.join(t.groupBy("tag").agg(F.count("*").alias("files")), "tag").select("tag", "files", "source_file")


@query("list_tags_nonrecursive", f"WITH {_N} SELECT tag, count(*) AS files FROM ({_TAGS}) WHERE starts_with(source_file, 'src2/fr/') AND strpos(substr(source_file, 9), '/') = 0 GROUP BY tag")
def list_tags_nonrecursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.notes(spark, sf_dir).filter(predicates.in_folder(F.col("source_file"), "src2/fr", recursive=False))
    return n.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("files"))


_TOKENS = "list_filter(regexp_split_to_array(lower(full_text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
_TERMS = ["tion", "nicht", "est"]
_BM25 = f"""
    {_N}, t AS (SELECT doc_id, {_TOKENS} AS t FROM n),
    f AS (SELECT doc_id, len(t) AS l, {", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(_TERMS))} FROM t),
    st AS (SELECT count(*) AS n, avg(l) AS mean, {", ".join(f"sum(CASE WHEN tf{i} > 0 THEN 1 ELSE 0 END) AS df{i}" for i in range(3))} FROM f),
    bm AS (SELECT doc_id, {" + ".join(f"CASE WHEN tf{i} > 0 THEN ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * l / mean)) ELSE 0 END" for i in range(3))} AS bm25
           FROM f, st WHERE tf0 + tf1 + tf2 > 0),
    top AS (SELECT doc_id, bm25, 1 - (row_number() OVER (ORDER BY round(bm25, 9) DESC, doc_id) - 1) / 20.0::DOUBLE AS rank_score FROM bm ORDER BY round(bm25, 9) DESC, doc_id LIMIT 20)
"""


def _index(spark: SparkSession, sf_dir: str) -> fulltext.Index:
    """The notes' index, built once for a session and folder."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _INDEXES:
        _INDEXES[at] = fulltext.Index.build(views.notes(spark, sf_dir), scratch.folder(spark, "postings"))
    return _INDEXES[at]


_INDEXES: dict[tuple[str, str], fulltext.Index] = {}


@query("fts_bm25", f"WITH {_BM25} SELECT doc_id, round(bm25, 6) AS bm25, round(rank_score, 6) AS rank_score FROM top")
def fts_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fulltext.ranked(_index(spark, sf_dir).bm25(_TERMS), 20)
    return found.select("doc_id", F.round("bm25", 6).alias("bm25"), F.round("rank_score", 6).alias("rank_score"))


@query("fts_bm25_scan", f"WITH {_BM25} SELECT doc_id, round(bm25, 6) AS bm25, round(rank_score, 6) AS rank_score FROM top")
def fts_bm25_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``fts_bm25``, of texts that have no index."""
    found = fulltext.ranked(fulltext.bm25(views.notes(spark, sf_dir), _TERMS), 20)
    return found.select("doc_id", F.round("bm25", 6).alias("bm25"), F.round("rank_score", 6).alias("rank_score"))


@query("fts_snippets")
def fts_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a full-text search shows of its hits: title, the first 500 bytes with links by their text."""
    found = fulltext.ranked(_index(spark, sf_dir).bm25(_TERMS), 20)
    shown = search.snippets(views.notes(spark, sf_dir)).join(F.broadcast(found), "doc_id")  # 20 hits
    return shown.select(F.col("source_file").alias("note_path"), "breadcrumb", "content", F.size("links").alias("links"), F.round("rank_score", 6).alias("score"))


@query(
    "fts_postings",
    f"WITH {_N} SELECT term, count(*) AS docs, CAST(sum(tf) AS BIGINT) AS uses FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM n) GROUP BY doc_id, term) GROUP BY term",
)
def fts_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.postings(views.notes(spark, sf_dir)).groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("uses"))


@query(
    "hybrid_fusion",
    f"""
    WITH {_BM25}, c AS ({views.CHUNKS_SQL}), q AS (SELECT vector AS v FROM c WHERE vec_id = 0),
    near AS (SELECT note_id AS doc_id, list_sum(list_transform(list_zip(c.vector, q.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS distance, vec_id FROM c, q ORDER BY 2, vec_id LIMIT 20),
    a AS (SELECT doc_id, min(distance) AS distance FROM near GROUP BY doc_id),
    av AS (SELECT doc_id, CASE WHEN (max(distance) OVER ()) = (min(distance) OVER ()) THEN 1.0 ELSE 1 - (distance - min(distance) OVER ()) / (max(distance) OVER () - min(distance) OVER ()) END AS near FROM a),
    bv AS (SELECT doc_id, (rank_score - min(rank_score) OVER ()) / (max(rank_score) OVER () - min(rank_score) OVER ()) AS text FROM top),
    s AS (SELECT coalesce(av.doc_id, bv.doc_id) AS doc_id, 0.6 * coalesce(near, 0) + 0.4 * coalesce(text, 0) AS score FROM av FULL JOIN bv ON av.doc_id = bv.doc_id)
    SELECT doc_id, round(score, 6) AS score FROM s ORDER BY round(s.score, 9) DESC, doc_id LIMIT 10
    """,
)
def hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.chunks(spark, sf_dir)
    v = c.filter("vec_id = 0").first().vector
    near = vectors.topk(c, vectors.literal(v), 20).select(F.col("note_id").alias("doc_id"), "distance")
    found = fulltext.ranked(_index(spark, sf_dir).bm25(_TERMS), 20)
    return fulltext.fuse(near, found, 10).select("doc_id", F.round("score", 6).alias("score"))


@query(
    "search_filtered",
    f"""
    WITH {_N}, c AS ({views.CHUNKS_SQL}), q AS (SELECT vector AS v FROM c WHERE vec_id = 0)
    SELECT n.source_file, c.chunk_index, round(list_sum(list_transform(list_zip(c.vector, q.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 6) AS dist
    FROM c JOIN n ON c.note_id = n.doc_id, q WHERE list_contains(n.tags, 'en') ORDER BY 3, c.vec_id LIMIT 15
    """,
)
def search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters come before the ranking, so that as many hits return as there are."""
    c = views.chunks(spark, sf_dir)
    v = c.filter("vec_id = 0").first().vector
    n = views.notes(spark, sf_dir).filter(predicates.has_tags(F.col("tags"), ["en"])).select(F.col("doc_id").alias("note_id"), "source_file")
    return vectors.topk(c.join(n, "note_id"), vectors.literal(v), 15).select("source_file", "chunk_index", F.round("distance", 6).alias("dist"))


@query(
    "documents_page",
    f"""
    WITH {_N}, k AS (SELECT vec_id // 4 AS doc_id, count(*) AS chunks FROM embeddings GROUP BY 1)
    SELECT source_file, title, last_modified, coalesce(chunks, 0) AS chunks FROM n LEFT JOIN k USING (doc_id)
    WHERE strpos(lower(title), 'an') > 0 AND list_contains(tags, 'en') ORDER BY last_modified DESC, source_file LIMIT 20 OFFSET 20
    """,
)
def documents_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.notes(spark, sf_dir).filter(F.contains(F.lower("title"), F.lit("an")) & F.array_contains("tags", "en"))
    page = n.orderBy(F.desc("last_modified"), "source_file").offset(20).limit(20)
    k = views.chunks(spark, sf_dir).groupBy(F.col("note_id").alias("doc_id")).agg(F.count("*").alias("chunks"))
    return page.join(k, "doc_id", "left").select("source_file", "title", "last_modified", F.coalesce("chunks", F.lit(0).cast("long")).alias("chunks"))


@query("documents_total", f"WITH {_N} SELECT count(*) AS total FROM n WHERE strpos(lower(title), 'an') > 0 AND list_contains(tags, 'en')")
def documents_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents the pages of ``documents_page`` have."""
    return views.notes(spark, sf_dir).filter(F.contains(F.lower("title"), F.lit("an")) & F.array_contains("tags", "en")).agg(F.count("*").alias("total"))


@query("list_tags_names", f"WITH {_N} SELECT DISTINCT tag FROM ({_TAGS})")
def list_tags_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.notes(spark, sf_dir).select(F.explode("tags").alias("tag")).distinct().orderBy("tag")


@query("note_chunks", f"WITH c AS ({views.CHUNKS_SQL}) SELECT note_path, chunk_index, vec_id, 'part ' || CAST(chunk_index AS VARCHAR) || ' of ' || note_path AS content, CAST(len(vector) AS BIGINT) AS size FROM c WHERE note_path = 'f2/n7.md'")
def note_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note's chunks in order, with what they hold."""
    c = views.chunks(spark, sf_dir).filter("note_path = 'f2/n7.md'").orderBy("chunk_index")
    content = F.concat(F.lit("part "), F.col("chunk_index").cast("string"), F.lit(" of "), "note_path")
    return c.select("note_path", "chunk_index", "vec_id", content.alias("content"), F.size("vector").cast("long").alias("size"))


@query("document_detail", f"WITH {_N}, c AS ({views.CHUNKS_SQL}) SELECT source_file, c.chunk_index, length(full_text) AS char_count, strlen(full_text) AS byte_count FROM n JOIN c ON n.doc_id = c.note_id WHERE doc_id = 3")
def document_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.notes(spark, sf_dir).filter("doc_id = 3")
    c = views.chunks(spark, sf_dir).filter("note_id = 3").select(F.col("note_id").alias("doc_id"), "chunk_index")
    return n.join(c, "doc_id").select("source_file", "chunk_index", F.length("full_text").cast("long").alias("char_count"), F.octet_length("full_text").cast("long").alias("byte_count"))


_WANTED = ["src0/en/0.md", "1", "nowhere", "7.md", "SRC3\\\\EN\\\\3"]


@query(
    "examine_batch",
    f"""
    WITH {_N}, w(position, path) AS (VALUES {", ".join(f"({i}, '{p.replace(chr(92) * 2, chr(92))}')" for i, p in enumerate(_WANTED))}),
    m AS (SELECT position, source_file FROM w, (SELECT source_file, lower(source_file) AS p FROM n), LATERAL (SELECT lower(replace(w.path, chr(92), '/')) AS q)
          WHERE p = q OR p = q || '.md' OR ends_with(p, '/' || q) OR ends_with(p, '/' || q || '.md'))
    SELECT w.position, count(source_file) AS matches, CASE count(source_file) WHEN 0 THEN 'not found' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS status,
           coalesce(min(source_file), '') AS first_match
    FROM w LEFT JOIN m USING (position) GROUP BY w.position
    """,
)
def examine_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([(i, p.replace("\\\\", "\\")) for i, p in enumerate(_WANTED)], "position int, path string")
    hits = search.path_matches(wanted, views.notes(spark, sf_dir))
    out = wanted.join(hits, "position", "left").groupBy("position").agg(F.count("source_file").alias("matches"), F.coalesce(F.min("source_file"), F.lit("")).alias("first_match"))
    status = F.when(F.col("matches") == 0, "not found").when(F.col("matches") == 1, "found").otherwise("ambiguous")
    return out.select("position", "matches", status.alias("status"), "first_match")


@query(
    "link_resolve",
    f"""WITH {_N}, f AS (SELECT source_file FROM n UNION ALL SELECT 'old/' || source_file FROM n WHERE doc_id % 3 = 0 UNION ALL SELECT 'a/' || source_file FROM n WHERE doc_id % 5 = 0 UNION ALL SELECT 'b/' || source_file FROM n WHERE doc_id % 5 = 0 AND doc_id % 3 <> 0)
    SELECT stem, source_file AS path FROM (SELECT regexp_extract(source_file, '([^/]+)[.]md$', 1) AS stem, source_file, row_number() OVER (PARTITION BY regexp_extract(source_file, '([^/]+)[.]md$', 1) ORDER BY strlen(source_file), source_file) AS r FROM f) WHERE r = 1""",
)
def link_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a link to each stem means, where some notes have copies in other folders."""
    n = views.notes(spark, sf_dir).select("source_file", "doc_id")
    copies = [("old/", "doc_id % 3 = 0"), ("a/", "doc_id % 5 = 0"), ("b/", "doc_id % 5 = 0 AND doc_id % 3 <> 0")]
    every = n.select("source_file")
    for folder, which in copies:
        every = every.union(n.filter(which).select(F.concat(F.lit(folder), "source_file")))
    return vault.by_stem(every, "source_file").select("stem", F.col("dst").alias("path"))


@query(
    "tree_counts",
    """
    WITH p AS (SELECT DISTINCT url, string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]+/?', ''), '/') AS s FROM pages),
    f AS (SELECT url, len(s) - 1 AS depth, unnest(range(0, len(s))) AS d, s FROM p)
    SELECT array_to_string(s[1:d], '/') AS folder, CAST(sum(CASE WHEN d = depth THEN 1 ELSE 0 END) AS BIGINT) AS notes, count(*) AS total FROM f GROUP BY 1
    """,
)
def tree_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own and total notes of each folder: every note counts for all folders above it."""
    bare = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://[^/]+/?", "")
    p = table(spark, sf_dir, "pages").select("url").distinct().select(F.split(bare, "/").alias("s"))
    f = p.select("s", F.explode(F.sequence(F.lit(0), F.size("s") - 1)).alias("d"))
    f = f.select(F.array_join(F.slice("s", F.lit(1), F.col("d")), "/").alias("folder"), (F.col("d") == F.size("s") - 1).cast("long").alias("own"))
    return f.groupBy("folder").agg(F.sum("own").alias("notes"), F.count("*").alias("total"))
