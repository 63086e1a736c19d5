"""Trees of links, reports on similar notes and bridges, the graph as a stored table, pooled vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengraph.functions import embedding
from lumengraph.operators import graph, numbering, predicates, search, similar, vectors
from lumengraph.operators.filters import Filters, Request
from lumengraph.plans.catalog import query
from lumengraph.plans.notes import _BM25, _index
from lumengraph.plans.vectors import _DEGREE, _DOT, _KNN, _L2, _bridges_sql, _similar_sql, _vector
from lumengraph.sources import scratch, views

#: The note that trees start at.
_ROOT = 2
_NEXT = f"""{_DEGREE}, w AS (SELECT src AS node, dst AS neighbour, 'out' AS way FROM links UNION ALL SELECT dst, src, 'in' FROM links),
    g AS (SELECT node, neighbour, CASE WHEN min(way) = max(way) THEN min(way) ELSE 'both' END AS directions FROM w GROUP BY node, neighbour),
    ne AS (SELECT g.node AS above, neighbour AS node, directions, degree, row_number() OVER (PARTITION BY g.node ORDER BY degree DESC, neighbour) AS place FROM g JOIN deg ON g.neighbour = deg.node)"""


def _tree_sql(depth: int, limit: int, where: str = "true") -> str:
    return f"""
    WITH RECURSIVE {_NEXT},
    t AS (SELECT '' AS key, CAST({_ROOT} AS BIGINT) AS node, 0 AS depth, CAST(NULL AS BIGINT) AS parent, [CAST({_ROOT} AS BIGINT)] AS line, CAST(NULL AS VARCHAR) AS directions, false AS cycle
          UNION ALL SELECT t.key || lpad(CAST(place AS VARCHAR), 9, '0'), e.node, t.depth + 1, t.node, list_append(t.line, e.node), e.directions, list_contains(t.line, e.node)
          FROM t JOIN ne AS e ON e.above = t.node WHERE NOT t.cycle AND t.depth < {depth} AND {where})
    SELECT CAST(row_number() OVER (ORDER BY depth, key) AS INTEGER) AS rank, t.node, depth, coalesce(parent, -1) AS parent, coalesce(deg.degree, 0) AS degree, coalesce(directions, '') AS directions, cycle
    FROM t LEFT JOIN deg ON t.node = deg.node ORDER BY depth, key LIMIT {limit}
    """


def _tree(found: DataFrame) -> DataFrame:
    return found.select("rank", "node", "depth", F.coalesce("parent", F.lit(-1).cast("long")).alias("parent"), "degree", F.coalesce("directions", F.lit("")).alias("directions"), "cycle")


@query("explore_cycles", _tree_sql(9, 100_000))
def explore_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All paths of nine links from one note; a note that a path comes back to is shown as a cycle."""
    return _tree(graph.explore_tree(views.links(spark, sf_dir), _ROOT, 9, dedup=False))


@query("explore_limited", _tree_sql(8, 5))
def explore_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(graph.explore_tree(views.links(spark, sf_dir), _ROOT, 8, 5, dedup=False))


@query("explore_traverse", _tree_sql(9, 100_000, "e.node % 21 <> 0"))
def explore_traverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only notes that a filter lets through are passed."""
    fits = views.chunks(spark, sf_dir).select(F.col("note_id").alias("node")).filter("node % 21 <> 0")
    return _tree(graph.explore_tree(views.links(spark, sf_dir), _ROOT, 9, dedup=False, matching=fits, traverse=True))


@query(
    "explore_context",
    f"""
    WITH RECURSIVE {_NEXT}, s AS (SELECT src, dst, 'Part ' || CAST(dst % 4 AS VARCHAR) AS section FROM links WHERE dst % 4 > 0),
    t AS (SELECT '' AS key, CAST({_ROOT} AS BIGINT) AS node, 0 AS depth, [CAST({_ROOT} AS BIGINT)] AS line, CAST(NULL AS BIGINT) AS src, CAST(NULL AS BIGINT) AS dst, false AS cycle
          UNION ALL SELECT t.key || lpad(CAST(place AS VARCHAR), 9, '0'), e.node, t.depth + 1, list_append(t.line, e.node), CASE WHEN e.directions = 'in' THEN e.node ELSE t.node END, CASE WHEN e.directions = 'in' THEN t.node ELSE e.node END, list_contains(t.line, e.node)
          FROM t JOIN ne AS e ON e.above = t.node WHERE NOT t.cycle AND t.depth < 7)
    SELECT CAST(row_number() OVER (ORDER BY depth, key) AS INTEGER) AS rank, CAST(node AS VARCHAR) AS node, coalesce(section, '') AS section FROM t LEFT JOIN s ON t.src = s.src AND t.dst = s.dst
    """,
)
def explore_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the section in which each link stands."""
    links = views.links(spark, sf_dir)
    c = links.select(F.col("src").cast("string").alias("note_path"), (F.col("dst") % 4).alias("chunk_index"), F.col("dst").cast("string").alias("dst"))
    c = c.groupBy("note_path", "chunk_index").agg(F.collect_set("dst").alias("targets"))
    crumb = F.when(F.col("chunk_index") == 0, F.col("note_path")).otherwise(F.concat("note_path", F.lit(" > Top > Part "), F.col("chunk_index").cast("string")))
    sections = graph.link_sections(c.withColumn("breadcrumb", crumb)).select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "section")
    found = graph.explore_tree(links, _ROOT, 7, dedup=False, sections=sections)
    return found.select("rank", F.col("node").cast("string").alias("node"), F.coalesce("section", F.lit("")).alias("section"))


@query("known_links", f"WITH links AS ({views.LINKS_SQL}), l AS (SELECT * FROM links WHERE src % 5 <> 0 AND dst % 5 <> 0), e AS (SELECT src, dst FROM l UNION SELECT dst, src FROM l) SELECT src AS node, count(*) AS degree FROM e GROUP BY src")
def known_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees where only links between known notes count."""
    known = views.chunks(spark, sf_dir).select(F.col("note_id").alias("node")).filter("node % 5 <> 0").distinct()
    return graph.degrees(views.links(spark, sf_dir), known)


_ALL_SIMILAR = f"""
    WITH c AS ({views.CHUNKS_SQL}), links AS ({views.LINKS_SQL}),
    h AS (SELECT o.note_id, o.note_path, q.chunk_index AS query_index, max(1 / (1 + greatest({_L2.format(a="o.vector", b="q.vector")}, 0))) AS sim
          FROM c o, c q WHERE q.note_id = 2 AND o.note_id <> 2 GROUP BY ALL),
    m AS (SELECT note_id, note_path, max(sim) AS similarity, CAST(1704067200 + (note_id * 7919) % 2592000 AS DOUBLE) AS last_modified FROM h GROUP BY note_id, note_path HAVING max(sim) >= 0.36)
"""


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.notes(spark, sf_dir).select(F.col("doc_id").alias("note_id"), "last_modified", "tags")


@query("find_similar_recent", f"{_ALL_SIMILAR} SELECT note_path, round(similarity, 6) AS similarity, last_modified FROM m ORDER BY m.last_modified DESC, round(m.similarity, 9) DESC, note_path LIMIT 20")
def find_similar_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similar.find_similar(views.chunks(spark, sf_dir), 2, 0.36, documents=_dated(spark, sf_dir))
    return similar.ordered(found, "recent", 20).select("note_path", F.round("similarity", 6).alias("similarity"), "last_modified")


@query("find_similar_path", f"{_ALL_SIMILAR} SELECT note_path, round(similarity, 6) AS similarity FROM m ORDER BY note_path LIMIT 20")
def find_similar_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similar.find_similar(views.chunks(spark, sf_dir), 2, 0.36, documents=_dated(spark, sf_dir))
    return similar.ordered(found, "path", 20).select("note_path", F.round("similarity", 6).alias("similarity"))


@query(
    "find_similar_counts",
    f"""{_ALL_SIMILAR}, x AS (SELECT dst AS note_id FROM links WHERE src = 2 UNION SELECT src FROM links WHERE dst = 2)
    SELECT (SELECT count(*) FROM m WHERE note_id NOT IN (SELECT note_id FROM x)) AS total_found, (SELECT count(*) FROM x WHERE note_id IN (SELECT note_id FROM c) AND note_id <> 2) AS excluded_by_link,
           (SELECT count(*) FROM c WHERE note_id = 2) AS source_chunks, CAST(least(400, least(greatest(16 * (SELECT count(DISTINCT note_id) FROM c), 400), 20000)) AS BIGINT) AS fetch_limit, false AS fetch_truncated""",
)
def find_similar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, out = views.chunks(spark, sf_dir), similar.linked_to(views.links(spark, sf_dir), 2)
    return similar.similar_counts(c, 2, similar.find_similar(c, 2, 0.36, excluded=out), out, 20)


def _with_crumbs(chunks: DataFrame) -> DataFrame:
    part = F.element_at(F.array(*map(F.lit, ("Start", "Text", "More", "Links"))), (F.col("chunk_index") + 1).cast("int"))
    return chunks.withColumn("breadcrumb", F.when(F.col("chunk_index") == 0, F.col("note_path")).otherwise(F.concat("note_path", F.lit(" > Top > "), part)))


@query(
    "find_similar_sections",
    f"""WITH r AS ({_similar_sql("max", 0.38)}), c AS ({views.CHUNKS_SQL})
    SELECT note_path, CASE best_chunk WHEN 0 THEN note_path ELSE ['Text', 'More', 'Links'][best_chunk] END AS target_section FROM r""",
)
def find_similar_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the section of the likest chunk."""
    c = views.chunks(spark, sf_dir)
    found = similar.ordered(similar.find_similar(c, 2, 0.38), "similarity", 20)
    return similar.sections_of(found, _with_crumbs(c), 2).select("note_path", "target_section")


_PAIRS = f"""{_KNN.format(k=8)}, info AS (SELECT vec_id, note_id, note_path, chunk_index FROM c),
    p AS (SELECT i, j, sim, x.note_id AS a, y.note_id AS b, x.note_path AS pa, y.note_path AS pb, x.chunk_index AS ca, y.chunk_index AS cb FROM knn JOIN info x ON knn.i = x.vec_id JOIN info y ON knn.j = y.vec_id
          WHERE i < j AND sim >= 0.25 AND x.note_id <> y.note_id)"""


@query("bridge_counts", f"WITH {_PAIRS} SELECT count(*) AS pairs_scanned, count(DISTINCT least(pa, pb) || ' ' || greatest(pa, pb)) AS note_pairs FROM p")
def bridge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.pair_counts(similar.near_pairs(views.chunks(spark, sf_dir), k=8, min_similarity=0.25))


@query(
    "bridge_pairs",
    f"""WITH {_PAIRS}, n AS ({views.NOTES_SQL}), t AS (SELECT doc_id FROM n WHERE list_contains(tags, 'en')),
    o AS (SELECT least(pa, pb) AS path_a, greatest(pa, pb) AS path_b, sim, CASE WHEN pa < pb THEN ca ELSE cb END AS chunk_a, CASE WHEN pa < pb THEN cb ELSE ca END AS chunk_b,
                 row_number() OVER (PARTITION BY least(pa, pb), greatest(pa, pb) ORDER BY round(sim, 9) DESC, i, j) AS r
          FROM p WHERE a IN (SELECT doc_id FROM t) AND b IN (SELECT doc_id FROM t))
    SELECT path_a, path_b, chunk_a, chunk_b, round(sim, 6) AS sim FROM o WHERE r = 1""",
)
def bridge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likest chunks of each two notes that both have a tag."""
    pairs = similar.near_pairs(views.chunks(spark, sf_dir), k=8, min_similarity=0.25, tags=(_dated(spark, sf_dir), ["en"]))
    return similar.best_pairs(pairs).select("path_a", "path_b", "chunk_a", "chunk_b", F.round("sim", 6).alias("sim"))


@query("bridges_json", f"WITH b AS ({_bridges_sql('sim * log2(coalesce(distance, 9) + 1.0)')}) SELECT CAST(to_json({{'path_a': path_a, 'path_b': path_b, 'distance': distance, 'sim_ppm': CAST(round(sim * 1000000) AS BIGINT)}}) AS VARCHAR) AS json FROM b")
def bridges_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridges as JSON objects, similarities in millionths, as numbers with a fraction are written differently elsewhere."""
    found = similar.bridges(views.chunks(spark, sf_dir), views.links(spark, sf_dir), k=8, min_similarity=0.25)
    ppm = F.round(F.round("sim", 6) * 1000000).cast("long").alias("sim_ppm")
    return similar.as_json(found.select("path_a", "path_b", F.coalesce("distance", F.lit(-1)).alias("distance"), ppm))


@query(
    "graph_rebuild",
    f"""WITH c AS ({views.CHUNKS_SQL}), k AS (SELECT CAST(row_number() OVER (ORDER BY note_path, chunk_index) - 1 AS BIGINT) AS id, CAST(dense_rank() OVER (ORDER BY note_path) - 1 AS BIGINT) AS doc, vector FROM c WHERE chunk_index <> 3),
    s AS (SELECT a.id AS i, b.id AS j, a.doc, {_DOT.format(a="a.vector", b="b.vector")} / sqrt({_DOT.format(a="a.vector", b="a.vector")}) / sqrt({_DOT.format(a="b.vector", b="b.vector")}) AS sim FROM k a, k b WHERE a.id <> b.id),
    r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(sim, 6) DESC, j) AS rank FROM s)
    SELECT i, doc, round(max(sim), 4) AS best FROM r WHERE rank <= 4 GROUP BY i, doc""",
)
def graph_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that aren't boilerplate, in order, as unit vectors; their neighbours, stored and read again."""
    c = _with_crumbs(views.chunks(spark, sf_dir))
    vectors.one_dimension(c)
    c = c.filter(predicates.is_content(F.col("breadcrumb"), ["^Links$"])).withColumn("vector", vectors.normalized(F.col("vector"))).filter("vector IS NOT NULL")
    c = numbering.of_values(numbering.dense(c, ["note_path", "chunk_index"]), "note_path", "doc")
    path = scratch.folder(spark, "graph")
    vectors.save_graph(vectors.knn_graph(c, 4, key="id"), path)
    best = vectors.load_graph(spark, path).groupBy("i").agg(F.max("sim").alias("best"))
    return best.join(c.select(F.col("id").alias("i"), "doc"), "i").select("i", "doc", F.round("best", 4).alias("best"))


@query(
    "pooled_vectors",
    f"""WITH c AS ({views.CHUNKS_SQL}), v AS (SELECT note_id, unnest(range(0, len(vector))) AS place, unnest(vector) AS x FROM c WHERE chunk_index <> 2),
    m AS (SELECT note_id, place, avg(x) AS x FROM v GROUP BY ALL), n AS (SELECT note_id, sqrt(sum(x * x)) AS norm FROM m GROUP BY note_id)
    SELECT m.note_id, CAST(place AS INTEGER) AS place, round(x / norm, 6) AS value FROM m JOIN n USING (note_id)""",
)
def pooled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masked mean of each note's chunk vectors, of length 1."""
    c = views.chunks(spark, sf_dir).groupBy("note_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "vector"))).alias("r"))  # the chunks of a note
    mask = F.transform("r", lambda r: F.when(r["chunk_index"] == 2, 0).otherwise(1))
    out = c.select("note_id", F.posexplode(embedding.pooled(F.col("r.vector"), mask)).alias("place", "value"))
    return out.select("note_id", "place", F.round("value", 6).alias("value"))


_SEARCH = Request("tion nicht est", "hybrid", Filters(tags=("en",)), 10)
_NEAR = f"near AS (SELECT note_id AS doc_id, {_L2.format(a='c.vector', b='q.v')} AS distance, vec_id FROM c, (SELECT vector AS v FROM c WHERE vec_id = 0) q WHERE note_id IN (SELECT doc_id FROM able) ORDER BY 2, vec_id LIMIT {{n}})"
_ABLE = f"c AS ({views.CHUNKS_SQL}), able AS (SELECT doc_id FROM n WHERE list_contains(tags, 'en'))"


def _searched(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    chunks = views.chunks(spark, sf_dir).withColumnRenamed("note_id", "doc_id")
    asked = Request(_SEARCH.query, mode, _SEARCH.filters, _SEARCH.limit)
    return search.run(asked, views.notes(spark, sf_dir), chunks, lambda q: _vector(spark, sf_dir), _index(spark, sf_dir)).select("doc_id", F.round("score", 6).alias("score"))


@query("search_vector", f"WITH {_BM25}, {_ABLE}, {_NEAR.format(n=10)} SELECT doc_id, round(distance, 6) AS score FROM near")
def search_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, "vector")


_FOUND = "found AS (SELECT doc_id, 1 - (row_number() OVER (ORDER BY round(bm25, 9) DESC, doc_id) - 1) / {n}.0::DOUBLE AS rank_score FROM bm WHERE doc_id IN (SELECT doc_id FROM able) ORDER BY round(bm25, 9) DESC, doc_id LIMIT {n})"


@query("search_fts", f"WITH {_BM25}, {_ABLE}, {_FOUND.format(n=10)} SELECT doc_id, round(rank_score, 6) AS score FROM found")
def search_fts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, "fts")


@query(
    "search_hybrid",
    f"""WITH {_BM25}, {_ABLE}, {_NEAR.format(n=20)}, {_FOUND.format(n=20)}, a AS (SELECT doc_id, min(distance) AS distance FROM near GROUP BY doc_id),
    av AS (SELECT doc_id, CASE WHEN (max(distance) OVER ()) = (min(distance) OVER ()) THEN 1.0 ELSE 1 - (distance - min(distance) OVER ()) / (max(distance) OVER () - min(distance) OVER ()) END AS near FROM a),
    bv AS (SELECT doc_id, CASE WHEN (max(rank_score) OVER ()) = (min(rank_score) OVER ()) THEN 1.0 ELSE (rank_score - min(rank_score) OVER ()) / (max(rank_score) OVER () - min(rank_score) OVER ()) END AS text FROM found),
    s AS (SELECT coalesce(av.doc_id, bv.doc_id) AS doc_id, 0.6 * coalesce(near, 0) + 0.4 * coalesce(text, 0) AS score FROM av FULL JOIN bv ON av.doc_id = bv.doc_id)
    SELECT doc_id, round(score, 6) AS score FROM s ORDER BY round(s.score, 9) DESC, doc_id LIMIT 10""",
)
def search_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, "hybrid")


@query("search_empty_side", f"WITH {_BM25}, {_ABLE}, {_NEAR.format(n=20)}, a AS (SELECT doc_id, min(distance) AS distance FROM near GROUP BY doc_id) SELECT doc_id, round(distance, 6) AS score FROM a ORDER BY round(a.distance, 9), doc_id LIMIT 10")
def search_empty_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that no note has: the vector hits stay as they are, nearest first."""
    chunks = views.chunks(spark, sf_dir).withColumnRenamed("note_id", "doc_id")
    asked = Request("zzqqxx", "hybrid", _SEARCH.filters, 10)
    return search.run(asked, views.notes(spark, sf_dir), chunks, lambda q: _vector(spark, sf_dir), _index(spark, sf_dir)).select("doc_id", F.round("score", 6).alias("score"))


@query(
    "search_overfetch",
    f"""WITH {_BM25}, {_ABLE}, top3 AS (SELECT doc_id, 1 - (row_number() OVER (ORDER BY round(bm25, 9) DESC, doc_id) - 1) / 300.0::DOUBLE AS rank_score FROM bm ORDER BY round(bm25, 9) DESC, doc_id LIMIT 300)
    SELECT doc_id, round(rank_score, 6) AS score FROM top3 WHERE doc_id IN (SELECT doc_id FROM able) ORDER BY top3.rank_score DESC, doc_id LIMIT 10""",
)
def search_overfetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters after the ranking of thirty times the limit: fewer hits may be left than there are."""
    asked = Request(_SEARCH.query, "fts", _SEARCH.filters, _SEARCH.limit)
    chunks = views.chunks(spark, sf_dir).withColumnRenamed("note_id", "doc_id")
    found = search.run(asked, views.notes(spark, sf_dir), chunks, lambda q: [], _index(spark, sf_dir), overfetch=30)
    return found.select("doc_id", F.round("score", 6).alias("score"))
