"""Vector queries over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengraph.operators import graph, similar, vectors
from lumengraph.plans.catalog import query
from lumengraph.sources import views

_L2 = "list_sum(list_transform(list_zip({a}, {b}), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda x: x[1] * x[2]))"


def _vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return views.chunks(spark, sf_dir).filter("vec_id = 0").first().vector


@query(
    "vector_topk",
    f"""
    WITH c AS ({views.CHUNKS_SQL}), q AS (SELECT vector AS v FROM c WHERE vec_id = 0)
    SELECT c.vec_id, round({_L2.format(a="c.vector", b="q.v")}, 6) AS dist FROM c, q ORDER BY {_L2.format(a="c.vector", b="q.v")}, 1 LIMIT 10
    """,
)
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.topk(views.chunks(spark, sf_dir), vectors.literal(_vector(spark, sf_dir)), 10).select("vec_id", F.round("distance", 6).alias("dist"))


@query(
    "multi_vector_topk",
    f"""
    WITH c AS ({views.CHUNKS_SQL}),
    d AS (SELECT q.vec_id AS query_index, c.vec_id, {_L2.format(a="c.vector", b="q.vector")} AS d FROM c, c q WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_index ORDER BY round(d, 9), vec_id) AS rank FROM d)
    SELECT query_index, vec_id, round(d, 6) AS dist, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5
    """,
)
def multi_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.chunks(spark, sf_dir)
    found = vectors.nearest(c.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_index"), c, 5)
    return found.select("query_index", "vec_id", F.round("distance", 6).alias("dist"), "rank")


@query("query_hit_counts", f"WITH c AS ({views.CHUNKS_SQL}), d AS (SELECT q.vec_id AS query_index, row_number() OVER (PARTITION BY q.vec_id ORDER BY c.vec_id) AS r FROM c, c q WHERE q.vec_id % 100 = 0) SELECT query_index, count(*) AS hits FROM d WHERE r <= 7 GROUP BY query_index")
def query_hit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.chunks(spark, sf_dir)
    return similar.hit_counts(vectors.nearest(c.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_index"), c, 7))


_KNN = f"""
    c AS ({views.CHUNKS_SQL}),
    s AS (SELECT a.vec_id AS i, b.vec_id AS j, {_DOT.format(a="a.vector", b="b.vector")} AS sim FROM c a, c b WHERE a.vec_id <> b.vec_id),
    knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(sim, 9) DESC, j) AS rank FROM s) WHERE rank <= {{k}})
"""


@query("knn_graph", f"WITH {_KNN.format(k=5)} SELECT i, j, round(sim, 6) AS sim, CAST(rank AS INTEGER) AS rank FROM knn")
def knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.knn_graph(views.chunks(spark, sf_dir), 5).select("i", "j", F.round("sim", 6).alias("sim"), "rank")


@query(
    "embedding_normalize",
    f"""
    WITH c AS ({views.CHUNKS_SQL}), s AS (SELECT vec_id, list_transform(vector, lambda x: x * (1 + vec_id % 3)) AS v FROM c),
    n AS (SELECT vec_id, v, sqrt({_DOT.format(a="v", b="v")}) AS norm FROM s)
    SELECT vec_id, CAST(unnest(range(0, len(v))) AS INTEGER) AS place, round(unnest(list_transform(v, lambda x: CASE WHEN abs(norm - 1) > 0.001 THEN x / norm ELSE x END)), 6) AS value, round(norm, 6) AS norm FROM n WHERE norm > 1e-12
    """,
)
def embedding_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.chunks(spark, sf_dir).withColumn("v", F.transform("vector", lambda x: x * (F.col("vec_id") % 3 + 1)))
    c = c.select("vec_id", vectors.normalized(F.col("v")).alias("unit"), F.sqrt(vectors.dot(F.col("v"), F.col("v"))).alias("norm"))
    c = c.filter("unit IS NOT NULL").select("vec_id", F.posexplode("unit").alias("place", "value"), "norm")
    return c.select("vec_id", "place", F.round("value", 6).alias("value"), F.round("norm", 6).alias("norm"))


def _similar_sql(fold: str, threshold: float, excluded: str = "") -> str:
    return f"""
    WITH c AS ({views.CHUNKS_SQL}), links AS ({views.LINKS_SQL}),
    h AS (SELECT o.note_id, o.note_path, o.chunk_index, q.chunk_index AS query_index, 1 / (1 + greatest({_L2.format(a="o.vector", b="q.vector")}, 0)) AS sim
          FROM c o, c q WHERE q.note_id = 2 AND o.note_id <> 2 {excluded}),
    b AS (SELECT *, row_number() OVER (PARTITION BY note_id, query_index ORDER BY round(sim, 9) DESC, chunk_index) AS n FROM h),
    m AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY round(sim, 9) DESC, query_index) AS o FROM b WHERE n = 1)
    SELECT note_path, round({fold}(sim), 6) AS similarity, round(min(sim), 6) AS least, round(avg(sim), 6) AS mean, count(*) AS matched,
           max(CASE WHEN o = 1 THEN chunk_index END) AS best_chunk
    FROM m GROUP BY note_path HAVING {fold}(sim) >= {threshold} ORDER BY round({fold}(sim), 9) DESC, note_path LIMIT 20
    """


def _similar(found: DataFrame) -> DataFrame:
    top = similar.ordered(found, "similarity", 20)
    return top.select("note_path", *(F.round(c, 6).alias(c) for c in ("similarity", "least", "mean")), "matched", "best_chunk")


@query("find_similar_max", _similar_sql("max", 0.38))
def find_similar_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _similar(similar.find_similar(views.chunks(spark, sf_dir), 2, 0.38))


@query("find_similar_avg", _similar_sql("avg", 0.36))
def find_similar_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _similar(similar.find_similar(views.chunks(spark, sf_dir), 2, 0.36, mode="avg"))


@query("find_similar_excl_both", _similar_sql("max", 0.38, "AND o.note_id NOT IN (SELECT dst FROM links WHERE src = 2 UNION SELECT src FROM links WHERE dst = 2)"))
def find_similar_excl_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = similar.linked_to(views.links(spark, sf_dir), 2)
    return _similar(similar.find_similar(views.chunks(spark, sf_dir), 2, 0.38, excluded=out))


_BFS = f"""
    links AS ({views.LINKS_SQL}), e AS (SELECT src, dst FROM links UNION SELECT dst, src FROM links),
    reach(src, node, d) AS (SELECT {{start}}, 0 {{source}} UNION SELECT reach.src, e.dst, d + 1 FROM reach JOIN e ON reach.node = e.src WHERE d < {{depth}}),
    dist AS (SELECT src, node, min(d) AS distance FROM reach GROUP BY src, node)
"""


def _bridges_sql(score: str, where: str = "", limit: int = 20) -> str:
    return f"""
    WITH RECURSIVE {_KNN.format(k=8)}, info AS (SELECT vec_id, note_id, note_path FROM c {where}),
    p AS (SELECT least(x.note_path, y.note_path) AS path_a, greatest(x.note_path, y.note_path) AS path_b,
                 CASE WHEN x.note_path < y.note_path THEN x.note_id ELSE y.note_id END AS a, CASE WHEN x.note_path < y.note_path THEN y.note_id ELSE x.note_id END AS b, sim
          FROM knn JOIN info x ON knn.i = x.vec_id JOIN info y ON knn.j = y.vec_id WHERE i < j AND sim >= 0.25 AND x.note_id <> y.note_id),
    best AS (SELECT path_a, path_b, a, b, max(sim) AS sim FROM p GROUP BY ALL),
    {_BFS.format(start="n, n", source="FROM (SELECT DISTINCT a AS n FROM best)", depth=8)},
    scored AS (SELECT path_a, path_b, sim, distance, {score} * CASE WHEN split_part(path_a, '/', 1) <> split_part(path_b, '/', 1) THEN 1.3 ELSE 1.0 END AS score
               FROM best LEFT JOIN dist ON dist.src = a AND dist.node = b WHERE distance IS NULL OR distance >= 3)
    SELECT path_a, path_b, round(sim, 6) AS sim, CAST(coalesce(distance, -1) AS INTEGER) AS distance, round(score, 6) AS score FROM scored ORDER BY round(scored.score, 9) DESC, path_a, path_b LIMIT {limit}
    """


def _bridges(found: DataFrame) -> DataFrame:
    return found.select("path_a", "path_b", F.round("sim", 6).alias("sim"), F.coalesce("distance", F.lit(-1)).alias("distance"), F.round("score", 6).alias("score"))


@query("bridges_surprise", _bridges_sql("sim * log2(coalesce(distance, 9) + 1.0)"))
def bridges_surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bridges(similar.bridges(views.chunks(spark, sf_dir), views.links(spark, sf_dir), k=8, min_similarity=0.25))


@query("bridges_similarity", _bridges_sql("sim"))
def bridges_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bridges(similar.bridges(views.chunks(spark, sf_dir), views.links(spark, sf_dir), k=8, min_similarity=0.25, surprise=False))


@query("bridges_folder", _bridges_sql("sim * log2(coalesce(distance, 9) + 1.0)", "WHERE note_path LIKE 'f1/%'"))
def bridges_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bridges(similar.bridges(views.chunks(spark, sf_dir), views.links(spark, sf_dir), k=8, min_similarity=0.25, folder="f1/"))


@query("link_distance", f"WITH RECURSIVE {_BFS.format(start='n, n', source='FROM (SELECT DISTINCT vec_id // 4 AS n FROM embeddings)', depth=4)} SELECT src, node, CAST(distance AS INTEGER) AS distance FROM dist")
def link_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.distances(views.links(spark, sf_dir), views.chunks(spark, sf_dir).select(F.col("note_id").alias("node")), 4)


@query("backlinks", f"WITH links AS ({views.LINKS_SQL}) SELECT DISTINCT dst AS note_id, src AS source FROM links")
def backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.backlinks(views.links(spark, sf_dir)).toDF("note_id", "source")


_DEGREE = f"links AS ({views.LINKS_SQL}), e AS (SELECT src, dst FROM links UNION SELECT dst, src FROM links), deg AS (SELECT src AS node, count(*) AS degree FROM e GROUP BY src)"


@query("degree_map", f"WITH {_DEGREE} SELECT node, degree FROM deg")
def degree_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(views.links(spark, sf_dir))


@query(
    "neighbors_ranked",
    f"""WITH {_DEGREE}, w AS (SELECT src AS node, dst AS neighbour, 'out' AS way FROM links UNION ALL SELECT dst, src, 'in' FROM links),
    g AS (SELECT node, neighbour, CASE WHEN min(way) = max(way) THEN min(way) ELSE 'both' END AS directions FROM w GROUP BY node, neighbour)
    SELECT g.node, neighbour, directions, degree, CAST(row_number() OVER (PARTITION BY g.node ORDER BY degree DESC, neighbour) AS INTEGER) AS rank
    FROM g JOIN deg ON g.neighbour = deg.node""",
)
def neighbors_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(views.links(spark, sf_dir))


@query("explore_dedup", f"WITH RECURSIVE {_BFS.format(start='CAST(4 AS BIGINT), CAST(4 AS BIGINT)', source='', depth=3)} SELECT node, CAST(distance AS INTEGER) AS depth FROM dist")
def explore_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.explore(views.links(spark, sf_dir), 4, 3).select("node", "depth")
