"""Recent activity, snapshots and event windows over ``events`` and ``documents``."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengraph.functions import dates, markdown, text
from lumengraph.operators import activity, changes
from lumengraph.plans.catalog import query
from lumengraph.sources import views
from lumengraph.sources.tables import table
from lumengraph.streaming import refresh

TODAY = date(2024, 1, 30)
WINDOW = dates.recent(7, TODAY)
_A, _Z, _B, _Y = (f"DATE '{d}'" for d in WINDOW)
_E = "e AS (SELECT event_id, CAST(ts AS DATE) AS day, event_type AS tag, user_id FROM events)"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("date").alias("day"), F.array("event_type").alias("tags"), "user_id")


@query("recent_counts", f"WITH {_E} SELECT count(*) FILTER (WHERE day BETWEEN {_A} AND {_Z}) AS current, count(*) FILTER (WHERE day BETWEEN {_B} AND {_Y}) AS previous FROM e")
def recent_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.counts(_entries(spark, sf_dir), WINDOW)


@query("recent_top_tags", f"WITH {_E} SELECT tag, count(*) AS uses FROM e WHERE day BETWEEN {_A} AND {_Z} GROUP BY tag")
def recent_top_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.top_tags(activity.within(_entries(spark, sf_dir), *WINDOW[:2]))


@query("recent_new_tags", f"WITH {_E} SELECT DISTINCT tag || CAST(user_id AS VARCHAR) AS tag FROM e WHERE day BETWEEN DATE '2024-01-05' AND {_Z} AND tag || CAST(user_id AS VARCHAR) NOT IN (SELECT tag || CAST(user_id AS VARCHAR) FROM e WHERE day < DATE '2024-01-05')")
def recent_new_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entries(spark, sf_dir).withColumn("tags", F.transform("tags", lambda t: F.concat(t, F.col("user_id").cast("string"))))
    return activity.new_tags(e, date(2024, 1, 5), TODAY)


_DAYS = "(SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS d)"


@query("recent_gaps", f"WITH {_E} SELECT u.user_id, strftime(d, '%Y-%m-%d') AS day FROM (SELECT DISTINCT user_id FROM e) u, {_DAYS} WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.user_id = u.user_id AND e.day = d)")
def recent_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days without an event of each user."""
    return activity.gaps(_entries(spark, sf_dir), date(2024, 1, 1), TODAY, by=["user_id"]).select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"))


_WORDS = "len(string_split_regex(regexp_replace(full_text, '^\\s+|\\s+$', '', 'g'), '\\s+'))"


@query(
    "recent_extremes",
    f"""WITH n AS ({views.NOTES_SQL}), w AS (SELECT title, CASE WHEN trim(full_text) = '' THEN 0 ELSE {_WORDS} END AS words FROM n)
    SELECT (SELECT title FROM w ORDER BY words DESC, title LIMIT 1) AS longest, CAST((SELECT max(words) FROM w) AS BIGINT) AS longest_words,
           (SELECT title FROM w ORDER BY words, title LIMIT 1) AS shortest, CAST((SELECT min(words) FROM w) AS BIGINT) AS shortest_words""",
)
def recent_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.extremes(views.notes(spark, sf_dir).select("title", text.word_count(F.col("full_text")).alias("words")))


@query("recent_entries", f"WITH n AS ({views.NOTES_SQL}) SELECT source_file, title, strftime(to_timestamp(last_modified) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day FROM n ORDER BY last_modified DESC, source_file LIMIT 10")
def recent_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = views.notes(spark, sf_dir).orderBy(F.desc("last_modified"), "source_file").limit(10)
    return top.select("source_file", "title", text.day(F.col("last_modified")).alias("day"))


_SNAPSHOTS = """
    old AS (SELECT doc_id AS k, md5(text) AS h FROM documents WHERE doc_id % 10 <> 0),
    new AS (SELECT doc_id AS k, md5(CASE WHEN doc_id % 5 = 0 THEN text || ' changed' ELSE text END) AS h FROM documents WHERE doc_id % 7 <> 0)
"""


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents")
    old = d.filter("doc_id % 10 <> 0").select(F.col("doc_id").alias("k"), F.md5("text").alias("content_hash"))
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))
    return old, d.filter("doc_id % 7 <> 0").select(F.col("doc_id").alias("k"), F.md5(changed).alias("content_hash"))


@query(
    "detect_changes",
    f"WITH {_SNAPSHOTS} SELECT coalesce(old.k, new.k) AS k, CASE WHEN old.k IS NULL THEN 'added' WHEN new.k IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM old FULL JOIN new ON old.k = new.k WHERE old.h IS DISTINCT FROM new.h",
)
def detect_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.detect(*_snapshots(spark, sf_dir), key="k")


@query("merge_upsert", f"WITH {_SNAPSHOTS} SELECT k, h AS content_hash FROM new UNION ALL SELECT k, h FROM old WHERE k NOT IN (SELECT k FROM new)")
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.merge(*_snapshots(spark, sf_dir), ["k"])


@query("delete_by_path", f"WITH {_SNAPSHOTS} SELECT k, h AS content_hash FROM old WHERE k NOT IN (SELECT k FROM new)")
def delete_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _snapshots(spark, sf_dir)
    return changes.delete(old, new, "k")


@query(
    "reindex_plan",
    f"""WITH n AS ({views.NOTES_SQL}), s AS (SELECT source_file FROM n WHERE doc_id % 10 <> 0 AND starts_with(source_file, 'src1/')), p AS (SELECT source_file FROM n WHERE doc_id % 7 <> 0 AND starts_with(source_file, 'src1/'))
    SELECT source_file, 'reindex' AS action FROM p UNION ALL SELECT source_file, 'delete' FROM s WHERE source_file NOT IN (SELECT source_file FROM p)""",
)
def reindex_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.notes(spark, sf_dir)
    return changes.reindex_plan(n.filter("doc_id % 10 <> 0"), n.filter("doc_id % 7 <> 0"), spark.createDataFrame([("src1/",)], "path string"))


@query(
    "event_window_counts",
    "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS events, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
)
def event_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = refresh.event_windows(table(spark, sf_dir, "events")).drop("end")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "events", F.round("total", 6).alias("total"))


# texts with links, frontmatter and dated lines made from documents
_MADE_SQL = """made AS (SELECT doc_id, '---' || chr(10) || 'tags: [' || lang || ', "' || source || '"]' || chr(10) || 'created: 2024-01-' || lpad(CAST(1 + doc_id % 28 AS VARCHAR), 2, '0') || chr(10) || '---' || chr(10)
    || '# Note ' || CAST(doc_id AS VARCHAR) || chr(10) || 'See [[Note ' || CAST(doc_id % 9 AS VARCHAR) || ']] and [[' || source || '#part|the  source]] of ' || CAST(doc_id AS VARCHAR) || '.' AS t FROM documents)"""


def _made(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = F.lit("\n"), lambda c: F.col(c).cast("string")
    front = F.concat(F.lit("---\ntags: ["), "lang", F.lit(', "'), "source", F.lit('"]\ncreated: 2024-01-'), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), n, F.lit("---\n"))
    rest = F.concat(F.lit("# Note "), s("doc_id"), F.lit("\nSee [[Note "), (F.col("doc_id") % 9).cast("string"), F.lit("]] and [["), "source", F.lit("#part|the  source]] of "), s("doc_id"), F.lit("."))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(front, rest).alias("t"))


@query(
    "extract_wikilinks",
    f"""WITH {_MADE_SQL}, l AS (SELECT doc_id, unnest(regexp_extract_all(t, '\\[\\[([^\\]|#]+)(?:#[^\\]|]*)?\\|?([^\\]]*)\\]\\]', 1)) AS target, unnest(regexp_extract_all(t, '\\[\\[([^\\]|#]+)(?:#[^\\]|]*)?\\|?([^\\]]*)\\]\\]', 2)) AS alias FROM made)
    SELECT doc_id, trim(target) AS target, trim(alias) AS alias FROM l""",
)
def extract_wikilinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir).select("doc_id", F.explode(text.wikilinks(F.col("t"))).alias("l")).select("doc_id", "l.target", F.coalesce("l.alias", F.lit("")).alias("alias"))


@query(
    "parse_note",
    f"""WITH {_MADE_SQL} SELECT made.doc_id, 'Note ' || CAST(made.doc_id AS VARCHAR) AS title, lang || ',' || source AS tags, CAST(epoch(DATE '2024-01-01') + (made.doc_id % 28) * 86400 AS DOUBLE) AS created,
    chr(10) || '# Note ' || CAST(made.doc_id AS VARCHAR) || chr(10) || 'See Note ' || CAST(made.doc_id % 9 AS VARCHAR) || ' and the  source of ' || CAST(made.doc_id AS VARCHAR) || '.' AS body FROM made JOIN documents USING (doc_id)""",
)
def parse_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    front, body = text.frontmatter(F.col("t")), text.body(F.col("t"))
    return _made(spark, sf_dir).select(
        "doc_id", text.title(body, F.lit("x.md")).alias("title"), F.array_join(text.tags(front), ",").alias("tags"), text.date_field(front, "created").alias("created"), text.without_wikilinks(body).alias("body")
    )


@query(
    "text_measures",
    f"""SELECT doc_id, CASE WHEN trim(text) = '' THEN 0 ELSE CAST({_WORDS.replace("full_text", "text")} AS BIGINT) END AS words,
    length(regexp_replace(regexp_replace(text, '(?m)^\\s*([-*] |\\d+[.)] )', '', 'g'), '\\s', '', 'g')) AS prose FROM documents""",
)
def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"), text.prose_chars(F.col("text")).alias("prose"))


@query("chunk_sections")
def chunk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of whole documents under a heading; paragraphs are too many ways of Markdown for SQL."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("# Part\n\n"), "text").alias("t"))
    c = F.explode(markdown.chunk_column(F.col("t"), F.concat(F.lit("n"), F.col("doc_id").cast("string")))).alias("c")
    return d.select("doc_id", c).select("doc_id", "c.chunk_index", "c.breadcrumb", F.octet_length("c.content").alias("bytes"))


@query("event_sliding", "SELECT CAST(s AS TIMESTAMP) AS start, event_type, count(*) AS events FROM (SELECT event_type, unnest([date_trunc('hour', ts) - INTERVAL 1 HOUR, date_trunc('hour', ts)]) AS s FROM events) GROUP BY 1, 2")
def event_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of two hours that start every hour."""
    w = refresh.event_windows(table(spark, sf_dir, "events"), "2 hours", slide="1 hour")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "events")


@query(
    "event_sessions",
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS n FROM e)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS end, count(*) AS events FROM s GROUP BY user_id, n""",
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's runs of events less than twelve hours apart."""
    w = refresh.event_sessions(table(spark, sf_dir, "events"), "12 hours")
    return w.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "events")


@query("event_last", "SELECT event_type, event_id, rank FROM (SELECT event_type, event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS INTEGER) AS rank FROM events) WHERE rank <= 5")
def event_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.newest(table(spark, sf_dir, "events").select("event_type", "event_id"), "event_type", "event_id", 5)


_DATED_SQL = f"""n AS ({views.NOTES_SQL}), e AS (SELECT CASE WHEN doc_id % 11 = 0 THEN 'journal/' || strftime(DATE '2024-01-24' + CAST(doc_id % 4 AS INTEGER), '%Y-%m-%d') || '.' || CAST(doc_id AS VARCHAR) || '.md' ELSE source_file END AS path, title, last_modified AS seconds,
    CAST(to_timestamp(last_modified) AT TIME ZONE 'UTC' AS DATE) AS day, tags, CASE WHEN trim(full_text) = '' THEN 0 ELSE {_WORDS} END AS words FROM n),
    now AS (SELECT * FROM e WHERE day BETWEEN {_A} AND {_Z})"""


def _dated_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, day = views.notes(spark, sf_dir), F.date_add(F.lit("2024-01-24").cast("date"), (F.col("doc_id") % 4).cast("int"))
    path = F.concat(F.lit("journal/"), F.date_format(day, "yyyy-MM-dd"), F.lit("."), F.col("doc_id").cast("string"), F.lit(".md"))
    return n.select(
        F.when(F.col("doc_id") % 11 == 0, path).otherwise(F.col("source_file")).alias("path"), "title", F.col("last_modified").alias("at"),
        text.day(F.col("last_modified")).cast("date").alias("day"), "tags", text.word_count(F.col("full_text")).alias("words"),
    )


_GAPS_SQL = f"SELECT strftime(d, '%Y-%m-%d') AS day FROM {_DAYS} WHERE d BETWEEN {_A} AND {_Z} AND d NOT IN (SELECT CAST(regexp_extract(path, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AS DATE) FROM now WHERE starts_with(path, 'journal/'))"


@query("journal_gaps", f"WITH {_DATED_SQL} {_GAPS_SQL}")
def journal_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.journal_gaps(_dated_entries(spark, sf_dir), *WINDOW[:2]).select(F.date_format("day", "yyyy-MM-dd").alias("day"))


@query(
    "recent_context",
    f"""WITH {_DATED_SQL}, t AS (SELECT unnest(tags) AS tag FROM now)
    SELECT 'current' AS part, '' AS name, (SELECT count(*) FROM now) AS value
    UNION ALL SELECT 'previous', '', (SELECT count(*) FROM e WHERE day BETWEEN {_B} AND {_Y})
    UNION ALL SELECT 'tag', tag, count(*) FROM t GROUP BY tag
    UNION ALL SELECT 'new_tag', tag, 1 FROM t WHERE tag NOT IN (SELECT unnest(tags) FROM e WHERE day < {_A}) GROUP BY tag
    UNION ALL SELECT 'gap', day, 1 FROM ({_GAPS_SQL}) WHERE (SELECT count(*) FROM now) > 0
    UNION ALL (SELECT 'longest', title, words FROM now ORDER BY words DESC, title LIMIT 1)
    UNION ALL (SELECT 'shortest', title, words FROM now ORDER BY words, title LIMIT 1)
    UNION ALL (SELECT 'entry', path, CAST(floor(seconds) AS BIGINT) FROM now ORDER BY seconds DESC, path LIMIT 10)""",
)
def recent_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A week's activity as a whole."""
    return activity.recent_context(_dated_entries(spark, sf_dir), WINDOW)
