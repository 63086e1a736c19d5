"""Notes as files: edits, frontmatter, chunks, paths, trees, looking up, counts; on notes made of ``documents``."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengraph.functions import edits, embedding, frontmatter, markdown, paths, text
from lumengraph.operators import changes, filters, predicates, search, tree
from lumengraph.plans.activity import _MADE_SQL, _made
from lumengraph.plans.catalog import query
from lumengraph.sources import vault, views
from lumengraph.sources.tables import table

_N = f"n AS ({views.NOTES_SQL})"
_NL = "chr(10)"


def _mapped(of: Callable[[str], str], value: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(of)

    return F.pandas_udf(run, "string")(value)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


@query("index_stats", "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM embeddings) AS chunks")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.notes(spark, sf_dir).agg(F.count("*").alias("documents"))
    return d.join(views.chunks(spark, sf_dir).agg(F.count("*").alias("chunks")))  # one row each


@query("paths_below", f"WITH {_N} SELECT source_file FROM n WHERE starts_with(source_file, 'src1/')")
def paths_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vault.paths_below(views.notes(spark, sf_dir), "src1", "source_file")


_EDITS = {
    "append": ("append", ("End",), f"t || {_NL} || 'End' || {_NL}"),
    "prepend": ("prepend", ("Top",), f"replace(t, {_NL} || '# Note ', {_NL} || 'Top' || {_NL} || '# Note ') || {_NL}"),
    "overwrite": ("overwrite", ("Only",), f"substr(t, 1, strpos(t, {_NL} || '# Note ')) || 'Only' || {_NL}"),
    "replace_text": ("replace_text", ("See ", "Look at "), "replace(t, 'See ', 'Look at ')"),
    "insert_after": ("insert_after", ("See ", "mid"), f"replace(t, 'See ', 'See ' || {_NL} || 'mid' || {_NL})"),
    "append_below": ("append", ("more", "More"), f"t || {_NL} || 'more' || {_NL} || {_NL} || '## Last' || {_NL} || 'x'"),
    "prepend_below": ("prepend", ("more", "## More"), f"replace(t, '## More' || {_NL}, '## More' || {_NL} || 'more' || {_NL}) || {_NL} || '## Last' || {_NL} || 'x'"),
    "replace_section": ("replace_section", ("More", "## More\nnew"), f"replace(t, {_NL} || 'old', {_NL} || 'new') || {_NL} || {_NL} || '## Last' || {_NL} || 'x'"),
    "ambiguous": ("replace_text", ("\n", "x"), "NULL"),
    "missing": ("replace_section", ("No such", "x"), "NULL"),
}
_WITH_MORE = ("append_below", "prepend_below", "replace_section")
_MORE, _LAST = "\n## More\nold", "\n## Last\nx"


@query(
    "note_edits",
    f"WITH {_MADE_SQL} "
    + " UNION ALL ".join(
        f"SELECT doc_id, '{name}' AS edit, coalesce({sql}, '') AS text FROM " + (f"(SELECT doc_id, t || {_NL} || '## More' || {_NL} || 'old' AS t FROM made)" if name in _WITH_MORE else "made") for name, (_, _, sql) in _EDITS.items()
    ),
)
def note_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every way to edit, of every note; an edit that can't be made gives an empty text here."""
    made = _made(spark, sf_dir)
    out = []
    for name, (mode, args, _) in _EDITS.items():
        t = F.concat("t", F.lit(_MORE + _LAST)) if name in _WITH_MORE else F.col("t")
        out.append(made.select("doc_id", F.lit(name).alias("edit"), F.coalesce(edits.edited(mode, t, *args)["text"], F.lit("")).alias("text")))
    return _union(out)


_FRONT = {
    "set": (lambda t: frontmatter.with_field(t, "created", "2025-02-03"), "regexp_replace(t, 'created: [0-9-]+', 'created: 2025-02-03')"),
    "add": (lambda t: frontmatter.with_field(t, "status", "done"), f"replace(t, {_NL} || '---' || {_NL} || '# Note', {_NL} || 'status: done' || {_NL} || '---' || {_NL} || '# Note')"),
    "set_if_there": (lambda t: frontmatter.with_field(t, "status", "done", add=False), "t"),
    "add_tags": (lambda t: frontmatter.add_tags(t, ["en", "new", "new"]), f"regexp_replace(t, 'tags: .([a-z]+), \"([^\"]+)\".', 'tags:' || {_NL} || '- \\1' || {_NL} || '- \\2' || CASE WHEN contains(t, '[en,') THEN '' ELSE {_NL} || '- en' END || {_NL} || '- new')"),
    "remove_tags": (lambda t: frontmatter.remove_tags(t, ["en", "de", "fr", "es"]), f"regexp_replace(t, 'tags: .([a-z]+), \"([^\"]+)\".', 'tags:' || CASE WHEN regexp_matches(t, '.(en|de|fr|es),') THEN '' ELSE {_NL} || '- \\1' END || {_NL} || '- \\2')"),
    "edit_tags": (lambda t: frontmatter.edit_tags(t, ["new"], ["en"], ("created", "2025")).text, f"regexp_replace(regexp_replace(t, 'tags: .([a-z]+), \"([^\"]+)\".', 'tags:' || CASE WHEN contains(t, '[en,') THEN '' ELSE {_NL} || '- \\1' END || {_NL} || '- \\2' || {_NL} || '- new'), 'created: [0-9-]+', 'created: 2025')"),
    "new": (
        lambda t: frontmatter.new(t.rsplit(" of ", 1)[1], ["a", "b"], ["b", "c"], ["x y"], "2024-05-06") + "body",
        f"'---' || {_NL} || 'title: \"' || CAST(doc_id AS VARCHAR) || '.\"' || {_NL} || 'aliases: [x y]' || {_NL} || 'tags: [a, b, c]' || {_NL} || 'created: 2024-05-06' || {_NL} || 'modified: 2024-05-06' || {_NL} || '---' || {_NL} || 'body'",
    ),
}


@query("frontmatter_edits", f"WITH {_MADE_SQL} " + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS edit, {sql} AS text FROM made" for k, (_, sql) in _FRONT.items()))
def frontmatter_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _made(spark, sf_dir)
    return _union([made.select("doc_id", F.lit(k).alias("edit"), _mapped(of, F.col("t")).alias("text")) for k, (of, _) in _FRONT.items()])


_PARTS_SQL = f"""parts AS (SELECT doc_id, source || '/' || CAST(doc_id AS VARCHAR) || '.md' AS path, 'Opening words of this note number ' || CAST(doc_id AS VARCHAR) AS a,
    'Some text that stands below the first heading, with [[Note ' || CAST(doc_id % 9 AS VARCHAR) || '|a link]] in it.' AS b, 'Last part, which says a few things more about ' || lang AS c FROM documents)"""


@query(
    "chunk_notes",
    f"""WITH {_PARTS_SQL}
    SELECT doc_id, 0 AS chunk_index, path AS breadcrumb, a AS content, '' AS links FROM parts
    UNION ALL SELECT doc_id, 1, path || ' > One', replace(regexp_replace(b, '\\[\\[[^|]*\\|', ''), ']]', ''), regexp_extract(b, '\\[\\[([^|]*)', 1) FROM parts
    UNION ALL SELECT doc_id, 2, path || ' > One > Deep', c, '' FROM parts""",
)
def chunk_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preamble, sections and breadcrumbs of made notes; a section of little prose, one of dates, and their links are left out."""
    s = lambda c: F.col(c).cast("string")
    log = "## Log\n- 2024-01-01 did [[Nothing]] much\n- 2024-01-02 did more\n"
    body = F.concat(
        F.lit("Opening words of this note number "), s("doc_id"), F.lit("\n# One\nSome text that stands below the **first** heading, with [[Note "), (F.col("doc_id") % 9).cast("string"),
        F.lit("|a link]] in it.\n### Deep\nLast part, which says a few things more about "), "lang", F.lit(f"\n# Short\n```\n# no heading\n```\n[[Only links]]\n{log}"),
    )
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), s("doc_id"), F.lit(".md")).alias("path"), body.alias("t"))
    c = d.select("doc_id", F.explode(markdown.chunk_column(F.col("t"), F.col("path"))).alias("c")).select("doc_id", "c.*")
    return c.select("doc_id", "chunk_index", "breadcrumb", "content", F.array_join("links.target", ",").alias("links"))


@query(
    "note_paths",
    f"""WITH {_N} SELECT doc_id, source_file AS target, CAST(doc_id AS VARCHAR) AS stem, 'Note ' || CAST(doc_id AS VARCHAR) AS unwrapped, title AS section, CASE WHEN doc_id % 2 = 0 THEN title ELSE '' END AS own_section,
    CASE WHEN doc_id % 3 = 0 THEN strftime(DATE '2024-01-01' + CAST(doc_id % 28 AS INTEGER), '%Y-%m-%d') ELSE '' END AS dated FROM (SELECT doc_id, source_file, 'S' || CAST(doc_id AS VARCHAR) AS title FROM n)""",
)
def note_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms and labels of paths."""
    n = views.notes(spark, sf_dir).select("doc_id", "source_file", F.concat(F.lit("S"), F.col("doc_id").cast("string")).alias("s"))
    bare = F.translate(F.regexp_replace("source_file", "[.]md$", ""), "/", "\\")
    crumb = F.when(F.col("doc_id") % 2 == 0, F.concat("source_file", F.lit(" > A > "), "s")).otherwise(F.col("s"))
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 28).cast("int")), "yyyy-MM-dd")
    dated = F.concat(F.lit("2024-99-99/x/"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("journal "), day)).otherwise("notes 2024"), F.lit(".md"))
    return n.select(
        "doc_id", paths.target(bare).alias("target"), paths.stem(F.col("source_file")).alias("stem"),
        paths.unwrapped(F.concat(F.lit(" [[ Note "), F.col("doc_id").cast("string"), F.lit(" |x]] "))).alias("unwrapped"), paths.section(crumb).alias("section"),
        F.coalesce(F.when(F.col("doc_id") % 2 == 0, paths.section(crumb, F.col("source_file"))).otherwise(paths.section(F.col("s"), F.col("s"))), F.lit("")).alias("own_section"),
        F.coalesce(F.date_format(text.path_date(dated), "yyyy-MM-dd"), F.lit("")).alias("dated"),
    )


@query(
    "text_cuts",
    """SELECT doc_id, substr(text, 1, 50) AS excerpt, CASE WHEN ascii_only THEN CASE WHEN length(t) <= 40 THEN t ELSE substr(t, 1, 40) || '...' END ELSE '' END AS truncated,
    CASE WHEN ascii_only THEN substr(t, 11, 20) ELSE '' END AS part, CASE WHEN ascii_only THEN substr('passage: ' || 'n > S' || chr(10) || chr(10) || t, 1, 60) ELSE '' END AS embed, octets
    FROM (SELECT doc_id, text, text AS t, strlen(text) = length(text) AS ascii_only, strlen(text) AS octets FROM documents)""",
)
def text_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts by characters and by bytes; the SQL has those by bytes for ASCII texts only, so others are empty here."""
    t = F.col("text")
    plain = F.octet_length(t) == F.length(t)
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", F.substring(t, 1, 50).alias("excerpt"), F.when(plain, text.truncated(t, 40)).otherwise("").alias("truncated"), F.when(plain, text.byte_slice(t, 10, 20)).otherwise("").alias("part"),
        F.when(plain, embedding.embed_text(F.lit("n > S"), t, "passage: ", 60)).otherwise("").alias("embed"), F.octet_length(t).cast("long").alias("octets"),
    )


@query("changelog_notes", "SELECT doc_id, doc_id % 10 < 8 AS log FROM documents")
def changelog_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which notes are lists of dated lines: two or three plain lines of ten."""
    plain = F.when(F.col("doc_id") % 10 < 8, 2).otherwise(3)
    lines = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(i >= plain, F.lit("- [[2024-01-02]] a")).otherwise(F.lit("1. plain")))
    return table(spark, sf_dir, "documents").select("doc_id", text.is_changelog(F.array_join(lines, "\n")).alias("log"))


_FILTERS = filters.Filters("src1", 1704300000.0, 1705900000.0, ("EN",))


@query("filtered_notes", f"WITH {_N} SELECT source_file FROM n WHERE starts_with(source_file, 'src1/') AND last_modified BETWEEN 1704300000 AND 1705900000 AND list_contains(tags, 'en')")
def filtered_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _FILTERS.of(views.notes(spark, sf_dir)).select("source_file")


_ASKED = ["src0/en/0.md", "1", "nowhere", "7.md", "SRC3\\EN\\3", "", "src0/en/0"]


def _asked_sql(shown: str) -> str:
    return f"""
    WITH {_N}, w(position, path) AS (VALUES {", ".join(f"({i}, '{p}')" for i, p in enumerate(_ASKED))}),
    x AS (SELECT position, source_file FROM w JOIN n ON n.source_file = w.path),
    m AS (SELECT position, source_file FROM w, (SELECT source_file, lower(source_file) AS p FROM n), LATERAL (SELECT lower(replace(w.path, chr(92), '/')) AS q)
          WHERE position NOT IN (SELECT position FROM x) AND (p = q OR p = q || '.md' OR ends_with(p, '/' || q) OR ends_with(p, '/' || q || '.md'))
          UNION ALL SELECT * FROM x),
    g AS (SELECT position, count(*) AS n, min(source_file) AS f FROM m GROUP BY position)
    SELECT w.position, CASE WHEN g.n IS NULL THEN 'not found' WHEN g.n = 1 THEN 'found' ELSE 'ambiguous' END AS status, CASE WHEN g.n = 1 THEN g.f ELSE '' END AS source_file,
           coalesce(n.title, '') AS title, coalesce({shown}, '') AS content
    FROM w LEFT JOIN g USING (position) LEFT JOIN n ON g.n = 1 AND g.f = n.source_file
    """


def _examined(spark: SparkSession, sf_dir: str, mode: str, **more: int) -> DataFrame:
    asked = spark.createDataFrame(list(enumerate(_ASKED)), "position int, path string")
    return search.examine(asked, views.notes(spark, sf_dir), mode, **more).drop("tags").fillna("")


@query("examine_full", _asked_sql("full_text"))
def examine_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _examined(spark, sf_dir, "full")


@query("examine_slice", _asked_sql("substr(full_text, 6, 30)"))
def examine_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice by bytes, which of these notes is one by characters."""
    return _examined(spark, sf_dir, "slice", offset=5, size=30)


@query(
    "vault_tree",
    f"""WITH {_N}, p AS (SELECT string_split(source_file, '/') AS s FROM n),
    f AS (SELECT s[1:d] AS f, CAST(sum(CASE WHEN d = len(s) - 1 THEN 1 ELSE 0 END) AS BIGINT) AS notes FROM (SELECT s, unnest(range(1, len(s))) AS d FROM p) GROUP BY 1)
    SELECT 0 AS place, '' AS entry, true AS is_dir, 0 AS depth, CAST(sum(CASE WHEN len(s) <= 3 THEN 1 ELSE 0 END) AS BIGINT) AS notes FROM p
    UNION ALL SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY f) AS INTEGER) AS place, array_to_string(f, '/') AS entry, true AS is_dir, CAST(len(f) AS INTEGER) AS depth, notes FROM f WHERE len(f) <= 2 ORDER BY f LIMIT 12)""",
)
def vault_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.limited(views.notes(spark, sf_dir), 2, 12, path="source_file")


@query(
    "vault_tree_files",
    f"""WITH {_N}, p AS (SELECT source_file AS e, string_split(source_file, '/') AS s FROM n WHERE doc_id % 10 = 3),
    d AS (SELECT array_to_string(s[1:k], '/') AS e, list_transform(s[1:k], lambda x: chr(2) || x) AS key, k, CAST(sum(CASE WHEN k = len(s) - 1 THEN 1 ELSE 0 END) AS BIGINT) AS notes FROM (SELECT s, unnest(range(1, len(s))) AS k FROM p) GROUP BY ALL),
    x AS (SELECT e, true AS is_dir, k, notes, key FROM d UNION ALL SELECT e, false, len(s), -1, list_append(list_transform(s[1:len(s) - 1], lambda x: chr(2) || x), chr(1) || s[len(s)]) FROM p)
    SELECT 0 AS place, '' AS entry, true AS is_dir, 0 AS depth, (SELECT count(*) FROM p) AS notes
    UNION ALL SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY key) AS INTEGER) AS place, e, is_dir, CAST(k AS INTEGER), notes FROM x ORDER BY key LIMIT 25)""",
)
def vault_tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With files: a budget of 25 entries, on the notes whose ids end in 3, as a folder of its own."""
    return tree.limited(views.notes(spark, sf_dir).filter("doc_id % 10 = 3"), 5, 25, files=True, path="source_file").fillna(-1, "notes")


@query("upsert_chunks", f"WITH c AS ({views.CHUNKS_SQL}) SELECT note_path, chunk_index, CASE WHEN note_id % 3 = 0 THEN vec_id + 1000000 ELSE vec_id END AS vec_id FROM c WHERE note_id % 3 <> 0 OR chunk_index < 2")
def upsert_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third note's four chunks give way to two new ones."""
    c = views.chunks(spark, sf_dir).select("note_path", "chunk_index", "vec_id", "note_id")
    new = c.filter("note_id % 3 = 0 AND chunk_index < 2").withColumn("vec_id", F.col("vec_id") + 1000000)
    return changes.replace_chunks(c, new, c.filter("note_id % 3 = 0")).drop("note_id")


@query("delete_chunks", f"WITH c AS ({views.CHUNKS_SQL}) SELECT vec_id FROM c WHERE note_id % 4 <> 1")
def delete_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.chunks(spark, sf_dir)
    return changes.delete(c, c.filter("note_id % 4 = 1").select("note_path"), "note_path").select("vec_id")


@query("change_categories", "SELECT CASE doc_id % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'deleted' ELSE 'modified' END AS change, count(*) AS notes FROM documents WHERE doc_id % 4 < 3 GROUP BY 1")
def change_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("content_hash"))
    new = d.withColumn("content_hash", F.when(F.col("doc_id") % 4 == 2, F.lit("changed")).otherwise(F.col("content_hash")))
    return changes.categories(changes.detect(d.filter("doc_id % 4 <> 0"), new.filter("doc_id % 4 <> 1"), "doc_id"))


@query("changed_times", "SELECT doc_id FROM documents WHERE doc_id % 5 >= 3")
def changed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes whose file is new, or more than a second off what was stored."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("double").alias("file_mtime"))
    old = d.filter("doc_id % 5 <> 4").withColumn("file_mtime", F.col("file_mtime") + F.when(F.col("doc_id") % 5 == 3, 1.5).otherwise(0.5))
    return changes.by_time(old, d, "doc_id").select("doc_id")


@query("backups_kept", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 3")
def backups_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest three of each file, here of each user's events."""
    return changes.newest(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 3).select("user_id", "event_id")


@query("tags_json", f"WITH {_N} SELECT doc_id, CAST(to_json(tags) AS VARCHAR) AS json, len(tags) AS tags FROM n")
def tags_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays as JSON, and back."""
    n = views.notes(spark, sf_dir).select("doc_id", F.to_json("tags").alias("json"))
    return n.select("doc_id", "json", F.size(F.from_json("json", "array<string>")).cast("long").alias("tags"))


@query("log_levels", "SELECT event_type, count(*) AS rows FROM events WHERE event_id % 6 >= 3 AND event_id % 6 < 5 GROUP BY event_type")
def log_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows at a level or above."""
    level = F.element_at(F.array(*map(F.lit, ("trace", "DEBUG", "info", "Warn", "error", "other"))), (F.col("event_id") % 6 + 1).cast("int"))
    e = table(spark, sf_dir, "events").filter(predicates.level_at_least(level, "warn"))
    return e.groupBy("event_type").agg(F.count("*").alias("rows"))


@query("search_browse", f"WITH {_N} SELECT doc_id, last_modified FROM n WHERE starts_with(source_file, 'src2/') AND list_contains(tags, 'quality') AND last_modified <= epoch(DATE '2024-01-21') - 1 AND last_modified >= epoch(DATE '2024-01-05') ORDER BY last_modified, source_file LIMIT 25")
def search_browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search without a query: filters, oldest first."""
    from datetime import date

    asked = filters.request(first="2024-01-05", last="2024-01-20", folder="src2", tags=["Quality"], limit=25, today=date(2024, 1, 30))
    return search.run(asked, views.notes(spark, sf_dir), views.chunks(spark, sf_dir), lambda q: [])


@query("api_previews", f"WITH {_N} SELECT doc_id, substr(full_text, 1, 200) AS preview FROM n WHERE list_contains(tags, 'en') ORDER BY last_modified DESC, source_file LIMIT 10")
def api_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.notes(spark, sf_dir).filter(predicates.has_tags(F.col("tags"), ["en"])).orderBy(F.desc("last_modified"), "source_file").limit(10)
    return n.select("doc_id", search.preview(F.col("full_text")).alias("preview"))
