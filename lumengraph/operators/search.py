"""Searches and browses as a whole: modes, filters before the ranking, what is shown of a hit; looking notes up by path."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumengraph.functions import text
from lumengraph.operators import fulltext, vectors
from lumengraph.operators.filters import Filters, Request

#: Bytes of a note that a full-text hit shows, of a summary, and characters of a preview.
SNIPPET, SUMMARY, PREVIEW = 500, 500, 200


def snippets(documents: DataFrame) -> DataFrame:
    """With breadcrumb (the title), content (the note's start with links by their text), and links (target, alias) of it."""
    start = text.first_bytes(F.col("full_text"), SNIPPET)
    return documents.withColumns({"breadcrumb": F.col("title"), "content": text.without_wikilinks(start), "links": text.wikilinks(start)})


def preview(content: Column) -> Column:
    return F.substring(content, 1, PREVIEW)


def run(
    asked: Request, documents: DataFrame, chunks: DataFrame, embed: Callable[[str], Sequence[float]], index: fulltext.Index | None = None, key: str = "doc_id", overfetch: int | None = None
) -> DataFrame:
    """(key, score) of a search, or (key, last_modified) of a browse, oldest first. ``documents`` (key, source_file, tags,
    last_modified, full_text), ``chunks`` (key, vec_id, vector). A vector hit's score is its distance. Filters come before the
    ranking, so that as many hits return as there are; with ``overfetch`` they come after it, on so many times the limit."""
    able = asked.filters.of(documents)
    if overfetch and asked.query is not None and asked.filters:
        wide = replace(asked, filters=Filters(), limit=asked.limit * overfetch)
        hits = run(wide, documents, chunks, embed, index, key).join(able.select(key), key, "left_semi")
        return hits.orderBy("score" if asked.mode == "vector" else F.desc("score"), key).limit(asked.limit)
    if asked.query is None:
        return able.orderBy("last_modified", "source_file").limit(asked.limit).select(key, "last_modified")
    wide = 2 * asked.limit if asked.mode == "hybrid" else asked.limit
    kept = able.select(key) if asked.filters else None
    near = found = None
    if asked.mode != "fts":
        own = chunks if kept is None else chunks.join(kept, key, "left_semi")
        near = vectors.topk(own, vectors.literal(embed(asked.query)), wide).select(key, "distance")
    if asked.mode != "vector":
        terms = fulltext.words(asked.query)
        scored = fulltext.bm25(documents, terms, key) if index is None else index.bm25(terms)
        found = fulltext.ranked(scored if kept is None else scored.join(kept, key, "left_semi"), wide, key)
    if asked.mode == "vector":
        return near.withColumnRenamed("distance", "score")
    if asked.mode == "fts":
        return found.select(key, F.col("rank_score").alias("score"))
    return fulltext.fuse(near, found, asked.limit, key)


def path_matches(wanted: DataFrame, documents: DataFrame) -> DataFrame:
    """(position, source_file) of asked (position, path): notes whose path is the asked one or ends in it after a slash, with or without
    .md, whatever the case; backslashes count as slashes. A note is joined by every end of its path."""
    asked = F.lower(F.replace("path", F.lit("\\"), F.lit("/")))
    forms = wanted.select("position", F.explode(F.array(asked, F.concat(asked, F.lit(".md")))).alias("end"))
    parts = F.split(F.lower(F.replace("source_file", F.lit("\\"), F.lit("/"))), "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    return documents.select("source_file", F.explode(ends).alias("end")).join(forms, "end").select("position", "source_file").distinct()


def found_by_path(wanted: DataFrame, documents: DataFrame) -> DataFrame:
    """(position, path, status, source_file) of asked (position, path): the exact path first, else the only note whose path fuzzily
    matches; status: found, ambiguous or not found."""
    exact = wanted.join(documents.select("source_file"), F.col("path") == F.col("source_file")).select("position", "source_file")
    open_ = wanted.join(exact.select("position"), "position", "left_anti")
    hits = exact.union(path_matches(open_, documents)).groupBy("position").agg(F.count("*").alias("n"), F.min("source_file").alias("source_file"))
    status = F.when(F.col("n") == 1, "found").when(F.col("n") > 1, "ambiguous").otherwise("not found")
    return wanted.join(hits, "position", "left").select("position", "path", status.alias("status"), F.when(F.col("n") == 1, F.col("source_file")).alias("source_file"))


def shown(content: Column, mode: str, offset: int = 0, size: int = SUMMARY) -> Column:
    """A note's text for a summary, in full, or a slice of its bytes."""
    if mode == "full":
        return content
    return text.truncated(content, SUMMARY) if mode == "summary" else text.byte_slice(content, offset, size)


def examine(wanted: DataFrame, documents: DataFrame, mode: str = "summary", offset: int = 0, size: int = SUMMARY) -> DataFrame:
    """(position, status, source_file, title, tags, content) of asked (position, path), in what order they were asked."""
    out = found_by_path(wanted, documents).join(documents.select("source_file", "title", "tags", "full_text"), "source_file", "left")
    return out.select("position", "status", "source_file", "title", "tags", shown(F.col("full_text"), mode, offset, size).alias("content"))
