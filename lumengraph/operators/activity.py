"""Recent activity over dated entries (entry, title, day, tags)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumengraph.functions import text


def within(entries: DataFrame, first: date, last: date) -> DataFrame:
    return entries.filter(F.col("day").between(F.lit(first), F.lit(last)))


def counts(entries: DataFrame, window: tuple[date, date, date, date]) -> DataFrame:
    """(current, previous): entries of the window and of the one before."""
    a, z, b, y = map(F.lit, window)
    return entries.agg(F.count_if(F.col("day").between(a, z)).alias("current"), F.count_if(F.col("day").between(b, y)).alias("previous"))


def top_tags(entries: DataFrame) -> DataFrame:
    return entries.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("uses")).orderBy(F.desc("uses"), "tag")


def new_tags(entries: DataFrame, first: date, last: date) -> DataFrame:
    """Tags of the window that no earlier entry has."""
    now = within(entries, first, last).select(F.explode("tags").alias("tag")).distinct()
    older = entries.filter(F.col("day") < F.lit(first)).select(F.explode("tags").alias("tag")).distinct()
    return now.join(older, "tag", "left_anti")


def gaps(entries: DataFrame, first: date, last: date, by: Sequence[str] = (), day: str = "day") -> DataFrame:
    """Days of the window without an entry; with ``by``, for each of its values among the entries."""
    days = entries.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day"))
    have = entries.select(*by, F.col(day).alias("day")).filter(F.col("day").between(F.lit(first), F.lit(last))).distinct()
    wanted = entries.select(*by).distinct().join(F.broadcast(days)) if by else days  # the days of a window of 90 at most
    return wanted.join(have, [*by, "day"], "left_anti")


def journal_gaps(entries: DataFrame, first: date, last: date) -> DataFrame:
    """Days of the window that no entry's path is dated; if no path of the window's entries has a date, days without an entry."""
    own = within(entries, first, last).withColumn("dated", text.path_date(F.col("path")))
    mode = own.agg(F.count("dated").alias("n"))  # one row
    days = own.join(F.broadcast(mode)).select(F.when(F.col("n") > 0, F.col("dated")).otherwise(F.col("day")).alias("day"))
    return gaps(days, first, last)


def extremes(entries: DataFrame) -> DataFrame:
    """(longest, longest_words, shortest, shortest_words) by words; ties to the smaller title."""
    return entries.agg(
        F.min_by("title", F.struct(-F.col("words"), "title")).alias("longest"),
        F.max("words").alias("longest_words"),
        F.min_by("title", F.struct("words", "title")).alias("shortest"),
        F.min("words").alias("shortest_words"),
    )


def recent_context(entries: DataFrame, window: tuple[date, date, date, date], limit: int = 10) -> DataFrame:
    """(part, name, value) of a window's activity: entries now and before, tags and new tags, days without one, the longest and
    the shortest, and the latest. ``entries``: path, title, at (seconds), day, tags, words. An empty window has its counts only."""
    now = within(entries, *window[:2])

    def part(name: str, rows: DataFrame, label, value) -> DataFrame:
        return rows.select(F.lit(name).alias("part"), label.cast("string").alias("name"), value.cast("long").alias("value"))

    both, ends = counts(entries, window), extremes(now).filter("longest IS NOT NULL")
    latest = now.orderBy(F.desc("at"), "path").limit(limit)
    out = [
        part("current", both, F.lit(""), F.col("current")),
        part("previous", both, F.lit(""), F.col("previous")),
        part("tag", top_tags(now), F.col("tag"), F.col("uses")),
        part("new_tag", new_tags(entries, *window[:2]), F.col("tag"), F.lit(1)),
        part("gap", journal_gaps(entries, *window[:2]).join(F.broadcast(both.filter("current > 0"))), F.col("day"), F.lit(1)),
        part("longest", ends, F.col("longest"), F.col("longest_words")),
        part("shortest", ends, F.col("shortest"), F.col("shortest_words")),
        part("entry", latest, F.col("path"), F.floor("at")),
    ]
    return reduce(DataFrame.unionByName, out)
