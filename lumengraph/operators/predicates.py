"""Folder, date, tag and fuzzy-path conditions as Columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def folder_prefix(folder: str) -> str:
    """The folder with one slash at its end; an empty name becomes a slash, which no path starts with."""
    return folder if folder.endswith("/") else folder + "/"


def in_folder(path: Column, folder: str | None, recursive: bool = True) -> Column:
    if folder is None:
        return F.lit(True)
    p = folder_prefix(folder)
    inside = path.startswith(p)
    return inside if recursive else inside & ~F.contains(F.substr(path, F.lit(len(p) + 1)), F.lit("/"))


def plain_tag(tag: Column) -> Column:
    """Lower case, without one leading number sign."""
    return F.lower(F.regexp_replace(tag, "^#", ""))


def has_tags(tags: Column, wanted: Sequence[str]) -> Column:
    """All wanted tags, whatever their case or number sign; an empty list matches everything."""
    if not wanted:
        return F.lit(True)
    need = F.array(*(F.lit(t.removeprefix("#").lower()) for t in wanted))
    return F.size(F.array_except(need, F.transform(tags, plain_tag))) == 0


def modified_between(at: Column, low: float | None = None, high: float | None = None) -> Column:
    out = F.lit(True)
    if low is not None:
        out = out & (at >= low)
    return out if high is None else out & (at <= high)


def fuzzy_path(path: Column, wanted: Column, fold: bool = False) -> Column:
    """The path itself or its end after a slash, with or without .md; backslashes count as slashes."""
    p, w = (F.replace(x, F.lit("\\"), F.lit("/")) for x in (path, wanted))
    if fold:
        p, w = F.lower(p), F.lower(w)
    slash = F.lit("/")
    ends = [w, F.concat(w, F.lit(".md"))]
    return (p == ends[0]) | (p == ends[1]) | F.endswith(p, F.concat(slash, ends[0])) | F.endswith(p, F.concat(slash, ends[1]))


def level_at_least(level: Column, least: str, levels: Sequence[str] = ("trace", "debug", "info", "warn", "error")) -> Column:
    """Whether a level stands at ``least`` or after it in the order of levels; an unknown one stands before all."""
    order = F.array(*map(F.lit, levels))
    return F.coalesce(F.array_position(order, F.lower(level)), F.lit(0)) >= list(levels).index(least) + 1


def is_content(breadcrumb: Column, boilerplate: Sequence[str]) -> Column:
    """Whether a chunk's last heading is none of the boilerplate patterns; a chunk without a heading is content."""
    last = F.trim(F.element_at(F.split(breadcrumb, " > "), -1))
    hit = F.lit(False)
    for p in boilerplate:
        hit = hit | last.rlike(p)
    return ~F.contains(breadcrumb, F.lit(" > ")) | (last == "") | ~hit
