"""Paths of notes: normal forms, guards against leaving the vault, and labels made of them."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of paths below which a folder is kept in step with a remote copy (fixed values).
SYNCED = ("Library/Mobile Documents", "OneDrive", "Dropbox", "Google Drive", "MEGA", "pCloud")


def target(path: Column) -> Column:
    """Slashes for backslashes, and .md at the end."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(F.endswith(p, F.lit(".md")), p).otherwise(F.concat(p, F.lit(".md")))


def stem(path: Column) -> Column:
    """The file's name without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), "(?<=.)[.][^.]*$", "")


def unwrapped(path: Column) -> Column:
    """The target of [[target|alias]], or the path itself, trimmed."""
    p = F.trim(path)
    link = F.regexp_extract(p, "(?s)^\\[\\[(.*)\\]\\]$", 1)
    return F.when(p.rlike("(?s)^\\[\\[.*\\]\\]$"), F.trim(F.element_at(F.split(link, "[|]"), 1))).otherwise(p)


def section(breadcrumb: Column, path: Column | None = None) -> Column:
    """The last part of a breadcrumb, null if empty; null also where it is the note's path, if that is given."""
    last = F.nullif(F.trim(F.element_at(F.split(breadcrumb, " > "), -1)), F.lit(""))
    return last if path is None else F.when(last != path, last)


def ensure_inside(path: str) -> str:
    """The path if it is relative and never goes up."""
    if ".." in re.split(r"[/\\]", path):
        raise ValueError(f"{path!r} leaves the vault")
    if path.startswith(("/", "\\")) or re.match(r"[A-Za-z]:", path):
        raise ValueError(f"{path!r} is absolute")
    return path


def ensure_really_inside(path: str, root: str) -> str:
    """The path if it stays below ``root`` once links are followed, as far as it exists."""
    real, base = os.path.realpath(path), os.path.realpath(root)
    if os.path.commonpath([real, base]) != base:
        raise ValueError(f"{path!r} leads out of {root!r}")
    return path


def is_synced(path: str) -> bool:
    return any(part in path for part in SYNCED)
