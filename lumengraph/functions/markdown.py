"""Markdown: a scanner of headings, plain text, and chunks of notes."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lumengraph.functions.text import DATED_LINE, LIST_MARKER, WIKILINK

CHUNK = "array<struct<chunk_index:int,breadcrumb:string,content:string,links:array<struct<target:string,alias:string>>>>"
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_LINK = re.compile(WIKILINK)
_MARKER = re.compile(f"(?m){LIST_MARKER}")
_DATED = re.compile(DATED_LINE)


@dataclass(frozen=True)
class Section:
    """A heading: level, title, where it starts, where its body starts, and ends before the next of its level or above."""

    level: int
    title: str
    start: int
    body: int
    end: int


def sections(text: str) -> list[Section]:
    """ATX and underlined headings outside fenced code."""
    found: list[tuple[int, str, int, int]] = []
    fence, at, before = "", 0, ("", 0)
    for line in text.splitlines(keepends=True):
        bare, start = line.rstrip("\r\n"), at
        at += len(line)
        mark = _FENCE.match(bare)
        if fence:
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not bare.strip().strip(fence[0]):
                fence = ""
            before = "", start
        elif mark:
            fence, before = mark[1], ("", start)
        elif m := _ATX.match(bare):
            found.append((len(m[1]), (m[2] or "").strip(), start, at))
            before = "", start
        elif before[0].strip() and (m := _UNDERLINE.match(bare)):
            found.append((1 if m[1][0] == "=" else 2, before[0].strip(), before[1], at))
            before = "", start
        else:
            before = bare, start
    return [Section(level, title, start, body, next((s for k, _, s, _ in found[i + 1 :] if k <= level), len(text))) for i, (level, title, start, body) in enumerate(found)]


def plain(text: str) -> str:
    """Links by their text, without emphasis, code marks and list markers; wikilinks stay."""
    text = re.sub(r"!?\[([^\]\[]*)\]\([^)]*\)", r"\1", text)
    text = re.sub(r"(?m)^ {0,3}(?:```|~~~).*\n?", "", text)
    text = re.sub(r"(?m)^\s*(?:[-*+] |\d+[.)] |> ?)", "", text)
    return re.sub(r"(\*\*|__|\*|`)(\S(?:.*?\S)?)\1", r"\2", text).strip()


def shown(text: str) -> str:
    """Wikilinks by alias, else target."""
    return _LINK.sub(lambda m: (m[2] or m[1]).strip(), text)


def links(text: str) -> list[tuple[str, str | None]]:
    return [(m[1].strip(), m[2].strip() or None) for m in _LINK.finditer(text)]


def is_changelog(text: str) -> bool:
    """At least 80 of 100 lines that hold something start with a date, a list marker aside."""
    lines = [x for x in text.splitlines() if x.strip()]
    return bool(lines) and 100 * sum(bool(_DATED.match(_MARKER.sub("", x))) for x in lines) >= 80 * len(lines)


def prose_chars(text: str) -> int:
    """Characters that aren't white space, without links and list markers."""
    return len(re.sub(r"\s", "", _MARKER.sub("", re.sub(r"\[\[[^\]]*\]\]", "", text))))


def paragraphs(text: str) -> list[str]:
    """Runs of lines between empty ones; fenced code is never cut."""
    out, held, fenced = [], [], False
    for line in text.split("\n"):
        if line.lstrip().startswith("```"):
            fenced = not fenced
        elif not fenced and not line.strip():
            out.append("\n".join(held).strip())
            held = []
            continue
        held.append(line)
    out.append("\n".join(held).strip())
    return [p for p in out if p]


def _tail(text: str, size: int) -> str:
    """The last ``size`` bytes, and what a character that they cut has before them."""
    raw = text.encode()
    at = max(0, len(raw) - size)
    while at and raw[at : at + 1] and raw[at] & 0xC0 == 0x80:
        at -= 1
    return raw[at:].decode()


def split_large(content: str, size: int, overlap: int) -> list[str]:
    """Paragraphs packed up to ``size`` bytes, each part after the first led by the last ``overlap`` bytes before it."""
    out, held = [], ""
    for p in paragraphs(content):
        if held and len(held.encode()) + len(p.encode()) > size:
            out.append(held.strip())
            held = _tail(held, overlap).strip() + "\n\n"
        held += p + "\n\n"
    return [*out, held.strip()] if held.strip() else out


Chunk = tuple[int, str, str, list[tuple[str, str | None]]]


def chunks(text: str, path: str, size: int = 1500, overlap: int = 100, least: int = 20) -> list[Chunk]:
    """(index, breadcrumb, content, links) of the preamble and every section's own text, breadcrumbs from the path on. Sections of
    little prose and changelogs are left out, and so are their links."""
    found = sections(text)
    parts = [(path, text[: found[0].start] if found else text)]
    stack: list[Section] = []
    for i, s in enumerate(found):
        stack = [x for x in stack if x.level < s.level] + [s]
        nxt = found[i + 1].start if i + 1 < len(found) else len(text)
        parts.append((" > ".join([path, *(x.title for x in stack)]), text[s.body : nxt]))
    out: list[Chunk] = []
    for crumb, raw in parts:
        body = plain(raw)
        if not body or prose_chars(body) < least or is_changelog(body):
            continue
        cut = [body] if len(body.encode()) <= size else split_large(body, size, overlap)
        out += [(len(out) + k, crumb, shown(c), links(c)) for k, c in enumerate(cut)]
    return out


def _chunk_rows(text: pd.Series, path: pd.Series) -> pd.Series:
    rows = ([(i, b, c, own) for i, b, c, own in chunks(t or "", p or "")] for t, p in zip(text, path, strict=True))
    return pd.Series([[{"chunk_index": i, "breadcrumb": b, "content": c, "links": [{"target": t, "alias": a} for t, a in own]} for i, b, c, own in r] for r in rows])


def chunk_column(text: Column, path: Column) -> Column:
    """Chunks of a note, to be exploded."""
    return F.pandas_udf(_chunk_rows, CHUNK)(text, path)
