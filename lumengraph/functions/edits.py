"""Note edits as pure functions of text: (text, error), one of them None."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lumengraph.functions import frontmatter, markdown

Edited = tuple[str | None, str | None]
EDITED = "struct<text:string,error:string>"
#: Bytes shown on either side of a place in an error.
AROUND = 20


def _ended(text: str) -> str:
    return text if text.endswith("\n") else text + "\n"


def split_frontmatter(text: str) -> tuple[str, str]:
    """Frontmatter with its fences and a line end, empty without anything between them, and the body."""
    front = frontmatter.parsed(text)
    if front is None:
        return "", text
    inner = "\n".join(front.lines).strip()
    return (f"---\n{inner}\n---\n" if inner else ""), front.rest


def section_by_heading(text: str, heading: str) -> tuple[markdown.Section | None, str | None]:
    """The only section of a title, number signs aside."""
    wanted = heading.lstrip("#").strip()
    found = [s for s in markdown.sections(text) if s.title == wanted]
    if len(found) == 1:
        return found[0], None
    return None, f"found {len(found)} sections" if found else "no such section"


def append(text: str, content: str, heading: str | None = None) -> Edited:
    """At the end, or at that of a section."""
    if heading is None:
        return _ended(_ended(text) + content), None
    s, error = section_by_heading(text, heading)
    if s is None:
        return None, error
    own, rest = text[: s.body] + text[s.body : s.end].rstrip(), text[s.end :]
    return _ended(_ended(own) + content) + ("\n" + rest if rest else ""), None


def prepend(text: str, content: str, heading: str | None = None) -> Edited:
    """After the frontmatter, or right below a heading."""
    if heading is None:
        front, body = split_frontmatter(text)
        body = body.lstrip("\n")
        return _ended(front + content) + (_ended(body) if body else ""), None
    s, error = section_by_heading(text, heading)
    return (None, error) if s is None else (_ended(_ended(text[: s.body]) + content) + text[s.body :], None)


def overwrite(text: str, content: str) -> Edited:
    return _ended(split_frontmatter(text)[0] + content), None


def replace_section(text: str, heading: str, content: str) -> Edited:
    """What stands below a heading up to the next of its level or above; content may repeat the heading's line."""
    s, error = section_by_heading(text, heading)
    if s is None:
        return None, error
    first, newline, below = content.partition("\n")
    if newline and first.lstrip().startswith("#") and first.lstrip().lstrip("#").strip() == heading.lstrip("#").strip():
        content = below
    rest = text[s.end :]
    return _ended(_ended(text[: s.body]) + content) + ("\n" + rest if rest else ""), None


def _once(text: str, wanted: str) -> str | None:
    """Why there isn't exactly one place: places with line, column and what stands around."""
    if not wanted:
        return "nothing to look for"
    at = [m.start() for m in re.finditer(re.escape(wanted), text)]
    if len(at) == 1:
        return None

    def shown(i: int) -> str:
        before = text[:i].encode()[-AROUND:].decode(errors="ignore")
        after = text[i + len(wanted) :].encode()[:AROUND].decode(errors="ignore")
        around = f"{before}{wanted}{after}".replace("\n", "\\n")
        return f"line {text.count(chr(10), 0, i) + 1}, column {i - text.rfind(chr(10), 0, i)}: ...{around}..."

    return f"found {len(at)} times: {'; '.join(map(shown, at))}" if at else "not found"


def replace_text(text: str, old: str, new: str) -> Edited:
    """The only place of ``old`` becomes ``new``."""
    error = _once(text, old)
    return (None, error) if error else (text.replace(old, new), None)


def insert_after(text: str, anchor: str, content: str) -> Edited:
    """Content on lines of its own after the only place of ``anchor``."""
    error = _once(text, anchor)
    if error:
        return None, error
    end = text.index(anchor) + len(anchor)
    head, rest = text[:end], text[end:]
    out = head + ("" if head.endswith("\n") or content.startswith("\n") else "\n") + content
    return out + ("" if out.endswith("\n") or rest.startswith("\n") else "\n") + rest, None


MODES = {"append": append, "prepend": prepend, "overwrite": overwrite, "replace_section": replace_section, "replace_text": replace_text, "insert_after": insert_after}


def edited(mode: str, text: Column, *args: str) -> Column:
    """An edit of a column of notes, as EDITED."""
    change = MODES[mode]

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([change(t or "", *args) for t in texts], columns=["text", "error"])

    return F.pandas_udf(run, EDITED)(text)


def edit_tags(tags: list[str], add: list[str], remove: list[str]) -> list[str]:
    """Removals first, then additions that aren't there."""
    kept = [t for t in tags if t not in remove]
    return kept + [t for t in dict.fromkeys(add) if t not in kept]
