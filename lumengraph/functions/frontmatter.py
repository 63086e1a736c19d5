"""Frontmatter as text: writing it for new notes, setting fields, editing tags. All lines that aren't edited stay as they are."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

_ITEM = re.compile(r"[ \t]*-(?:[ \t]+(.*))?$")


@dataclass(frozen=True)
class Front:
    """The lines between the fences, and what follows the closing one, its line end included."""

    lines: tuple[str, ...]
    rest: str

    def __str__(self) -> str:
        return "\n".join(["---", *self.lines, "---"]) + self.rest


def parsed(text: str) -> Front | None:
    """Opens with --- and closes at the next line that starts with ---; null without."""
    end = text.find("\n---", 3) if text.startswith("---") else -1
    if end < 0:
        return None
    inner = text[3:end].removeprefix("\n")
    return Front(tuple(inner.split("\n")) if inner else (), text[end + 4 :])


def new(title: str, tags: Sequence[str] = (), default_tags: Sequence[str] = (), aliases: Sequence[str] = (), stamp: str | None = None, created: str = "created", modified: str = "modified") -> str:
    """Of a note to be written; a field of an empty name is left out."""
    quoted = title.replace('"', '\\"')
    out = [f'title: "{quoted}"']
    every = [*tags, *(t for t in dict.fromkeys(default_tags) if t not in tags)]
    out += [f"{name}: [{', '.join(values)}]" for name, values in (("aliases", aliases), ("tags", every)) if values]
    out += [f"{name}: {stamp}" for name in (created, modified) if stamp is not None and name]
    return f"{Front(tuple(out), '')}\n"


def with_field(text: str, field: str, value: str, add: bool = True) -> str:
    """Every line of the field gets the value; without one, it is added at the end if ``add`` says so (to a new frontmatter if
    there is none)."""
    front = parsed(text)
    if front is None:
        return f"{Front((f'{field}: {value}',), chr(10) + text)}" if add else text
    hit = [line.lstrip().startswith(f"{field}:") for line in front.lines]
    if not any(hit):
        return str(Front((*front.lines, f"{field}: {value}"), front.rest)) if add else text
    return str(Front(tuple(f"{field}: {value}" if h else line for h, line in zip(hit, front.lines, strict=True)), front.rest))


def _bare(value: str) -> str:
    value = value.strip()
    return value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value


def _tag_lines(front: Front) -> tuple[int, int, list[str]]:
    """First and last line (exclusive) of the tags, and the tags; both ends at the end without them."""
    at = next((i for i, line in enumerate(front.lines) if line.startswith("tags:")), None)
    if at is None:
        return len(front.lines), len(front.lines), []
    inline = front.lines[at][5:].strip()
    if inline:
        inner = inline[1:-1] if inline[0] == "[" and inline[-1] == "]" else inline
        return at, at + 1, [t for t in map(_bare, inner.split(",")) if t]
    end = at + 1
    while end < len(front.lines) and _ITEM.match(front.lines[end]):
        end += 1
    return at, end, [_bare(_ITEM.match(line)[1] or "") for line in front.lines[at + 1 : end]]


def _with_tags(text: str, front: Front, change) -> str:
    a, z, tags = _tag_lines(front)
    tags = change(tags)
    block = ["tags:", *(f"- {t}" for t in tags)] if tags else ["tags: []"]
    return str(Front((*front.lines[:a], *block, *front.lines[z:]), front.rest))


def add_tags(text: str, tags: Sequence[str]) -> str:
    """Tags that aren't there go behind the others, as a list; a note without frontmatter gets one."""
    front = parsed(text)
    if front is None or not "".join(front.lines).strip():
        body = text if front is None else front.rest.removeprefix("\n")
        return str(Front((f"tags: [{', '.join(tags)}]",), "\n" + body))
    return _with_tags(text, front, lambda own: own + [t for t in dict.fromkeys(tags) if t not in own])


def remove_tags(text: str, tags: Sequence[str]) -> str:
    """Exact tags go; a note without frontmatter stays as it is."""
    front = parsed(text)
    if front is None or not "".join(front.lines).strip():
        return text
    return _with_tags(text, front, lambda own: [t for t in own if t not in tags])


@dataclass(frozen=True)
class TagEdit:
    """Counts are of what was asked for."""

    text: str
    added: int
    removed: int
    stamped: bool


def edit_tags(text: str, add: Sequence[str] | None = None, remove: Sequence[str] | None = None, stamp: tuple[str, str] | None = None) -> TagEdit:
    """Removals, then additions, then the time in a field that exists."""
    out = remove_tags(text, remove) if remove is not None else text
    out = add_tags(out, add) if add is not None else out
    out = with_field(out, *stamp, add=False) if stamp else out
    return TagEdit(out, len(add or ()), len(remove or ()), stamp is not None)
