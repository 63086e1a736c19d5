"""Creating and editing notes in a vault, with backups, and finding the note that a path means. Driver-side, one note at a time."""

from __future__ import annotations

import os
import re
import shutil
from dataclasses import dataclass, field
from datetime import datetime, timezone
from pathlib import Path

from lumengraph.functions import dates, edits, frontmatter, paths


@dataclass
class Settings:
    """How notes get times and tags, and which edits are backed up."""

    stamps: bool = True
    form: str = "iso8601"
    zone: str = "UTC"
    created: str = "created"
    modified: str = "modified"
    default_tags: list[str] = field(default_factory=list)
    backups: int = 5
    #: Edits that can lose text.
    destructive: tuple[str, ...] = ("overwrite", "replace_section", "replace_text")


class Writer:
    """Notes below ``root``; backups go to ``store``/backups."""

    def __init__(self, root: str, store: str, settings: Settings | None = None, now=lambda: datetime.now(timezone.utc)):
        self.root, self.store, self.settings, self.now = Path(root), Path(store), settings or Settings(), now

    def _stamp(self) -> str | None:
        return dates.stamp(self.now(), self.settings.form, self.settings.zone) if self.settings.stamps else None

    def create(self, target: str, content: str, tags: list[str] | None = None, aliases: list[str] | None = None) -> str:
        """Write a new note with frontmatter; its path."""
        if not content:
            raise ValueError("no content")
        rel = target.replace("\\", "/")
        rel = paths.ensure_inside(rel if rel.endswith(".md") else f"{rel}.md")
        path = self.root / rel
        if path.exists():
            raise FileExistsError(rel)
        paths.ensure_really_inside(str(path), str(self.root))
        path.parent.mkdir(parents=True, exist_ok=True)
        s = self.settings
        front = frontmatter.new(path.stem, tags or [], s.default_tags, aliases or [], self._stamp(), s.created, s.modified)
        path.write_text(front + content, "utf-8")
        return rel

    def resolve(self, target: str) -> str:
        """The path of the only note that ``target`` means: a file as named or with .md, else a fuzzy match of whole path ends, whatever the case."""
        wanted = re.sub(r"^\[\[|\]\]$", "", target.strip()).split("|")[0].strip().replace("\\", "/")
        paths.ensure_inside(wanted)
        for rel in (wanted, f"{wanted}.md"):
            if (self.root / rel).is_file():
                return rel
        ends = {w.lower() for w in (wanted, f"{wanted}.md")}
        hits = []
        for folder, _, names in os.walk(self.root):
            for name in names:
                rel = Path(folder, name).relative_to(self.root).as_posix()
                if name.endswith(".md") and any(rel.lower() == e or rel.lower().endswith("/" + e) for e in ends):
                    hits.append(rel)
        if len(hits) != 1:
            raise LookupError(f"{target!r}: {len(hits)} notes: {', '.join(sorted(hits))}" if hits else f"{target!r}: no such note")
        return hits[0]

    def edit(self, target: str, mode: str, *args: str) -> tuple[str, str | None]:
        """Apply one of ``edits.MODES``; (path, backup or None)."""
        rel = self.resolve(target)
        path = self.root / rel
        paths.ensure_really_inside(str(path), str(self.root))
        text, error = edits.MODES[mode](path.read_text("utf-8"), *args)
        if error:
            raise ValueError(error)
        kept = self.backup(path) if mode in self.settings.destructive and self.settings.backups else None
        self._write(path, text)
        return rel, kept

    def edit_tags(self, target: str, add: list[str] | None = None, remove: list[str] | None = None) -> tuple[str, frontmatter.TagEdit]:
        rel = self.resolve(target)
        path = self.root / rel
        out = frontmatter.edit_tags(path.read_text("utf-8"), add, remove)
        self._write(path, out.text)
        return rel, out

    def _write(self, path: Path, text: str) -> None:
        """With the time of the change, where the note has a field for it."""
        stamp = self._stamp()
        if stamp and self.settings.modified:
            text = frontmatter.with_field(text, self.settings.modified, stamp, add=False)
        path.write_text(text, "utf-8")

    def backup(self, path: Path) -> str:
        """A copy named by time; of a file name the newest so many stay."""
        folder = self.store / "backups"
        folder.mkdir(parents=True, exist_ok=True)
        to = folder / f"{self.now():%Y%m%dT%H%M%S}_{path.name}"
        shutil.copy2(path, to)
        own = sorted(p for p in folder.iterdir() if re.fullmatch(r"\d{8}T\d{6}_" + re.escape(path.name), p.name))
        for old in own[: -self.settings.backups]:
            old.unlink()
        return str(to)
