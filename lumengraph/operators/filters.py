"""Conditions on documents as one value, and what a search or a browse asks for."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumengraph.functions import dates
from lumengraph.operators import predicates


@dataclass(frozen=True)
class Filters:
    """Folder, time of change and tags; what is None or empty doesn't restrict."""

    folder: str | None = None
    low: float | None = None
    high: float | None = None
    tags: tuple[str, ...] = ()
    recursive: bool = True

    def __bool__(self) -> bool:
        return self.folder is not None or self.low is not None or self.high is not None or bool(self.tags)

    def column(self, path: str = "source_file", at: str = "last_modified", tags: str = "tags") -> Column:
        inside = predicates.in_folder(F.col(path), self.folder, self.recursive)
        return inside & predicates.modified_between(F.col(at), self.low, self.high) & predicates.has_tags(F.col(tags), self.tags)

    def of(self, documents: DataFrame) -> DataFrame:
        return documents.filter(self.column())


@dataclass(frozen=True)
class Request:
    """A search (with a query), or a browse (without)."""

    query: str | None
    mode: str
    filters: Filters
    limit: int


def request(query: str | None = None, *, mode: str | None = None, first: str | None = None, last: str | None = None, folder: str | None = None, tags: Sequence[str] = (), limit: int = 10, today: date) -> Request:
    """Dates in words become bounds; an unknown mode is hybrid; a query, or one filter that restricts, is needed."""
    if query is None and not (first or last or folder is not None or tags):
        raise ValueError("a query or a filter is needed")
    low, high = dates.bounds(first, last, today)
    return Request(query, mode if mode in ("vector", "fts") else "hybrid", Filters(folder, low, high, tuple(tags)), limit)
