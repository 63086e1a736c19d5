"""Dates in words, with today given."""

from __future__ import annotations

import calendar
import re
from datetime import date, datetime, time, timedelta, timezone
from zoneinfo import ZoneInfo

# Month names in English and Polish (fixed values).
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "styczniu": 1, "lutym": 2, "marcu": 3, "kwietniu": 4, "maju": 5, "czerwcu": 6, "lipcu": 7, "sierpniu": 8, "wrześniu": 9, "październiku": 10, "listopadzie": 11, "grudniu": 12,
}
TODAY, YESTERDAY = ("today", "dzisiaj", "dziś"), ("yesterday", "wczoraj")


def _month(year: int, month: int, end: bool) -> date:
    return date(year, month, calendar.monthrange(year, month)[1] if end else 1)


def parse_date(text: str, end: bool, today: date) -> date:
    """The first day that a phrase means, or the last if ``end``: an ISO day or month, today, yesterday, last week, month or
    year, or "in" a month (the latest that isn't ahead)."""
    t = text.strip().lower()
    if m := re.fullmatch(r"(\d{4})-(\d{2})-(\d{2})", t):
        return date(*map(int, m.groups()))
    if m := re.fullmatch(r"(\d{4})-(\d{2})", t):
        return _month(int(m[1]), int(m[2]), end)
    if t in TODAY:
        return today
    if t in YESTERDAY:
        return today - timedelta(days=1)
    if t in ("last week", "zeszły tydzień", "w zeszłym tygodniu"):
        monday = today - timedelta(days=today.weekday() + 7)
        return monday + timedelta(days=6) if end else monday
    if t in ("last month", "zeszły miesiąc", "w zeszłym miesiącu"):
        before = today.replace(day=1) - timedelta(days=1)
        return before if end else before.replace(day=1)
    if t in ("last year", "zeszły rok", "w zeszłym roku"):
        return date(today.year - 1, 12, 31) if end else date(today.year - 1, 1, 1)
    if (m := re.fullmatch(r"(?:in|w|we) (\w+)", t)) and m[1] in MONTHS:
        month = MONTHS[m[1]]
        return _month(today.year if month <= today.month else today.year - 1, month, end)
    raise ValueError(f"not a date: {text!r}")


def recent(days: int, today: date) -> tuple[date, date, date, date]:
    """First and last day of the window that ends today, and of the one before it; 1 to 90 days."""
    if not 1 <= days <= 90:
        raise ValueError("1 to 90 days")
    first = today - timedelta(days=days - 1)
    return first, today, first - timedelta(days=days), first - timedelta(days=1)


def bounds(first: str | None, last: str | None, today: date) -> tuple[float | None, float | None]:
    """Epoch seconds, UTC, of the first day's start and the last day's last second; with a first day only, up to today."""
    a = parse_date(first, False, today) if first else None
    z = parse_date(last, True, today) if last else (today if a else None)
    if a and z and a > z:
        raise ValueError(f"{a} is after {z}")
    low = datetime.combine(a, time(), timezone.utc).timestamp() if a else None
    return low, datetime.combine(z, time(23, 59, 59), timezone.utc).timestamp() if z else None


# Named forms of a time (fixed values).
STAMPS = {"iso8601": "%Y-%m-%dT%H:%M:%S", "date_only": "%Y-%m-%d", "obsidian": "%Y-%m-%d %H:%M"}


def stamp(now: datetime, form: str = "iso8601", zone: str = "UTC") -> str:
    """A time in a named form or one of strftime's, in a zone, or "local"."""
    at = now.astimezone(None if zone == "local" else ZoneInfo(zone))
    return at.strftime(STAMPS.get(form, form))
