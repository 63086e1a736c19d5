"""Text functions over notes as Columns: frontmatter, wikilinks, prose measures, cuts by bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FRONTMATTER = "(?s)^---(.*?)\\n---(.*)$"
# What a link looks like: target, part, alias (fixed value).
WIKILINK = "\\[\\[([^\\]|#]+)(?:#[^\\]|]*)?\\|?([^\\]]*)\\]\\]"
LIST_MARKER = "^\\s*([-*] |\\d+[.)] )"
DATED_LINE = "^(\\[\\[)?\\d{4}-\\d{2}-\\d{2}"


def frontmatter(text: Column) -> Column:
    """Between the opening --- and the next line that starts with ---, trimmed; null without one."""
    return F.when(text.rlike(FRONTMATTER), F.trim(F.regexp_replace(F.regexp_extract(text, FRONTMATTER, 1), "^\\s+|\\s+$", "")))


def body(text: Column) -> Column:
    """What follows the frontmatter."""
    return F.when(text.rlike(FRONTMATTER), F.regexp_extract(text, FRONTMATTER, 2)).otherwise(text)


def title(text: Column, path: Column) -> Column:
    """The first line's # heading, blank lines and lower headings before it passed over; else the file's stem."""
    lead = F.regexp_extract(text, "^(?:[ \\t]*\\n|##[^\\n]*\\n)*# ([^\\n]*)", 1)
    return F.when(F.trim(lead) != "", F.trim(lead)).otherwise(F.regexp_extract(path, "([^/]+?)(?:[.]md)?$", 1))


def tags(front: Column) -> Column:
    """Of ``tags: [a, "b"]`` or ``tags: a, b`` in a frontmatter, or of the list of items below it."""
    inline = F.regexp_extract(front, "(?m)^tags:[ \\t]*(\\S[^\\n]*)$", 1)
    items = F.regexp_extract(front, "(?m)^tags:[ \\t]*\\n((?:[ \\t]*- [^\\n]*\\n?)*)", 1)
    one = F.split(F.regexp_replace(inline, "^\\[|\\]$", ""), ",")
    many = F.transform(F.filter(F.split(items, "\\n"), lambda x: F.trim(x) != ""), lambda x: F.regexp_replace(x, "^[ \\t]*- ", ""))
    found = F.transform(F.when(inline != "", one).otherwise(many), lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", ""))
    return F.filter(found, lambda x: x != "")


def date_field(front: Column, field: str) -> Column:
    """Epoch seconds of a field that holds a date, or a date and time, UTC; null if it holds neither."""
    raw = F.regexp_replace(F.regexp_extract(front, f"(?m)^{field}:[ \\t]*([^\\n]+)$", 1), "^[\"' ]+|[\"' ]+$", "")
    return F.unix_timestamp(F.try_to_timestamp(F.when(raw != "", raw))).cast("double")


def wikilinks(text: Column) -> Column:
    """(target, alias) of every [[target#part|alias]]; an alias may be null."""
    targets, aliases = (F.regexp_extract_all(text, F.lit(WIKILINK), F.lit(i)) for i in (1, 2))
    return F.zip_with(targets, aliases, lambda t, a: F.struct(F.trim(t).alias("target"), F.nullif(F.trim(a), F.lit("")).alias("alias")))


def without_wikilinks(text: Column) -> Column:
    """Each link by its alias, else its target."""
    aliased = F.regexp_replace(text, "\\[\\[[^\\]|#]+(?:#[^\\]|]*)?\\|\\s*([^\\]]*?[^\\]\\s])\\s*\\]\\]", "$1")
    return F.regexp_replace(aliased, "\\[\\[\\s*([^\\]|#]*?[^\\]|#\\s])\\s*(?:#[^\\]|]*)?\\|?\\s*\\]\\]", "$1")


def word_count(text: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), "^\\s+|\\s+$", "")
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, "\\s+"))).cast("long")


def prose_chars(text: Column) -> Column:
    """Characters that aren't white space, without links and list markers."""
    bare = F.regexp_replace(F.regexp_replace(text, "\\[\\[[^\\]]*\\]\\]", ""), "(?m)" + LIST_MARKER, "")
    return F.length(F.regexp_replace(bare, "\\s", "")).cast("long")


def is_changelog(text: Column) -> Column:
    """Whether at least 80 of 100 lines that hold something start with a date, a list marker and link brackets aside."""
    lines = F.filter(F.split(text, "\\n"), lambda x: F.trim(x) != "")
    dated = F.filter(lines, lambda x: F.regexp_replace(x, LIST_MARKER, "").rlike(DATED_LINE))
    return (F.size(lines) > 0) & (F.size(dated) * 100 >= F.size(lines) * 80)


def first_bytes(text: Column, size: int) -> Column:
    """The first ``size`` bytes, without a part of a character at the end; shorter texts as they are."""
    cut = F.substring(F.encode(text, "UTF-8"), 1, size + 1)
    whole = F.regexp_replace(F.hex(cut), "^((?:..)*?)(?:[CDEF].(?:[89AB].)*|..)$", "$1")
    return F.when(F.octet_length(text) <= size, text).otherwise(F.unhex(whole).cast("string"))


def truncated(text: Column, size: int) -> Column:
    """``first_bytes`` and an ellipsis; shorter texts as they are."""
    return F.when(F.octet_length(text) <= size, text).otherwise(F.concat(first_bytes(text, size), F.lit("...")))


def byte_slice(text: Column, offset: int, size: int) -> Column:
    """Bytes from an offset on; a character that an end cuts belongs to what follows that end."""
    low, high = (F.octet_length(first_bytes(text, n)) for n in (offset, offset + size))
    return F.substring(F.encode(text, "UTF-8"), low + 1, F.greatest(high - low, F.lit(0))).cast("string")


def path_date(path: Column) -> Column:
    """The first run of ten digits and dashes in a path that is a date."""
    runs = F.filter(F.split(path, "[^0-9-]+"), lambda x: F.length(x) == 10)
    return F.get(F.filter(F.transform(runs, lambda x: F.try_to_date(x, "yyyy-MM-dd")), lambda d: d.isNotNull()), F.lit(0))


def day(seconds: Column) -> Column:
    """The UTC day of epoch seconds, as text."""
    return F.date_format(F.timestamp_seconds(F.floor(seconds).cast("long")), "yyyy-MM-dd")
