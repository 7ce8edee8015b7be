"""Column functions on keys and marked-up text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_key(key: Column) -> Column:
    """Whether a key is a relative path that stays in its folder: no empty, `.` or `..` segment, no backslash. Null is not safe."""
    parts = F.split(key, "/")
    bad = F.contains(key, F.lit("\\")) | F.array_contains(parts, "") | F.array_contains(parts, ".") | F.array_contains(parts, "..")
    return F.coalesce(~bad, F.lit(False))


def between(text: Column, start: str, end: str, what: str = "marker") -> Column:
    """What stands between the first start and the first end after it (a start may recur in it); an error names what is missing, without the text."""
    at = F.locate(start, text)
    rest = F.substring(text, at + len(start), F.length(text))
    till = F.locate(end, rest)
    return F.when((at > 0) & (till > 0), F.substring(rest, F.lit(1), till - 1)).when(text.isNotNull(), F.raise_error(F.lit(f"no {what} between its marks")))


def numbered(prefix: str, number: Column) -> Column:
    """A key of a prefix and a number, such as `row-7`; null without a number."""
    return F.concat(F.lit(prefix), number.cast("string"))


def article(doc_id: Column, lang: Column, title: Column, body: Column) -> Column:
    """An HTML article with its id and language as attributes."""
    return F.format_string('<article data-id="%s" data-lang="%s">\n  <h1>%s</h1>\n  <p>%s</p>\n</article>\n', doc_id, lang, title, body)


def normalized(text: Column) -> Column:
    """Lower case, with runs of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
