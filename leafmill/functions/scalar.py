"""Column functions: strings, dates, numbers, JSON, arrays, maps, and text taken from markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The dot product of two number arrays, in double precision."""
    parts = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def bag_of_words(text: Column) -> Column:
    """Words of [a-z]+ of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1))


def markup_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def markdown_text(text: Column) -> Column:
    """Plain text of Markdown: fences, marks and link targets go, words stay."""
    for pattern, to in ((r"(?m)^\s*(```|~~~).*$", ""), (r"!?\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?m)^\s{0,3}(#{1,6}|>|[-*+]|\d+\.)\s+", ""), (r"(\*\*|__|\*|`)", "")):
        text = F.regexp_replace(text, pattern, to)
    return text
