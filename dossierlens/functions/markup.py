"""Column functions over page markup. All of them are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rows import let

# Marks of the dump format.
TEXT_OPEN = '<text xml:space="preserve">'
TEXT_CLOSE = "</text>"
TITLE_OPEN = "<title>"
TITLE_CLOSE = "</title>"
REDIRECT = "<redirect />"

_CATEGORY_SPAN = r"(?s)\[\[Category:(?=(.*?)\]\])"
_EDGE_CONTROLS = r"^[\x00-\x20]+|[\x00-\x20]+$"


def extract_between(text: Column, start: str, end: str) -> Column:
    """Text between the first ``start`` and the next ``end``; null if either is absent."""

    def up_to_end(rest: Column) -> Column:
        return F.when(F.contains(rest, F.lit(end)), F.substring_index(rest, end, 1))

    def behind_start(whole: Column) -> Column:
        at = F.locate(start, whole)
        return F.when(at > 0, F.substr(whole, at + F.lit(len(start))))

    return let(let(text, behind_start), up_to_end)


def at_least_utf16(text: Column, n: int) -> Column:
    """Whether ``text`` has at least ``n`` UTF-16 units.

    A code point is one or two units, so the encoding is only looked at when the
    count of code points leaves the answer open.
    """
    points = F.length(text)
    return (
        F.when(points >= n, True)
        .when(points * 2 < n, False)
        .otherwise(F.octet_length(F.encode(text, "UTF-16BE")) >= 2 * n)
    )


def normalize_category(name: Column) -> Column:
    """Upper case, no control characters or blanks at the edges, single blanks inside."""
    return F.regexp_replace(F.regexp_replace(F.upper(name), _EDGE_CONTROLS, ""), r"\s+", " ")


def page_categories(body: Column, strip_sort_key: bool = False) -> Column:
    """Normalised category names of a page body, in order and with duplicates.

    The look-ahead leaves the scan just behind each opening mark, so a mark nested in
    another yields two names. ``|sort key`` stays part of the name unless asked otherwise.
    """
    spans = F.regexp_extract_all(body, F.lit(_CATEGORY_SPAN), F.lit(1))
    if strip_sort_key:
        return F.transform(spans, lambda c: normalize_category(F.substring_index(c, "|", 1)))
    return F.transform(spans, normalize_category)
