"""The page table: which records count, and their title, body and categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup


def page_titles(pages: DataFrame, column: str = "value") -> DataFrame:
    """Add ``title``; drops rows without a closing title mark."""
    value = F.col(column)
    return pages.where(F.contains(value, F.lit(markup.TITLE_CLOSE))).withColumn(
        "title", markup.extract_between(value, markup.TITLE_OPEN, markup.TITLE_CLOSE)
    )


def eligible_pages(
    pages: DataFrame,
    min_chars: int = 2048,
    require_category: bool = True,
    require_title: bool = False,
    strip_sort_key: bool = False,
    redirect_pattern: str | None = None,
    text_open: str = markup.TEXT_OPEN,
    text_pattern: str | None = None,
) -> DataFrame:
    """``(page_id, title, body, categories)`` of the records worth analysing.

    Drops null records, redirects (the exact ``<redirect />``, or ``redirect_pattern`` for
    dumps that name the target), records without a text block, bodies under ``min_chars``
    UTF-16 units and, if asked, pages without a category or a title. The category regex
    runs only on what the cheaper tests leave.

    The body begins behind ``text_open``, or behind a match of ``text_pattern`` for dumps
    whose text marks vary. Records without that mark are dropped.

    Input without a ``page_id`` gets a generated one. It is fixed for one evaluation only,
    so write the table (``materialize``) before joining it with itself.
    """
    value = F.col("value")
    is_redirect: Column = F.contains(value, F.lit(markup.REDIRECT))
    if redirect_pattern is not None:
        is_redirect = value.rlike(redirect_pattern)
    kept = pages.where(value.isNotNull() & ~is_redirect & F.contains(value, F.lit(markup.TEXT_CLOSE)))
    if require_title:
        kept = kept.where(F.contains(value, F.lit(markup.TITLE_CLOSE)))

    body = markup.extract_between(value, text_open, markup.TEXT_CLOSE)
    if text_pattern is not None:
        block = f"(?s)(?:{text_pattern})(.*?){markup.TEXT_CLOSE}"
        body = F.when(value.rlike(block), F.regexp_extract(value, block, 1))
    long_enough = F.filter(F.array(body), lambda b: markup.at_least_utf16(b, min_chars))
    found = F.transform(
        long_enough,
        lambda b: F.struct(
            b.alias("body"), markup.page_categories(b, strip_sort_key).alias("categories")
        ),
    )
    if require_category:
        found = F.filter(found, lambda p: F.size(p["categories"]) > 0)
    page_id = F.col("page_id") if "page_id" in pages.columns else F.monotonically_increasing_id()
    title = markup.extract_between(value, markup.TITLE_OPEN, markup.TITLE_CLOSE)
    # The generator yields one row or none, and takes body and categories apart only once.
    return kept.select(page_id.alias("page_id"), title.alias("title"), F.inline(found))
