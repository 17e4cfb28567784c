"""Pages of a wiki dump."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.markup import TEXT_CLOSE, TEXT_OPEN
from ..functions.rows import computed_once
from .delimited import read_delimited

# Page marks of the dump format.
PAGE_OPEN = "\n  <page>"
PAGE_CLOSE = "\n  </page>"


def read_wiki_pages(
    spark: SparkSession,
    path: str | list[str],
    max_bytes: int | None = None,
    text_open: str = TEXT_OPEN,
) -> DataFrame:
    """Read ``(value)``: one page per row, metadata first and the last text block behind it.

    A page with several revisions keeps the text of its last one. Entities stay escaped.
    ``text_open`` is the mark in front of a text.
    """
    pages = read_delimited(spark, path, PAGE_OPEN, PAGE_CLOSE, max_bytes)
    value = F.col("value")
    last_block = F.concat(
        F.lit("\n      " + text_open),
        F.substring_index(F.substring_index(value, text_open, -1), TEXT_CLOSE, 1),
        F.lit(TEXT_CLOSE + PAGE_CLOSE),
    )
    metadata = F.substring_index(F.regexp_replace(value, rf"(?s)\s*\Q{text_open}\E.*?{TEXT_CLOSE}", ""), PAGE_CLOSE, 1)
    several = F.contains(
        F.substr(value, F.locate(text_open, value) + F.lit(len(text_open))), F.lit(text_open)
    )
    moved = F.when((F.locate(text_open, value) > 0) & several, F.concat(metadata, last_block))
    return pages.select(computed_once(F.coalesce(moved, value)).alias("value"))
