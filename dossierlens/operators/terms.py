"""Words of texts as tables, and the stemming of a vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.english import stems
from ..functions.words import word_counts, words

MIN_TERM_FREQ = 2
"""Fixed value: the default of the "more like this" query."""


def tokenize(texts: DataFrame, id: str, text: str, apostrophes: bool = False, forms: bool = False) -> DataFrame:
    """``(id, pos, term)``: the lower-cased words of each text, counted from 0."""
    return texts.select(id, F.posexplode(words(F.col(text), apostrophes, forms=forms)).alias("pos", "term"))


def term_counts(
    texts: DataFrame,
    id: str,
    text: str,
    apostrophes: bool = False,
    max_words: int | None = None,
    min_count: int = 1,
    forms: bool = False,
) -> DataFrame:
    """``(id, term, tf)``: how often each word occurs in each text. Needs no shuffle."""
    found = words(F.col(text), apostrophes, max_words, forms)
    return texts.select(id, F.inline(word_counts(found, min_count)))


def counted_pages(
    pages: DataFrame,
    stem: bool = True,
    apostrophes: bool = False,
    forms: bool | None = None,
    max_words: int | None = None,
    min_term_freq: int = MIN_TERM_FREQ,
) -> DataFrame:
    """``pages`` with ``counts`` in place of ``body``: all that ``query_terms`` asks of a text, for an index of the
    same ``stem``, ``apostrophes`` and ``forms`` and the same choice of terms.

    Counts of words that are asked for as they stand leave out those below ``min_term_freq``, and take a
    fraction of the text's room; the words of one stem are summed later, so theirs are whole.
    """
    forms = not apostrophes if forms is None else forms
    counts = word_counts(words(F.col("body"), apostrophes, max_words, forms), 1 if stem else min_term_freq)
    return pages.select(*(counts.alias("counts") if c == "body" else c for c in pages.columns))


def vocabulary(texts: DataFrame, text: str, apostrophes: bool = False, forms: bool = False) -> DataFrame:
    """``(term)``: the distinct words of all texts."""
    return texts.select(
        F.explode(F.array_distinct(words(F.col(text), apostrophes, forms=forms))).alias("term")
    ).distinct()


def stem_vocabulary(terms: DataFrame) -> DataFrame:
    """``(term, stem)`` of distinct ``terms``."""
    return stems(terms.select("term"))
