"""Column functions that turn text into words and word counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rows import let

# What counts as one word.
WORD = r"[\p{L}\p{N}]+"
WORD_WITH_APOSTROPHES = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"

# The forms the analyzer keeps whole, in the order tried. E-mail addresses; words with apostrophes and
# names such as AT&T; host names and acronyms, or else plain words.
_RUN = r"[\p{L}\p{N}]++"
WORD_FORMS = (
    rf"{_RUN}(?:[._-]{_RUN})*+@{_RUN}(?:[.-]{_RUN})++"
    r"|\p{L}++(?:(?:'\p{L}++)++|[&@]\p{L}++)"
    rf"|{_RUN}(?:(?:\.{_RUN})++\.?+)?+"
)
ACRONYM = r"^(?:\p{L}\.)+$"


def words(text: Column, apostrophes: bool = False, limit: int | None = None, forms: bool = False) -> Column:
    """Lower-cased words of ``text`` in order, optionally only the first ``limit``.

    ``forms`` keeps e-mail addresses, host names, acronyms, words with apostrophes and names joined by an ampersand
    whole, as the analyzer does: ``state's`` is ``state``, ``U.S.`` is ``us``, ``o'neil`` stays. The forms are found
    and cut in one pass over the text. ``apostrophes`` only joins words at apostrophes.
    """
    pattern = WORD_FORMS if forms else WORD_WITH_APOSTROPHES if apostrophes else WORD
    found = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))
    if forms:
        found = F.transform(found, _form)
    return found if limit is None else F.slice(found, 1, limit)


def _form(word: Column) -> Column:
    """A form without its possessive ending, or the dots of an acronym, or the dot that ends a sentence."""
    dotted = F.when(word.rlike(ACRONYM), F.replace(word, F.lit("."))).otherwise(F.rtrim(word, F.lit(".")))
    cut = F.when(F.endswith(word, F.lit("'s")), F.left(word, F.length(word) - 2)).otherwise(word)
    return F.when(F.contains(word, F.lit("@")), word).when(F.contains(word, F.lit("'")), cut).when(F.contains(word, F.lit(".")), dotted).otherwise(word)


def word_counts(found: Column, min_count: int = 1) -> Column:
    """``array<struct<term, tf>>`` of the words in one row.

    Counting inside the row (sort, then the length of each run of equal words) needs no
    shuffle, where explode and group by row and word would move every word.
    """

    def runs(ordered: Column, ends: Column) -> Column:
        return F.transform(
            ends,
            lambda end, i: F.struct(
                F.get(ordered, end - 1).alias("term"),
                (end - F.coalesce(F.get(ends, i - 1), F.lit(0))).alias("tf"),
            ),
        )

    def counted(ordered: Column) -> Column:
        last_of_run = F.filter(
            F.sequence(F.lit(1), F.size(ordered)),
            lambda i: (i == F.size(ordered)) | (F.get(ordered, i - 1) != F.get(ordered, i)),
        )
        counts = let(last_of_run, lambda ends: runs(ordered, ends))
        return counts if min_count <= 1 else F.filter(counts, lambda c: c["tf"] >= min_count)

    return let(F.sort_array(found), lambda w: F.when(F.size(w) > 0, counted(w)))
