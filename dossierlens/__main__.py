"""``python -m dossierlens DUMP DOCUMENTS OUT``; ``spark-submit`` takes ``submit.py`` for it."""

from __future__ import annotations

import argparse

from .functions.scoring import NORMS
from .plans import run_context
from .session import session, size_shuffles

PAGE_OPTIONS = ["min_chars", "strip_sort_key", "redirect_pattern", "text_open", "text_pattern"]
SEARCH_OPTIONS = ["max_words", "min_term_freq", "min_doc_freq", "max_doc_freq", "max_terms"]


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="dossierlens", description=run_context.__doc__)
    parser.add_argument("dump", help="article dump, plain or bzip2")
    parser.add_argument("documents", help="folder of case documents")
    parser.add_argument("out", help="folder for kept tables and results")
    parser.add_argument("-n", type=int, default=10, help="categories per document")
    parser.add_argument("-k", type=int, default=20, help="documents per page")
    parser.add_argument("--no-stem", dest="stem", action="store_false", help="compare words as they are")
    parser.add_argument("--norm", choices=sorted(NORMS), default="exact")
    parser.add_argument("--apostrophes", action="store_true", help="keep words with apostrophes whole")
    parser.add_argument("--on-missing", choices=["error", "drop"], default="error", help="for categories without a weight")
    pages = parser.add_argument_group("pages")
    pages.add_argument("--min-chars", type=int, help="shortest text of a page")
    pages.add_argument("--strip-sort-key", action="store_const", const=True, help="cut category names at a bar")
    pages.add_argument("--redirect-pattern", help="regex of redirects, such as '<redirect [^>]*/>'")
    pages.add_argument("--text-open", help="mark in front of a text, if it is another fixed one")
    pages.add_argument("--text-pattern", help="regex of that mark, such as '<text [^>]*>'")
    search = parser.add_argument_group("search")
    for name in SEARCH_OPTIONS:
        search.add_argument("--" + name.replace("_", "-"), type=int)
    parser.add_argument("--shuffle-partitions", type=int, help="at least so many; the input's size may ask for more")
    given = vars(parser.parse_args(arguments))

    def chosen(names: list[str]) -> dict:
        return {name: given[name] for name in names if given[name] is not None}

    spark = session(shuffle_partitions=given["shuffle_partitions"])
    size_shuffles(spark, given["dump"], given["documents"])
    run_context(
        spark, given["dump"], given["documents"], given["out"], given["n"], given["k"], given["stem"], given["norm"],
        given["apostrophes"], given["on_missing"], chosen(PAGE_OPTIONS), chosen(SEARCH_OPTIONS),
    )


if __name__ == "__main__":
    main()
