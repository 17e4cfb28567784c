"""Category weights, page similarity, document context, and the whole run over a dump."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import categories as cat
from ..operators.index import Index, build_index
from ..operators.pages import eligible_pages
from ..operators.similar import MAX_HITS, QUERY, page_queries, query_hits, query_terms
from ..operators.terms import counted_pages
from ..sources.stored import drop_table, files_fingerprint, rows_fingerprint
from ..sources import (
    materialize,
    read_case_documents,
    read_wiki_pages,
    scratch_path,
    write_context,
    write_weights,
)


def category_weights_of_dump(spark: SparkSession, dump: str) -> DataFrame:
    """``(category, weight)`` of the pages in ``dump``."""
    return cat.category_weights(eligible_pages(read_wiki_pages(spark, dump)))


def _stored_queries(pages: DataFrame, index: Index, path: str | None, **choice) -> DataFrame:
    """The page queries, written once: reading the texts is the costly part of the job,
    and what follows uses the queries twice."""
    path = path or scratch_path(index.spark, "queries")
    return materialize(
        index.spark, lambda: page_queries(query_terms(pages, index, **choice)), path, "overwrite"
    )


def page_similarity(
    pages: DataFrame, index: Index, k: int = MAX_HITS, work_path: str | None = None, **choice
) -> DataFrame:
    """``(page_id, title, filename, score, rank)``: the ``k`` documents most like each page."""
    asked = _stored_queries(pages, index, work_path, **choice)
    # As a table, hits come into the join by a shuffle, and a query that many pages ask is split.
    hits = materialize(
        index.spark,
        lambda: query_hits(asked, index, k).join(index.files.select("file_no", "filename"), "file_no"),
        scratch_path(index.spark, "hits"),
    )
    # Titles come to the pages' queries before these are multiplied by their hits, which are not moved again.
    titled = asked.select("page_id", *QUERY).join(pages.select("page_id", "title"), "page_id")
    return titled.join(hits.drop("file_no"), QUERY).select("page_id", "title", "filename", "score", "rank")


def _scores_by_file(
    pages: DataFrame,
    index: Index,
    weights: DataFrame,
    k: int,
    on_missing: str,
    work_path: str | None,
    **choice,
) -> DataFrame:
    asked = _stored_queries(pages, index, work_path, **choice)
    hits = query_hits(asked, index, k).select(*QUERY, "file_no", "score")
    mass = cat.category_mass(asked.select("page_id", *QUERY), pages, QUERY)
    return cat.document_category_scores(hits, mass, weights, QUERY, "file_no", on_missing)


def document_scores(
    pages: DataFrame,
    index: Index,
    weights: DataFrame,
    k: int = MAX_HITS,
    on_missing: str = "error",
    work_path: str | None = None,
    **choice,
) -> DataFrame:
    """``(filename, category, score)``, all of them."""
    scores = _scores_by_file(pages, index, weights, k, on_missing, work_path, **choice)
    return scores.join(index.files.select("file_no", "filename"), "file_no").select(
        "filename", "category", "score"
    )


def document_context(
    pages: DataFrame,
    index: Index,
    weights: DataFrame,
    n: int = 10,
    k: int = MAX_HITS,
    on_missing: str = "error",
    work_path: str | None = None,
    **choice,
) -> DataFrame:
    """``(filename, rank, category, score)``: the ``n`` categories that best describe each
    case document."""
    scores = _scores_by_file(pages, index, weights, k, on_missing, work_path, **choice)
    best = cat.top_categories(scores, n, "file_no")
    return best.join(index.files.select("file_no", "filename"), "file_no").select(
        "filename", "rank", "category", "score"
    )


def run_context(
    spark: SparkSession,
    dump: str | list[str],
    documents: str | DataFrame,
    out: str,
    n: int = 10,
    k: int = MAX_HITS,
    stem: bool = True,
    norm: str = "exact",
    apostrophes: bool = False,
    on_missing: str = "error",
    page_options: dict | None = None,
    search_options: dict | None = None,
    forms: bool | None = None,
) -> DataFrame:
    """Everything from a dump and a folder (or table) of case documents to results below ``out``.

    ``page_options`` go to ``eligible_pages``, ``search_options`` to ``query_terms``. Pages,
    weights and index are kept, each with a fingerprint of its inputs and options, and are made
    anew when these have changed; the context is always made anew. Pages are kept with the counts of their words
    in place of their texts, which no run takes apart a second time. ``out/weights`` and
    ``out/context`` are tab-separated text, the rest is parquet.
    """
    page_options, search_options = page_options or {}, search_options or {}
    rule = {"stem": stem, "apostrophes": apostrophes, "forms": forms}
    rule |= {option: search_options[option] for option in ("max_words", "min_term_freq") if option in search_options}
    marks = {"text_open": page_options["text_open"]} if "text_open" in page_options else {}
    made_for = files_fingerprint(spark, dump, "pages", sorted(page_options.items()))
    pages = materialize(
        spark,
        lambda: counted_pages(eligible_pages(read_wiki_pages(spark, dump, **marks), **page_options), **rule),
        f"{out}/pages",
        fingerprint=f"{made_for} {sorted(rule.items())}",
    )
    weights = materialize(
        spark, lambda: cat.category_weights(pages), f"{out}/weights.parquet", fingerprint=made_for
    )
    if isinstance(documents, str):
        case_docs, made_for = read_case_documents(spark, documents), files_fingerprint(spark, documents)
    else:
        case_docs, made_for = documents, rows_fingerprint(documents.select("filename", "text"))
    index = build_index(
        case_docs, f"{out}/index", stem=stem, norm=norm, apostrophes=apostrophes, forms=forms, fingerprint=made_for
    )
    queries = f"{out}/queries"
    context = materialize(
        spark,
        lambda: document_context(
            pages, index, weights, n, k, on_missing, work_path=queries, **search_options
        ),
        f"{out}/context.parquet",
        "overwrite",
    )
    drop_table(spark, queries)
    write_weights(weights, f"{out}/weights", mode="overwrite")
    write_context(cat.render_context(context), f"{out}/context")
    return context
