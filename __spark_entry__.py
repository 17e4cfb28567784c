
from __future__ import annotations

import importlib.util
import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures, oracles
from dossierlens.functions import markup
from dossierlens.functions.words import words
from dossierlens.operators import categories, index as idx, pages as pg, similar, terms
from dossierlens.operators.index import Index, build_index
from dossierlens.plans import document_context, document_scores, page_similarity, run_context
from dossierlens.sources import (
    is_complete,
    materialize,
    read_case_documents,
    read_delimited,
    read_weights,
    read_wiki_pages,
    scratch_path,
    write_context,
    write_weights,
)
from dossierlens.session import size_in_bytes
from dossierlens.sources.wiki import PAGE_CLOSE, PAGE_OPEN

MAX_RECORD_BYTES = 4096

_kept: dict[tuple, str] = {}


def _path(spark: SparkSession, *what) -> str:
    """One scratch path per input and session, so that queries share what they keep."""
    key = (spark.sparkContext.applicationId, *what)
    if key not in _kept:
        _kept[key] = scratch_path(spark, str(what[0]))
    return _kept[key]


def forget_kept_tables() -> None:
    """Let the next query make its tables anew."""
    _kept.clear()


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _pages(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return pg.eligible_pages(fixtures.page_records(spark, sf_dir), **options)


def _stored_pages(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """The eligible pages as a table, for jobs that read them more than once."""
    path = _path(spark, "pages", sf_dir, *sorted(options.items()))
    return materialize(spark, lambda: _pages(spark, sf_dir, **options), path)


DOCUMENTS = {
    "benchmark": fixtures.benchmark_documents,
    "conversations": fixtures.conversation_documents,
}


def _index(spark: SparkSession, sf_dir: str, docs: str = "benchmark", **options) -> Index:
    options = {"stem": False, "forms": False, **options}
    case_docs = _stored_documents(spark, sf_dir, docs)
    return build_index(case_docs, _path(spark, "index", sf_dir, docs), **options)


def _stored_documents(spark: SparkSession, sf_dir: str, docs: str) -> DataFrame:
    """Conversations have to be put together, so jobs that read them twice store them."""
    if docs == "benchmark":
        return DOCUMENTS[docs](spark, sf_dir)
    path = _path(spark, "documents", sf_dir, docs)
    return materialize(spark, lambda: DOCUMENTS[docs](spark, sf_dir), path)


def _dump(spark: SparkSession, sf_dir: str) -> str:
    """Every page record, written as a dump of several files."""
    path = _path(spark, "dump", sf_dir)
    if not is_complete(spark, path):
        fixtures.page_records(spark, sf_dir).select("value").write.mode("overwrite").text(path)
    return path


def eligible_pages(spark, sf_dir):
    return _pages(spark, sf_dir).select(
        "page_id", F.length("body").alias("n_chars"), F.size("categories").alias("n_categories")
    )


def _title() -> Column:
    return markup.extract_between(F.col("value"), markup.TITLE_OPEN, markup.TITLE_CLOSE).alias("title")


def page_source_roundtrip(spark, sf_dir):
    body = markup.extract_between(F.col("value"), markup.TEXT_OPEN, markup.TEXT_CLOSE)
    return read_wiki_pages(spark, _dump(spark, sf_dir)).select(
        _title(), F.md5(body).alias("digest"), F.octet_length("value").alias("n_bytes")
    )


def page_source_bzip2(spark, sf_dir):
    """The same dump, packed; bzip2 is read in splits."""
    path = scratch_path(spark, "packed")
    records = fixtures.page_records(spark, sf_dir).select("value")
    records.write.option("compression", "bzip2").text(path)
    body = markup.extract_between(F.col("value"), markup.TEXT_OPEN, markup.TEXT_CLOSE)
    return read_wiki_pages(spark, path).select(_title(), F.md5(body).alias("digest"))


def page_source_revisions(spark, sf_dir):
    """Pages with an older revision in front: the last text is the body."""
    path = scratch_path(spark, "revisions")
    older = F.concat(F.lit("    <revision>\n      " + markup.TEXT_OPEN + "older"), F.lit(markup.TEXT_CLOSE + "\n    </revision>\n    <revision>"))
    records = fixtures.page_records(spark, sf_dir).select(F.replace("value", F.lit("    <revision>"), older).alias("value"))
    records.write.text(path)
    body = markup.extract_between(F.col("value"), markup.TEXT_OPEN, markup.TEXT_CLOSE)
    return read_wiki_pages(spark, path).select(_title(), F.md5(body).alias("digest"))


SPLITS = 200
"""About so many splits the files of ``page_source_preamble`` are read in."""


def page_source_preamble(spark, sf_dir):
    """Records behind stray end marks, with start marks inside them, and records that their file does not
    end, in plain and packed files of many splits."""
    path = f"{scratch_path(spark, 'preamble')}/a b"
    nested = F.replace("value", F.lit("    <revision>"), F.lit("    <revision>" + PAGE_OPEN))
    records = fixtures.page_records(spark, sf_dir).select(F.concat(F.lit("stray" + PAGE_CLOSE + " text"), nested))
    left_open = spark.range(1).select(F.lit("x" + PAGE_OPEN + PAGE_OPEN + "left open"))
    for packing in ("none", "bzip2"):
        records.write.mode("append").option("compression", packing).text(path)
        left_open.write.mode("append").option("compression", packing).text(path)
    setting = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(max(16 << 10, size_in_bytes(spark, path) // SPLITS)))
    try:
        value = F.col("value")
        found = read_delimited(spark, path, PAGE_OPEN, PAGE_CLOSE).select(_title(), F.md5(value).alias("digest"), F.octet_length(value).alias("n_bytes"))
        return materialize(spark, lambda: found, scratch_path(spark, "read"))
    finally:
        spark.conf.set(setting, before)


def oversize_records_dropped(spark, sf_dir):
    records = read_delimited(spark, _dump(spark, sf_dir), PAGE_OPEN, PAGE_CLOSE, MAX_RECORD_BYTES)
    return records.select(_title(), F.octet_length("value").alias("n_bytes"))


def case_documents_roundtrip(spark, sf_dir):
    # One file per row; the writer ends each with a line break that is not part of the text.
    folder = f"{scratch_path(spark, 'folder')}/conv"
    docs = fixtures.conversation_documents(spark, sf_dir).select("text")
    # Tasks bring their own files to their place; else the driver would, one after the other.
    docs.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).text(folder)
    text = F.substr("text", F.lit(1), F.length("text") - 1)
    return read_case_documents(spark, folder).select(
        F.length(text).alias("n_chars"), F.md5(text).alias("digest")
    )


def page_titles(spark, sf_dir):
    return pg.page_titles(fixtures.table(spark, sf_dir, "pages"), "html").select("page_id", "title")


def page_category_pairs(spark, sf_dir):
    return categories.page_category_pairs(_pages(spark, sf_dir))


def page_category_pairs_no_sort_key(spark, sf_dir):
    return categories.page_category_pairs(_pages(spark, sf_dir, strip_sort_key=True))


def category_weights(spark, sf_dir):
    return _rounded(categories.category_weights(_pages(spark, sf_dir)), "weight")


def weights_export_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "weights")
    write_weights(categories.category_weights(_pages(spark, sf_dir)), path)
    return _rounded(read_weights(spark, path), "weight")


def tokens(spark, sf_dir):
    return terms.tokenize(fixtures.benchmark_documents(spark, sf_dir), "filename", "text")


def _with_forms(texts: DataFrame, id: str) -> DataFrame:
    """``texts`` with a line of addresses, hosts, acronyms and possessives that their ids make."""
    return texts.withColumn("text", F.concat("text", F.expr(fixtures.FORMS.format(id=id))))


def tokens_word_forms(spark, sf_dir):
    return terms.tokenize(_with_forms(fixtures.table(spark, sf_dir, "documents"), "doc_id"), "doc_id", "text", forms=True)


def page_similarity_word_forms(spark, sf_dir):
    """Both sides in the analyzer's word forms. Pages are kept as the counts of their words, as nothing else reads their texts."""
    found = _pages(spark, sf_dir, require_category=False, require_title=True).withColumnRenamed("body", "text")
    formed = _with_forms(found, "page_id").select("page_id", "title", F.col("text").alias("body"))
    pages = materialize(spark, lambda: terms.counted_pages(formed, stem=False), scratch_path(spark, "counted-pages"))
    docs = _with_forms(fixtures.conversation_documents(spark, sf_dir), "filename")
    return _rounded(page_similarity(pages, build_index(docs, stem=False)), "score")


def postings(spark, sf_dir, docs="benchmark"):
    return idx.postings(DOCUMENTS[docs](spark, sf_dir))


def term_stats(spark, sf_dir, docs="benchmark"):
    return _rounded(idx.term_stats(DOCUMENTS[docs](spark, sf_dir)), "idf")


def index_terms(spark, sf_dir):
    """The terms the index itself holds."""
    return _rounded(_index(spark, sf_dir, "conversations", head_size=256).terms, "idf")


def index_postings(spark, sf_dir):
    """Every posting the index itself holds, from heads and tails, for each file, as it counts with its idf."""
    index = _index(spark, sf_dir, "conversations", head_size=256)
    heads = index.heads.select("term", F.inline("entries"))
    every = heads if index.tails is None else heads.unionByName(index.tails.select("term", "doc_no", "impact"))
    impact = F.col("impact") * F.col("idf") * F.col("idf")
    every = every.join(index.files, "doc_no").join(index.terms, "term")
    return _rounded(every.select("term", "filename", impact.alias("impact")), "impact")


def doc_stats(spark, sf_dir):
    return idx.doc_stats(fixtures.benchmark_documents(spark, sf_dir))


def stem_vocabulary(spark, sf_dir):
    return terms.stem_vocabulary(terms.vocabulary(fixtures.table(spark, sf_dir, "documents"), "text"))


def query_terms(spark, sf_dir):
    found = similar.query_terms(_stored_pages(spark, sf_dir), _index(spark, sf_dir))
    return _rounded(found, "idf", "weight")


def query_terms_whole_text(spark, sf_dir):
    index = _index(spark, sf_dir, "conversations")
    return _rounded(similar.query_terms(_stored_pages(spark, sf_dir), index), "idf", "weight")


def page_similarity_of(spark, sf_dir, docs="benchmark", **options):
    found = _stored_pages(spark, sf_dir, require_category=False, require_title=True)
    return _rounded(page_similarity(found, _index(spark, sf_dir, docs, **options)), "score")


def document_category_scores(spark, sf_dir):
    found = _stored_pages(spark, sf_dir)
    weights = categories.category_weights(found)
    return _rounded(document_scores(found, _index(spark, sf_dir), weights), "score")


def document_context_of(spark, sf_dir, docs="benchmark", **options):
    found = _stored_pages(spark, sf_dir)
    weights = categories.category_weights(found)
    return _rounded(document_context(found, _index(spark, sf_dir, docs, **options), weights), "score")


def document_context_rendered(spark, sf_dir):
    found = _stored_pages(spark, sf_dir)
    weights = categories.category_weights(found)
    path = scratch_path(spark, "context")
    write_context(categories.render_context(document_context(found, _index(spark, sf_dir), weights), 6), path)
    fields = F.split("value", "\t")
    return spark.read.text(path).select(fields[0].alias("filename"), fields[1].alias("rendered"))


def context_run_reuse(spark, sf_dir):
    """Two full runs from files: the second reuses pages, weights and index."""
    docs = _stored_documents(spark, sf_dir, "benchmark")
    out = scratch_path(spark, "run")
    for _ in range(2):
        context = run_context(spark, _dump(spark, sf_dir), docs, out, stem=False, forms=False)
    return _rounded(context, "score")


def entry(spark: SparkSession) -> DataFrame:
    """The categories that describe each benchmark item, from the smallest tables."""
    return document_context_of(spark, "/root/testdata/sf0.001")


def _training_data():
    """The training-data queries and SQL, if their modules are here; import errors inside raise."""
    if not all(map(importlib.util.find_spec, ("dossierlens.llm", "corpus_pipeline"))):
        return {}, {}
    import corpus_pipeline
    from dossierlens.llm import registry

    pipeline = corpus_pipeline.ORACLE_SQL
    sql = registry.oracle_sql() | ({"pipeline": pipeline} if pipeline else {})
    return registry.queries() | {"pipeline": corpus_pipeline.run}, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _queries() | _training_data()[0]


def _queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "eligible_pages": eligible_pages,
        "page_source_roundtrip": page_source_roundtrip,
        "page_source_bzip2": page_source_bzip2,
        "page_source_revisions": page_source_revisions,
        "page_source_preamble": page_source_preamble,
        "oversize_records_dropped": oversize_records_dropped,
        "case_documents_roundtrip": case_documents_roundtrip,
        "page_titles": page_titles,
        "page_category_pairs": page_category_pairs,
        "page_category_pairs_no_sort_key": page_category_pairs_no_sort_key,
        "category_weights": category_weights,
        "weights_export_roundtrip": weights_export_roundtrip,
        "tokens": tokens,
        "tokens_word_forms": tokens_word_forms,
        "postings": postings,
        "postings_conversations": lambda s, d: postings(s, d, "conversations"),
        "term_stats": term_stats,
        "term_stats_conversations": lambda s, d: term_stats(s, d, "conversations"),
        "index_terms": index_terms,
        "index_postings": index_postings,
        "doc_stats": doc_stats,
        "stem_vocabulary": stem_vocabulary,
        "query_terms": query_terms,
        "query_terms_whole_text": query_terms_whole_text,
        "page_similarity": page_similarity_of,
        "page_similarity_byte_norm": lambda s, d: page_similarity_of(s, d, norm="byte"),
        "page_similarity_conversations": lambda s, d: page_similarity_of(s, d, "conversations"),
        "page_similarity_bounded_lists": lambda s, d: page_similarity_of(
            s, d, "conversations", head_size=32
        ),
        "page_similarity_many_shards": lambda s, d: page_similarity_of(
            s, d, "conversations", head_size=256, shard_entries=20_000
        ),
        "page_similarity_word_forms": page_similarity_word_forms,
        "page_similarity_stemmed": lambda s, d: page_similarity_of(s, d, "conversations", stem=True),
        "document_category_scores": document_category_scores,
        "document_context": document_context_of,
        "document_context_conversations": lambda s, d: document_context_of(s, d, "conversations"),
        "document_context_stemmed": lambda s, d: document_context_of(s, d, "conversations", stem=True),
        "document_context_rendered": document_context_rendered,
        "context_run_reuse": context_run_reuse,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql(MAX_RECORD_BYTES) | _training_data()[1]
