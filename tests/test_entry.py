"""The registered queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "benchmark", "conversations", "pages"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return connection


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(v[i] for i in order) for v in values), key=repr)


@pytest.mark.parametrize(
    "name",
    [
        "eligible_pages", "page_source_roundtrip", "page_source_bzip2", "page_source_revisions", "page_source_preamble", "document_context_rendered", "stem_vocabulary", "page_similarity_stemmed", "document_context_stemmed", "oversize_records_dropped", "case_documents_roundtrip",
        "page_titles", "page_category_pairs_no_sort_key", "weights_export_roundtrip", "tokens_word_forms", "page_similarity_word_forms", "term_stats", "index_terms", "index_postings", "page_similarity_many_shards",
        "query_terms", "page_similarity_bounded_lists", "document_context", "context_run_reuse",
    ],
)
def test_query_matches_its_sql(spark, sql, name):
    found = entry.queries()[name](spark, SF)
    expected = sql.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in expected.description]
    assert rows(found.columns, found.collect()) == rows(columns, expected.fetchall())


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_weights_sum_to_the_eligible_pages(spark):
    pages = entry._stored_pages(spark, SF)
    weights = entry.queries()["category_weights"](spark, SF)
    assert pages.count() == 69
    assert weights.agg({"weight": "sum"}).first()[0] == pytest.approx(69, abs=1e-4)


def test_flagship_query(spark):
    found = entry.entry(spark)
    assert found.columns == ["filename", "rank", "category", "score"]
    assert found.count() > 0 and found.where("rank > 10").count() == 0


def test_word_forms_keep_no_text(spark, monkeypatch):
    """The query's disk is that of counts: neither texts of pages nor of documents are written down."""
    written, inner = [], entry.materialize
    monkeypatch.setattr(entry, "materialize", lambda spark, compute, *rest: written.append(compute().columns) or inner(spark, compute, *rest))
    assert entry.page_similarity_word_forms(spark, SF).count() > 0
    assert [columns for columns in written if {"body", "text"} & set(columns)] == []
