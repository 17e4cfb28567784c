"""What the physical plans have to look like to hold at scale."""

import re

import pytest
from pyspark.sql import functions as F

from dossierlens.operators import categories as cat
from dossierlens.operators import index as idx, similar
from dossierlens.operators.index import build_index
from dossierlens.operators.pages import eligible_pages
from dossierlens.plans import page_similarity
from dossierlens.sources import materialize, scratch_path


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark):
    body = F.concat(F.lit("word word other other [[Category:A]]"), F.repeat(F.lit("x "), 1100))
    record = F.concat(F.lit('<title>t</title><text xml:space="preserve">'), body, F.lit("</text>"))
    raw = materialize(spark, lambda: spark.range(40).select(F.col("id").alias("page_id"), record.alias("value")), scratch_path(spark, "raw"))
    pages = materialize(spark, lambda: eligible_pages(raw), scratch_path(spark, "pages"))
    docs = spark.range(12).select(F.format_string("d%02d", "id").alias("filename"), F.lit("word other").alias("text"))
    return raw, pages, build_index(docs, stem=False)


def test_page_filters_reach_the_scan_and_strings_are_cut_once(stored):
    text = plan(eligible_pages(stored[0]))
    assert "Not(StringContains(value,<redirect />))" in text
    assert text.count("[[Category:") <= 1 and "Python" not in text


def test_weights_read_only_the_categories_and_shuffle_partial_sums(stored):
    text = plan(cat.category_weights(stored[1]))
    assert re.search(r"ReadSchema: struct<categories:array<string>>", text)
    assert text.count("Exchange") == 1 and "partial_sum" in text


def test_query_terms_are_cut_before_the_shuffle(stored):
    text = plan(similar.query_terms(stored[1], stored[2]))
    assert text.count("hashpartitioning") == 1 and "BroadcastHashJoin" in text
    below = text[text.index("hashpartitioning"):]
    assert "WindowGroupLimit" in below
    assert "ReadSchema: struct<page_id:bigint,body:string>" in text


def test_scoring_moves_queries_but_no_pairs(spark, stored):
    _, pages, index = stored
    asked = materialize(spark, lambda: similar.page_queries(similar.query_terms(pages, index)), scratch_path(spark, "q"))
    text = plan(similar._head_sums(similar._in_shards(asked, index), 80, index, ["scale"]))
    # The one exchange spreads the queries; their pairs are summed where they are made.
    assert text.count("hashpartitioning") == 1
    assert text.index("HashAggregate") < text.index("inline(entries") < text.index("hashpartitioning")


def test_scoring_tasks_are_sized_by_pairs(stored, monkeypatch):
    _, pages, index = stored
    # Two words of one distinct document: lists of one entry.
    assert index.list_length == 1
    tasks = lambda n: similar._spread(pages.selectExpr("page_id query_a", "page_id query_b"), n, index).rdd.getNumPartitions()
    assert tasks(1000) == 16
    monkeypatch.setattr(similar, "PAIRS_PER_TASK", 20)
    assert tasks(1000) == 50


SKEW = {
    "spark.sql.files.maxPartitionBytes": "16KB",
    "spark.sql.files.openCostInBytes": "1",
    "spark.sql.shuffle.partitions": "16",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}


def test_a_hot_query_is_split(spark):
    """A third of all pages asks one query. Both sides of their join with its hits come
    straight from a shuffle, which is what lets Spark split a hot key."""
    before = {key: spark.conf.get(key, None) for key in SKEW}
    for key, value in SKEW.items():
        spark.conf.set(key, value)
    try:
        word = F.when(F.col("id") % 3 == 0, "w0").otherwise(F.concat(F.lit("w"), F.col("id") % 2000))
        pages = spark.range(0, 24_000, 1, 8).select(
            F.xxhash64("id").alias("page_id"), F.lit("t").alias("title"), F.concat_ws(" ", word, word).alias("body")
        )
        docs = spark.range(10_000).select(
            F.format_string("d%05d", "id").alias("filename"), F.concat(F.lit("w"), F.col("id") % 2000).alias("text")
        )
        pages = materialize(spark, lambda: pages, scratch_path(spark, "hot"))
        index = build_index(docs, stem=False)
        found = page_similarity(pages, index, k=1)
        found.collect()
        assert found.groupBy("page_id").count().count() == 24_000
        below = plan(found).split("Initial Plan")[0].split("SortMergeJoin [query_a")[1]
        assert len(re.findall(r"Exchange hashpartitioning\(query_a[^\n]*ENSURE_REQUIREMENTS", below)) == 2
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_documents_without_words_are_one_content(spark):
    """A third of all documents holds no word: they are one row of the index, counted each."""
    docs = spark.range(900).select(
        F.format_string("d%03d", "id").alias("filename"), F.when(F.col("id") % 3 == 0, "...").otherwise(F.concat(F.lit("w"), F.col("id"))).alias("text")
    )
    for stem in (False, True):
        index = build_index(docs, stem=stem)
        assert (index.n_files, index.n_documents) == (900, 601)


def test_numbers_come_to_the_counts(spark, monkeypatch):
    """The counts of documents are not moved to meet their numbers, unless these are too many to be broadcast."""
    docs = spark.range(30).select(F.format_string("d%02d", "id").alias("filename"), F.lit("word other").alias("text"))
    counted = materialize(spark, lambda: idx._counted(docs), scratch_path(spark, "counted"))
    joined = lambda: plan(idx._numbered(counted, idx._numbers(counted), counted.count()))
    assert joined().startswith("AdaptiveSparkPlan") and "BroadcastHashJoin [row" in joined()
    monkeypatch.setattr(idx, "BROADCAST_BYTES", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin [row" in joined()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
