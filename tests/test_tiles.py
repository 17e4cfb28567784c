import re

import pytest

from dossierlens.operators import similar, tiles
from dossierlens.operators.index import build_index

from test_similar import brute_force, corpus, page_queries, run


@pytest.fixture
def by_tiles(monkeypatch):
    monkeypatch.setattr(similar, "PAIRED_ROWS", -1)


@pytest.mark.parametrize("head_size, shard_entries, tile_entries", [(1024, 10**6, 10**6), (8, 10**6, 10**6), (1024, 700, 1500), (8, 300, 900), (1, 100, 1)])
def test_same_as_brute_force(spark, by_tiles, monkeypatch, head_size, shard_entries, tile_entries):
    monkeypatch.setattr(tiles, "TILE_ENTRIES", tile_entries)
    for k in (3, 20):
        pages, docs = corpus(head_size + shard_entries)
        assert run(spark, pages, docs, k, head_size, shard_entries) == brute_force(pages, docs, k)


@pytest.mark.parametrize("dense", [0, 10**9])
def test_same_for_lists_of_any_density(spark, by_tiles, monkeypatch, dense):
    monkeypatch.setattr(tiles, "DENSE", dense)
    pages, docs = corpus(21)
    assert run(spark, pages, docs) == brute_force(pages, docs)


def test_no_pair_is_a_row(spark, by_tiles):
    """Pairs stay in the task that sums them: nothing is joined or summed as rows, so nothing of them spills."""
    pages, docs = corpus(22)
    index = build_index(spark.createDataFrame(list(docs.items()), "filename string, text string"), stem=False)
    queries = page_queries(spark, pages, index).drop("page_id").dropDuplicates(similar.QUERY)
    text = tiles.best_in_tiles(queries, index, 20)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in text and not re.search("Join|Window|inline", text)


def test_many_pairs_are_summed_in_tiles(spark, monkeypatch):
    """Rows are made only for as many pairs as are bounded, whatever the tables' size."""
    pages, docs = corpus(23)
    index = build_index(spark.createDataFrame(list(docs.items()), "filename string, text string"), stem=False)
    queries = page_queries(spark, pages, index)
    before = {(r.query_a, r.file_no, r.rank, round(r.score, 9)) for r in similar.query_hits(queries, index).collect()}
    monkeypatch.setattr(similar, "PAIRED_ROWS", 1000)
    monkeypatch.setattr(similar, "_best_documents", None)
    after = {(r.query_a, r.file_no, r.rank, round(r.score, 9)) for r in similar.query_hits(queries, index).collect()}
    assert before and after == before


def test_shards_are_one_file_each(spark):
    """However many tasks make the postings, a shard of many is written by one."""
    _, docs = corpus(24)
    rows = spark.createDataFrame(list(docs.items()), "filename string, text string").repartition(7)
    index = build_index(rows, stem=False, head_size=8, shard_entries=100)
    assert index.n_shards > 10
    for table in (index.heads, index.tails):
        assert len(table.inputFiles()) <= index.n_shards


def test_tiles_grow_no_faster_than_the_tables():
    """Postings go to every block and queries to every group: both numbers stay as tables grow together, until a tile is full."""
    dealt = []
    for size in (1, 10):
        n_entries, n_queries = 6_600_000 * size, 108_000 * size
        groups, blocks = tiles._layout(n_entries, n_queries, -(-n_entries // tiles.TILE_ENTRIES), 12, 20)
        assert groups * blocks >= 12 and n_entries / groups <= tiles.HELD_ENTRIES
        dealt.append((6 * n_entries * blocks + 670 * n_queries * groups) / size)
    assert dealt[1] < 1.5 * dealt[0]


def test_only_asked_lists_are_dealt(spark, by_tiles, monkeypatch):
    """Most terms of a collection are in no query; their lists do not meet the queries."""
    pages, docs = corpus(25)
    docs = docs | {"rare": " ".join(f"rare{i}" for i in range(500))}
    index = build_index(spark.createDataFrame(list(docs.items()), "filename string, text string"), stem=False, head_size=8)
    queries = page_queries(spark, pages, index)
    asked = {term for row in queries.collect() for term in row.terms}
    given = []
    inner = similar.best_in_tiles
    monkeypatch.setattr(similar, "best_in_tiles", lambda queries, index, k: given.append(index) or inner(queries, index, k))
    similar.query_hits(queries, index)
    assert {r.term for lists in (given[0].heads, given[0].tails) for r in lists.select("term").collect()} <= asked


@pytest.mark.parametrize("held, queries", [(200, 10**6), (10**9, 3), (200, 3)])
def test_same_with_any_groups_and_blocks(spark, by_tiles, monkeypatch, held, queries):
    """A tile of several parts, and queries in several groups, have the same best."""
    monkeypatch.setattr(tiles, "TILE_ENTRIES", 150)
    monkeypatch.setattr(tiles, "HELD_ENTRIES", held)
    monkeypatch.setattr(tiles, "HELD_QUERIES", queries)
    for k in (3, 20):
        pages, docs = corpus(26)
        assert run(spark, pages, docs, k, 8, 100) == brute_force(pages, docs, k)


def test_lists_of_small_shards_are_dealt_as_one(spark):
    """What is repeated for every block of queries is a list for each term and part, not one for each shard."""
    docs = spark.createDataFrame([(f"d{i}", f"the the a{i % 7} b{i}") for i in range(120)], "filename string, text string")
    index = build_index(docs, stem=False, head_size=8, shard_entries=20)
    assert index.n_shards > 10 and index.n_tails
    dealt = tiles._dealt_lists(index, 2, 1, 3)
    assert dealt.count() == dealt.select("term", "part", "tile").distinct().count()
    one = dealt.where("tile = 0 and term = 'the'").selectExpr("inline(arrays_zip(doc_nos, impacts)) as (doc_no, impact)")
    every = index.heads.selectExpr("term", "inline(entries)").unionByName(index.tails.select("term", "doc_no", "impact")).where("term = 'the'").drop("term")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, every.collect()))
