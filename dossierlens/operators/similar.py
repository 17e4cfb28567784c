"""For every page, the case documents most like it.

A page asks with its best terms; a document answers with the impacts of the terms it shares.
Three properties keep the join small without changing its result:

* Pages with the same terms ask the same query. Queries are scored once, so a group of
  copies of any size costs one query.
* Pairs are made and summed in the task that holds a query and a shard of the index, and never
  move. One shard is broadcast. Several meet the queries in one job: a tile is a block of
  queries with a shard, both are dealt by tile once, and only the ``k`` best of each query and tile
  go on to the final choice.
* Long posting lists are not paired with every query. The heads of all shards give each query a lower
  bound for its k-th score; in each shard a tail is opened only if documents found nowhere else could
  still reach that bound with the highest impacts of that shard's tails, and is otherwise looked up for
  the documents that can.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scoring import rank_value
from ..functions.words import word_counts, words
from ..sources.stored import materialize, scratch_path
from .index import Index
from .ranking import top_per_group
from .terms import MIN_TERM_FREQ, stem_vocabulary, term_counts
from .tiles import best_in_tiles

QUERY = ["query_a", "query_b"]
"""Two 64-bit hashes of a query's terms, together its key."""

# Defaults of the "more like this" query and of the search.
MIN_DOC_FREQ = 5
MAX_TERMS = 25
MAX_HITS = 20

BROADCAST_BYTES = 256 << 20
"""Most bytes a table may have to be broadcast, by its counted rows; beyond, joins shuffle."""

LEXICON_BYTES = 32 << 20
"""Most bytes of a lexicon, by its counted rows, that is given to every task that chooses a page's terms; beyond, words are joined with it."""

CHOSEN_AT_ONCE = 2000
"""Pages whose terms are chosen at a time."""

ENTRY_BYTES = 16
ROW_BYTES = 64
PAIRS_PER_TASK = 20_000_000

PAIRED_ROWS = 2_000_000
"""Most pairs of a query's term and a document that are made as rows; more are summed in arrays, see ``tiles``."""

CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"

_SLACK = 1 - 1e-6
"""Scores are ranked as 32-bit numbers; bounds leave more room than their rounding."""


def _small(table: DataFrame, n_bytes: int) -> DataFrame:
    return F.broadcast(table) if n_bytes <= BROADCAST_BYTES else table


def _kept(index: Index, table: DataFrame, name: str) -> DataFrame:
    return materialize(index.spark, lambda: table, scratch_path(index.spark, name))


@contextmanager
def _dealt_by_tile(spark: SparkSession):
    """Plans made inside take rows dealt by tile for rows dealt by tile and term, and do not deal them again."""
    before = spark.conf.get(CO_PARTITION)
    spark.conf.set(CO_PARTITION, "false")
    try:
        yield
    finally:
        spark.conf.set(CO_PARTITION, before)


def _spread(queries: DataFrame, n_asked: int, index: Index) -> DataFrame:
    """``queries``, asking ``n_asked`` terms in all, in tasks sized by the pairs they will
    make, not by their own few bytes.

    A fixed number of partitions is not merged at run time. It must differ from the
    session's default, which Spark would take for the partitioning already there.
    """
    default = int(index.spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = n_asked * index.list_length
    n_tasks = max(4 * index.spark.sparkContext.defaultParallelism, math.ceil(pairs / PAIRS_PER_TASK))
    return queries.repartition(n_tasks + (n_tasks == default), *QUERY)


def query_terms(
    pages: DataFrame,
    index: Index,
    max_words: int | None = None,
    min_term_freq: int = MIN_TERM_FREQ,
    min_doc_freq: int = MIN_DOC_FREQ,
    max_doc_freq: int | None = None,
    max_terms: int = MAX_TERMS,
) -> DataFrame:
    """``(page_id, rank, term, tf, idf, weight)``: the best terms of each page by ``tf * idf``.

    The whole text asks; ``max_words`` is for callers who want only its beginning to. Ties
    go by term. ``pages`` hold texts in ``body``, or ``counts`` that ``counted_pages`` has made of them for
    this index and choice, which are not taken apart again.
    """
    has_counts = "counts" in pages.columns
    known = index.terms.where(F.col("df") >= min_doc_freq)
    if max_doc_freq is not None:
        known = known.where(F.col("df") <= max_doc_freq)
    known = known.select("term", "idf")
    least = 1 if index.stem else min_term_freq
    if has_counts:
        counted = pages.select("page_id", "counts")
    else:
        found = words(F.col("body"), index.apostrophes, max_words, index.forms)
        counted = pages.select("page_id", word_counts(found, least).alias("counts"))
    if index.stem:
        # Texts are taken apart once: the vocabulary, its stems and the terms all come from the stored counts.
        if not has_counts:
            counted = _kept(index, counted, "counts")
        spoken = counted.select(F.explode("counts.term").alias("term")).distinct()
        lexicon, n_bytes = _lexicon(spoken, index, _small(known, index.term_bytes))
    else:
        lexicon, n_bytes = known.withColumn("stem", F.col("term")), index.term_bytes
    joined = lambda rows: _joined_terms(rows.select("page_id", F.inline("counts")), _small(lexicon, n_bytes), index.stem, min_term_freq, max_terms)
    if not index.stem and not has_counts:
        found = term_counts(pages, "page_id", "body", index.apostrophes, max_words, min_term_freq, index.forms)
        return _joined_terms(found, _small(lexicon, n_bytes), False, min_term_freq, max_terms)
    if not index.stem or n_bytes > LEXICON_BYTES:
        return joined(counted)
    # A page is one row of counts, so its stems are summed and chosen in that row; rows that share an id ask together and have to meet.
    shared = pages.groupBy("page_id").agg(F.count("*").alias("n")).where("n > 1 or page_id is null").select("page_id")
    shared = _kept(index, shared, "shared-ids")
    if shared.isEmpty():
        return _chosen_in_rows(counted, lexicon, min_term_freq, max_terms)
    alone = counted.join(shared, "page_id", "left_anti").where("page_id is not null")
    together = counted.join(shared, counted["page_id"].eqNullSafe(shared["page_id"]), "left_semi")
    return _chosen_in_rows(alone, lexicon, min_term_freq, max_terms).unionByName(joined(together))


def _joined_terms(found: DataFrame, lexicon: DataFrame, stem: bool, min_term_freq: int, max_terms: int) -> DataFrame:
    """The best terms of ``found(page_id, term, tf)``, by joining its words with ``lexicon(term, stem, idf)``."""
    if stem:
        # One shuffle by page serves both the sum over words of one stem and the choice of the best terms.
        counts = (
            found.join(lexicon, "term")
            .repartition("page_id")
            .groupBy("page_id", F.col("stem").alias("term"), "idf")
            .agg(F.sum("tf").alias("tf"))
            .where(F.col("tf") >= min_term_freq)
        )
    else:
        counts = found.where(F.col("tf") >= min_term_freq).join(lexicon.drop("stem"), "term")
    weighted = counts.withColumn("weight", F.col("tf") * F.col("idf"))
    order = [rank_value(F.col("weight")).desc(), F.col("term")]
    return top_per_group(weighted, ["page_id"], order, max_terms).select(
        "page_id", "rank", "term", F.col("tf").cast("int").alias("tf"), "idf", "weight"
    )


def _chosen_in_rows(counted: DataFrame, lexicon: DataFrame, min_term_freq: int, max_terms: int) -> DataFrame:
    """As ``_joined_terms`` of stems, for rows of distinct ids: every row's terms are looked up, summed by stem and ranked where the row is,
    so that no word of a page is moved."""
    table = lexicon.select("term", "stem", "idf").toArrow()
    # Stems are numbered in the order of their bytes, as Spark orders strings, so ties go by number.
    known = table.select(["stem", "idf"]).group_by("stem").aggregate([("idf", "min")]).sort_by("stem")
    names, idfs = known["stem"].combine_chunks(), known["idf_min"].to_numpy()
    terms, codes = table["term"].combine_chunks(), pc.index_in(table["stem"], value_set=names).to_numpy()
    shared = counted.sparkSession.sparkContext.broadcast((terms, codes, names, idfs))
    kinds = {"rank": pa.int32(), "term": pa.string(), "tf": pa.int32(), "idf": pa.float64(), "weight": pa.float64()}

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, codes, names, idfs = shared.value
        for whole in batches:
            for begin in range(0, whole.num_rows, CHOSEN_AT_ONCE):
                batch = whole.slice(begin, CHOSEN_AT_ONCE)
                counts = batch.column("counts")
                lengths = pc.fill_null(pc.list_value_length(counts), 0).to_numpy(zero_copy_only=False)
                word, tf = counts.flatten().flatten()
                at = pc.fill_null(pc.index_in(word, value_set=terms), -1).to_numpy(zero_copy_only=False)
                row, tf = np.repeat(np.arange(batch.num_rows), lengths), tf.to_numpy(zero_copy_only=False).astype(np.int64)
                keep = at >= 0
                row, code, tf = row[keep], codes[at[keep]].astype(np.int64), tf[keep]
                if len(row):
                    key = row * len(names) + code
                    order = np.argsort(key, kind="stable")
                    key, first = np.unique(key[order], return_index=True)
                    row, code, tf = key // len(names), key % len(names), np.add.reduceat(tf[order], first)
                keep = tf >= min_term_freq
                row, code, tf = row[keep], code[keep], tf[keep]
                weight = tf * idfs[code]
                order = np.lexsort((code, -weight.astype(np.float32), row))
                rank = np.arange(len(order)) - np.searchsorted(row[order], row[order]) + 1
                best, rank = order[rank <= max_terms], rank[rank <= max_terms]
                code = code[best]
                found = [rank, names.take(pa.array(code)), tf[best], idfs[code], weight[best]]
                page_id = batch.column("page_id").take(pa.array(row[best]))
                yield pa.RecordBatch.from_arrays([page_id, *(pa.array(c, t) for c, t in zip(found, kinds.values()))], names=["page_id", *kinds])

    kind = counted.schema["page_id"].dataType.simpleString()
    return counted.select("page_id", "counts").mapInArrow(chosen, f"page_id {kind}, rank int, term string, tf int, idf double, weight double")


def _lexicon(spoken: DataFrame, index: Index, known: DataFrame) -> tuple[DataFrame, int]:
    """``(term, stem, idf)`` of the words ``spoken(term)`` on pages whose stem can be asked for, and its bytes.

    Written down so that its size is known: in most cases it is given to every task, and the words of the pages are not
    shuffled to meet it.
    """
    lexicon = materialize(
        index.spark,
        lambda: stem_vocabulary(spoken).join(known.withColumnRenamed("term", "stem"), "stem").select("term", "stem", "idf"),
        scratch_path(index.spark, "lexicon"),
    )
    rows, letters = lexicon.agg(F.count("*"), F.sum(F.octet_length("term") + F.octet_length("stem"))).first()
    return lexicon, rows * ROW_BYTES + (letters or 0)


def page_queries(terms: DataFrame) -> DataFrame:
    """``(page_id, query_a, query_b, terms, squares, scale)``: one query per page.

    ``squares`` are the squared idf of the terms, what a query brings to the impacts of their postings.
    ``scale`` holds the factors common to all documents: the query norm
    ``1 / sqrt(sum(idf^2))`` over the number of terms asked.
    """
    chosen = F.sort_array(F.collect_list(F.struct("term", "idf")))
    squares = F.aggregate("chosen", F.lit(0.0), lambda total, c: total + c["idf"] * c["idf"])
    return (
        terms.groupBy("page_id")
        .agg(chosen.alias("chosen"))
        .select(
            "page_id", F.col("chosen.term").alias("terms"), F.transform("chosen", lambda c: c["idf"] * c["idf"]).alias("squares"),
            (1.0 / F.sqrt(squares) / F.size("chosen")).alias("scale"),
        )
        .select(
            "page_id",
            F.xxhash64("terms").alias(QUERY[0]),
            F.xxhash64(F.lit(1), "terms").alias(QUERY[1]),
            "terms",
            "squares",
            "scale",
        )
    )


def query_hits(asked: DataFrame, index: Index, k: int = MAX_HITS) -> DataFrame:
    """``(query_a, query_b, file_no, score, rank)``: the ``k`` best files of each query.

    ``asked`` is a stored ``page_queries`` table. A score is
    ``matched / asked * query norm * sum(idf^2 * impact)``; ties go by file name.
    """
    queries = asked.groupBy(*QUERY).agg(
        F.first("terms").alias("terms"), F.first("squares").alias("squares"), F.first("scale").alias("scale")
    )
    n_asked = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    best = [rank_value(F.col("score")).desc()]
    if n_asked * index.whole_length > PAIRED_ROWS:
        queries = materialize(index.spark, lambda: queries, scratch_path(index.spark, "distinct"))
        hits = materialize(index.spark, lambda: best_in_tiles(queries, _asked_lists(queries, index), k), scratch_path(index.spark, "hits"))
    elif index.n_shards == 1:
        hits = _best_documents(queries, n_asked, index, k)
    else:
        queries = materialize(index.spark, lambda: queries, scratch_path(index.spark, "distinct"))
        with _dealt_by_tile(index.spark):
            hits = materialize(index.spark, lambda: _best_documents(queries, n_asked, index, k), scratch_path(index.spark, "hits"))
    if index.n_documents == index.n_files:
        return hits.select(*QUERY, F.col("doc_no").alias("file_no"), "score", "rank")
    # No query can take more than the k first copies of a document.
    copies = top_per_group(index.files.select("doc_no", "file_no"), ["doc_no"], [F.col("file_no")], k)
    every = hits.select(*QUERY, "doc_no", "score").join(copies.drop("rank"), "doc_no")
    return top_per_group(every, QUERY, [*best, F.col("file_no")], k).select(
        *QUERY, "file_no", "score", "rank"
    )


def _asked_lists(queries: DataFrame, index: Index) -> Index:
    """``index`` with the lists of terms that any query asks; others need not meet the queries."""
    asked = queries.select(F.explode("terms").alias("term")).distinct()
    terms = _small(materialize(index.spark, lambda: asked, scratch_path(index.spark, "asked-terms")), index.term_bytes)
    heads, tails = (None if lists is None else lists.join(terms, "term", "left_semi") for lists in (index.heads, index.tails))
    return replace(index, heads=heads, tails=tails)


def _best_documents(queries: DataFrame, n_asked: int, index: Index, k: int) -> DataFrame:
    """``(*QUERY, doc_no, score, rank)``: the ``k`` best documents of all shards."""
    if index.n_tails:
        sums = _sums_with_tails(queries, n_asked, index, k)
    else:
        sums = _head_sums(_in_shards(queries, index), n_asked, index, ["scale"])
    scored = sums.withColumn("score", F.col("scale") * F.col("matched") * F.col("impact"))
    order = [rank_value(F.col("score")).desc(), F.col("doc_no")]
    return top_per_group(scored, QUERY, order, k).select(*QUERY, "doc_no", "score", "rank")


def _in_shards(queries: DataFrame, index: Index) -> DataFrame:
    """``queries``, once for each ``shard``."""
    if index.n_shards == 1:
        return queries.withColumn("shard", F.lit(0))
    return queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(index.n_shards - 1))))


def _head_sums(asked: DataFrame, n_asked: int, index: Index, carried: list[str]) -> DataFrame:
    """``(tile, *QUERY, shard, *carried, doc_no, impact, matched)`` from the heads of the terms of
    ``asked(*QUERY, shard, terms, squares, *carried)``, summed where queries and shard meet."""
    kept = [*QUERY, "shard", *carried]
    if index.n_shards == 1:
        heads = _small(index.heads.select("term", "entries"), index.head_entries * ENTRY_BYTES + index.term_bytes)
        pairs = _spread(asked, n_asked, index).select(*kept, F.lit(0).alias("tile"), _asked_terms()).join(heads, "term")
    else:
        # Pairs of one tile are what a task makes; a list is repeated for each block of queries.
        blocks = max(1, math.ceil(n_asked * index.list_length / PAIRS_PER_TASK))
        n_tasks = max(index.spark.sparkContext.defaultParallelism, index.n_shards * blocks)
        n_tasks += n_tasks == int(index.spark.conf.get("spark.sql.shuffle.partitions"))
        block = F.pmod(F.xxhash64(F.lit("block"), *QUERY), F.lit(blocks)).cast("int")
        tiled = asked.withColumn("tile", F.col("shard") * blocks + block).repartition(n_tasks, "tile")
        heads = index.heads.select("term", "entries", "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        heads = heads.select("term", "entries", (F.col("shard") * blocks + F.col("block")).alias("tile")).repartition(n_tasks, "tile")
        pairs = tiled.select(*kept, "tile", _asked_terms()).join(heads, ["tile", "term"])
    return (
        pairs.select("tile", *kept, "square", F.inline("entries"))
        .groupBy("tile", *kept, "doc_no")
        .agg(F.sum(F.col("square") * F.col("impact")).alias("impact"), F.count("*").alias("matched"))
    )


def _asked_terms() -> Column:
    """``(term, square)`` of a query, one row each."""
    return F.inline(F.zip_with("terms", "squares", lambda t, s: F.struct(t.alias("term"), s.alias("square"))))


def _needed(found: DataFrame, k: int) -> DataFrame:
    """``(*QUERY, needed)``: the k-th highest ``matched * impact`` that each query has in the heads of all shards.

    Only the first ``k`` of each tile, by their ``place`` there, can be among them.
    """
    reach = found.where(F.col("place") <= k).select(*QUERY, (F.col("matched") * F.col("impact")).alias("needed"))
    return top_per_group(reach, QUERY, [F.col("needed").desc()], k).where(F.col("rank") == k).drop("rank")


def _decided(bounded: DataFrame, needed: DataFrame) -> DataFrame:
    """``bounded(*QUERY, shard, tails, ...)`` with the tails that stay closed in each shard: those of lowest bounds,
    while all of them together fall short of what is needed."""
    fall_short = F.filter(
        F.sequence(F.lit(1), F.size("tails")),
        lambda j: j * _total(F.slice("tails", 1, j)) < F.col("needed") * _SLACK,
    )
    return (
        bounded.join(needed, QUERY, "left")
        .withColumn("needed", F.coalesce("needed", F.lit(0.0)))
        .withColumn("n_closed", F.when(F.size("tails") > 0, F.size(fall_short)).otherwise(0))
        .withColumn("closed", F.slice("tails", 1, F.col("n_closed")))
        .withColumn("closed_sum", _total(F.col("closed")))
    )


def _total(tails: Column) -> Column:
    return F.aggregate(tails, F.lit(0.0), lambda acc, t: acc + t["tail_max"])


def _with_tails(queries: DataFrame, index: Index) -> DataFrame:
    """``queries`` in each ``shard``, with ``tails``: the terms that have a tail there, and its highest
    impact, from the lowest on."""
    maxima = _small(index.tail_maxima.select("term", "shard", "tail_max"), index.n_tail_maxima * ROW_BYTES)
    in_tail = (
        queries.select(*QUERY, _asked_terms())
        .join(maxima, "term")
        .withColumn("tail_max", F.col("tail_max") * F.col("square"))
        .groupBy(*QUERY, "shard")
        .agg(F.sort_array(F.collect_list(F.struct("tail_max", "term", "square"))).alias("tails"))
    )
    no_tails = F.array().cast("array<struct<tail_max: double, term: string, square: double>>")
    return _in_shards(queries, index).join(in_tail, [*QUERY, "shard"], "left").withColumn("tails", F.coalesce("tails", no_tails))


def _sums_with_tails(queries: DataFrame, n_asked: int, index: Index, k: int) -> DataFrame:
    """Complete sums of every document that can be among the ``k`` best.

    A document that is in none of the lists opened for a query in its shard matches at most the ``j``
    tails left closed there, so ``matched * impact`` is at most ``j * sum(tail_max)``.
    """
    tails = index.tails.select("term", "shard", "doc_no", "impact")
    bounded = materialize(index.spark, lambda: _with_tails(queries, index), scratch_path(index.spark, "bounded"))
    if index.n_shards == 1:
        # A constant costs nothing as a key.
        bounded, tails = (table.withColumn("shard", F.lit(0)) for table in (bounded, tails))

    # What the heads of one tile give is kept if it can reach the tile's own k-th; all that is among the k best
    # of all shards is there, and gives the bound that holds everywhere.
    reach = F.col("matched") * F.col("impact")
    by_reach = Window.partitionBy("tile", *QUERY).orderBy(reach.desc())
    heads = _head_sums(
        bounded.withColumn("n_tails", F.size("tails")).withColumn("tail_sum", _total(F.col("tails"))), n_asked, index, ["scale", "n_tails", "tail_sum"]
    )
    placed = heads.withColumn("place", F.row_number().over(by_reach)).withColumn(
        "needed",
        F.coalesce(F.max(F.when(F.col("place") == k, reach)).over(Window.partitionBy("tile", *QUERY)), F.lit(0.0)),
    )
    possible = (F.col("matched") + F.col("n_tails")) * (F.col("impact") + F.col("tail_sum"))
    found = materialize(
        index.spark,
        lambda: placed.where(possible >= F.col("needed") * _SLACK).select(*QUERY, "scale", "shard", "doc_no", "impact", "matched", "place"),
        scratch_path(index.spark, "found"),
    )

    decided = materialize(
        index.spark,
        lambda: _decided(bounded, _needed(found, k)).select(*QUERY, "shard", "scale", "needed", "n_closed", "closed", "closed_sum", "tails"),
        scratch_path(index.spark, "decided"),
    )
    opened = (
        _spread(decided, n_asked, index).select(
            *QUERY, "shard", "scale",
            F.explode(F.slice("tails", F.col("n_closed") + 1, F.size("tails"))).alias("tail"),
        )
        .select(*QUERY, "shard", "scale", "tail.term", "tail.square")
        .join(tails, ["shard", "term"])
        .select(*QUERY, "scale", "shard", "doc_no", (F.col("square") * F.col("impact")).alias("impact"), F.lit(1).cast("long").alias("matched"))
    )
    candidates = (
        found.drop("place").unionByName(opened)
        .groupBy(*QUERY, "scale", "shard", "doc_no")
        .agg(F.sum("impact").alias("impact"), F.sum("matched").alias("matched"))
        .join(decided.select(*QUERY, "shard", "needed", "n_closed", "closed", "closed_sum"), [*QUERY, "shard"])
    )
    possible = (F.col("matched") + F.col("n_closed")) * (F.col("impact") + F.col("closed_sum"))

    # What closed tails add is looked up by (document, term). The first row of a candidate
    # has no term and carries its sums.
    sums = F.struct(F.lit(None).cast("double").alias("tail_max"), F.lit(None).cast("string").alias("term"), F.lit(None).cast("double").alias("square"))
    asked = F.concat(F.array(sums), F.col("closed"))
    rows = (
        candidates.where(possible >= F.col("needed") * _SLACK)
        .select(*QUERY, "scale", "doc_no", "impact", "matched", F.explode(asked).alias("asked"))
        .select(*QUERY, "scale", "doc_no", "impact", "matched", "asked.term", "asked.square")
        .join(tails.select("term", "doc_no", F.col("impact").alias("added")), ["term", "doc_no"], "left")
        .withColumn("added", F.col("square") * F.col("added"))
    )
    is_sum = F.col("term").isNull()
    return rows.groupBy(*QUERY, "scale", "doc_no").agg(
        F.sum(F.when(is_sum, F.col("impact")).otherwise(F.coalesce("added", F.lit(0.0)))).alias("impact"),
        F.sum(F.when(is_sum, F.col("matched")).otherwise(F.col("added").isNotNull().cast("long"))).alias("matched"),
    )
