"""The term tables of a case collection.

``postings``, ``doc_stats`` and ``term_stats`` are the plain tables. ``build_index`` writes
the form the similarity join reads:

* ``files(file_no, filename, doc_no)``: numbers follow the order of file names, so ranking
  ties by number is ranking them by name. Files with the same words share one ``doc_no``,
  the lowest of their numbers, and are scored once.
* ``terms(term, df, idf)``.
* ``heads(term, entries, shard)``: the postings of highest impact of each term, at most
  ``head_size`` of them over all shards, packed in one row per shard.
* ``tails(term, doc_no, impact, shard)``: all other postings, one row each.
* ``bounds(term, head_level, tail_max)``: the lists that have a tail, and where it begins.
* ``tail_maxima(term, shard, tail_max)``: the highest impact of each tail in each shard.

Heads and tails are written in a folder per shard, so that a job reads only its own.

Documents are dealt to as many shards as it takes for the postings of one shard to be
broadcast. A document is in one shard only, so its score never needs another one.

The impact ``sqrt(tf) * norm`` is what a posting by itself adds to a score; the query brings ``idf^2``, so
postings never meet the table of terms. Texts are taken apart where they are read: names alone are sorted
for the numbers, and no exchange holds a text.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rows import let
from ..functions.scoring import NORMS, idf
from ..functions.words import word_counts, words
from ..sources.stored import is_current, materialize, scratch_path
from .ranking import places_within
from .terms import stem_vocabulary, term_counts

HEAD_SIZE = 65_536
"""Most postings of a term, in the whole collection, that every query asking it is paired with."""

HEADS = "term string, entries array<struct<doc_no: long, impact: double>>, shard int"
TAILS = "term string, doc_no long, impact double, shard int"

BROADCAST_BYTES = 256 << 20
BOUND_BYTES = 64
"""What a row of ``bounds`` takes when it is broadcast; there are at most postings / head size of them."""

NUMBER_BYTES = 64
"""What a row's number takes when it is broadcast."""

SHARD_ENTRIES = 4_000_000
"""Postings per shard: 64 MB of numbers, and what a task can hold of an index."""


def postings(case_docs: DataFrame) -> DataFrame:
    """``(term, filename, tf)``."""
    return term_counts(case_docs, "filename", "text").select("term", "filename", "tf")


def doc_stats(case_docs: DataFrame) -> DataFrame:
    """``(filename, len)``: words per document, repeats included."""
    return case_docs.select("filename", F.size(words(F.col("text"))).alias("len"))


def term_stats(case_docs: DataFrame) -> DataFrame:
    """``(term, df, idf)`` over all documents."""
    # Every document also counts under a null term, whose sum is the size of the collection.
    found = F.concat(F.array_distinct(words(F.coalesce("text", F.lit("")))), F.array(F.lit(None).cast("string")))
    counts = case_docs.select(F.explode(found).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n_docs = counts.where("term is null").select(F.col("df").alias("n_docs"))
    return counts.where("term is not null").crossJoin(F.broadcast(n_docs)).select(
        "term", "df", idf(F.col("df"), F.col("n_docs")).alias("idf")
    )


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    files: DataFrame
    terms: DataFrame
    heads: DataFrame
    tails: DataFrame | None
    bounds: DataFrame | None
    tail_maxima: DataFrame | None
    n_shards: int
    head_entries: int
    """Packed entries in the heads of the largest shard."""
    n_tails: int
    """Terms with a tail."""
    n_tail_maxima: int
    n_files: int
    n_documents: int
    n_terms: int
    term_bytes: int
    list_length: float
    """Entries a shard's head has on average, seen from a posting drawn at random."""
    n_entries: int
    whole_length: float
    """Entries of a whole list, over all shards, seen likewise."""
    stem: bool
    apostrophes: bool
    forms: bool


def build_index(
    case_docs: DataFrame,
    path: str | None = None,
    stem: bool = True,
    norm: str = "exact",
    apostrophes: bool = False,
    head_size: int = HEAD_SIZE,
    shard_entries: int = SHARD_ENTRIES,
    if_exists: str = "reuse",
    fingerprint: str | None = None,
    forms: bool | None = None,
) -> Index:
    """Write the tables of ``case_docs(filename, text)`` below ``path`` and open them.

    Words are the analyzer's forms (see ``words``) unless ``forms`` is false or ``apostrophes`` is asked for.

    Settings are part of the folder name, so a finished index is reused only for the
    settings it was built with, and only for the ``fingerprint`` of its documents if one is
    given. A step that has to be written again also replaces the steps that follow from it.
    """
    if norm not in NORMS:
        raise ValueError(f"norm must be one of {sorted(NORMS)}, not {norm!r}")
    spark = case_docs.sparkSession
    forms = not apostrophes if forms is None else forms
    rule = ["forms"] if forms else ["apostrophes"] if apostrophes else []
    settings = ["stems" if stem else "words", *rule, norm, str(head_size), str(shard_entries)]
    folder = f"{path or scratch_path(spark, 'index')}/{'-'.join(settings)}"
    replace = if_exists == "overwrite"

    def stored(name: str, compute: Callable[[], DataFrame], schema: str | None = None) -> DataFrame:
        nonlocal replace
        replace = replace or not is_current(spark, f"{folder}/{name}", fingerprint)
        return materialize(spark, compute, f"{folder}/{name}", "overwrite" if replace else "reuse", fingerprint, ["shard"] if schema else None, schema)

    counted = stored("counted", lambda: _counted(case_docs, apostrophes, forms))
    documents = stored("documents", lambda: _numbered(_stem_counts(counted) if stem else counted, _numbers(counted), counted.count()))
    n_files, n_documents = documents.agg(F.count("*"), F.count_distinct("content")).first()
    files = stored("files", lambda: _files(documents)) if n_documents < n_files else _own_files(documents)
    contents = _contents(documents, n_documents < n_files)
    terms = stored("terms", lambda: _terms(contents, n_files))
    n = F.col("n_entries")
    letters = F.sum(F.octet_length("term"))
    sizes = terms.agg(F.count("*"), F.sum(n), F.max(n), F.sum(n.cast("double") * n), letters).first()
    n_terms, n_entries, longest, squares, letters = (value or 0 for value in sizes)

    n_shards = max(1, math.ceil(n_entries / shard_entries))
    tails = bounds = maxima = None
    n_tails = 0
    if longest <= head_size:
        heads = stored("heads", lambda: _packed(_by_shard(_entries(contents, NORMS[norm], n_shards), n_shards)), HEADS)
    else:
        entries = stored("entries", lambda: _entries(contents, NORMS[norm], n_shards))
        bounds = stored("bounds", lambda: _bounds(entries, head_size))
        n_tails = bounds.count()
        split = _split(entries, F.broadcast(bounds) if n_tails * BOUND_BYTES <= BROADCAST_BYTES else bounds)
        tails = stored("tails", lambda: _by_shard(split.where("not in_head").select("shard", "term", "doc_no", "impact"), n_shards), TAILS)
        maxima = stored("tail-maxima", lambda: tails.groupBy("term", "shard").agg(F.max("impact").alias("tail_max")))
        heads = stored("heads", lambda: _packed(_by_shard(split.where("in_head"), n_shards)), HEADS)
    in_shards = heads.groupBy("shard").agg(F.sum(F.size("entries")).alias("n"))
    return Index(
        spark=spark,
        files=files,
        terms=terms.select("term", "df", "idf"),
        heads=heads,
        tails=tails,
        bounds=bounds,
        tail_maxima=maxima,
        n_shards=n_shards,
        head_entries=in_shards.agg(F.max("n")).first()[0] or 0,
        n_tails=n_tails,
        n_tail_maxima=maxima.count() if maxima is not None else 0,
        n_files=n_files,
        n_documents=n_documents,
        n_terms=n_terms,
        term_bytes=64 * n_terms + letters,
        list_length=min(head_size, squares / n_entries) / n_shards if n_entries else 0.0,
        n_entries=n_entries,
        whole_length=squares / n_entries if n_entries else 0.0,
        stem=stem,
        apostrophes=apostrophes,
        forms=forms,
    )


def _content() -> Column:
    return F.coalesce(F.sha2(F.to_json("counts"), 256), F.lit("no words"))


def _counted(case_docs: DataFrame, apostrophes: bool = False, forms: bool = False) -> DataFrame:
    """``(row, filename, len, counts)``: documents counted where they are read; ``row`` is any number of their own."""
    found = words(F.col("text"), apostrophes, forms=forms)
    return case_docs.select(
        F.monotonically_increasing_id().alias("row"),
        "filename",
        F.inline(F.array(let(found, lambda w: F.struct(F.size(w).alias("len"), word_counts(w).alias("counts"))))),
    )


def _numbers(counted: DataFrame) -> DataFrame:
    """``(row, file_no)``: the places of rows in the order of names."""
    return places_within(counted.select("filename", "row"), [], ["filename", "row"], "file_no").select("row", "file_no")


def _numbered(counted: DataFrame, numbers: DataFrame, n_rows: int = 0) -> DataFrame:
    """``(file_no, filename, len, counts, content)``. Numbers come to the counts, which are not moved, while they can be broadcast."""
    numbers = F.broadcast(numbers) if n_rows * NUMBER_BYTES <= BROADCAST_BYTES else numbers
    return counted.join(numbers, "row").select("file_no", "filename", "len", "counts", _content().alias("content"))


def _stem_counts(counted: DataFrame) -> DataFrame:
    """``counted`` with words replaced by their stems. Rows are the key, as names may repeat."""
    lexicon = stem_vocabulary(counted.select(F.explode("counts.term").alias("term")).distinct())
    stems = (
        counted.select("row", F.inline("counts"))
        .join(lexicon, "term")
        .groupBy("row", F.col("stem").alias("term"))
        .agg(F.sum("tf").cast("int").alias("tf"))
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("term", "tf"))).alias("counts"))
    )
    return counted.select("row", "filename", "len").join(stems, "row", "left")


def _contents(documents: DataFrame, has_copies: bool = True) -> DataFrame:
    """``(doc_no, copies, len, counts)``: one row for all files with the same word counts."""
    if not has_copies:
        return documents.select(
            F.col("file_no").alias("doc_no"), F.lit(1).cast("long").alias("copies"), "len", "counts"
        )
    same = documents.groupBy("content").agg(
        F.min("file_no").alias("doc_no"), F.count("*").alias("copies")
    )
    return same.join(
        documents.select("file_no", "len", "counts"), F.col("doc_no") == F.col("file_no")
    ).select("doc_no", "copies", "len", "counts")


def _own_files(documents: DataFrame) -> DataFrame:
    """``(file_no, filename, doc_no)`` where no two files have the same words."""
    return documents.select("file_no", "filename", F.col("file_no").alias("doc_no"))


def _files(documents: DataFrame) -> DataFrame:
    """``(file_no, filename, doc_no)``."""
    named = documents.select("file_no", "filename", "content")
    same = named.groupBy("content").agg(F.min("file_no").alias("doc_no"))
    return named.join(same, "content").select("file_no", "filename", "doc_no")


def _terms(contents: DataFrame, n_files: int) -> DataFrame:
    return (
        contents.select("copies", F.inline("counts"))
        .groupBy("term")
        .agg(F.sum("copies").alias("df"), F.count("*").alias("n_entries"))
        .withColumn("idf", idf(F.col("df"), n_files))
    )


def _entries(contents: DataFrame, norm, n_shards: int) -> DataFrame:
    """``(shard, term, doc_no, impact)`` of every posting, made where the counts are."""
    shard = F.pmod(F.xxhash64("doc_no"), F.lit(n_shards)).cast("int").alias("shard")
    return contents.select(shard, "doc_no", norm(F.col("len")).alias("norm"), F.inline("counts")).select(
        "shard", "term", "doc_no", (F.sqrt("tf") * F.col("norm")).alias("impact")
    )


def _level(impact: Column) -> Column:
    """Quarter-octave of an impact: a coarse rank that needs no sort of the postings."""
    return F.floor(F.log2(impact) * 4)


def _bounds(entries: DataFrame, head_size: int) -> DataFrame:
    """``(term, head_level, tail_max)`` of the lists with more than ``head_size`` postings.

    Postings are counted by impact level; the head takes whole levels from the top while
    they fit. At most ``postings / head_size`` lists have a tail, and a list has only as
    many levels as quarter-octaves separate its lowest from its highest impact.
    """
    counts = entries.groupBy("term", _level(F.col("impact")).alias("level")).agg(F.count("*").alias("n"), F.max("impact").alias("top"))
    whole = F.sum("n").over(Window.partitionBy("term"))
    levels = counts.withColumn("whole", whole).where(F.col("whole") > head_size)
    above = Window.partitionBy("term").orderBy(F.col("level").desc())
    placed = levels.withColumn("in_head", F.sum("n").over(above) <= head_size)
    return (
        placed.groupBy("term")
        .agg(
            F.min(F.when(F.col("in_head"), F.col("level"))).alias("head_level"),
            F.max(F.when(~F.col("in_head"), F.col("top"))).alias("tail_max"),
        )
        .where(F.col("tail_max").isNotNull())
    )


def _split(entries: DataFrame, bounds: DataFrame) -> DataFrame:
    """``entries`` with ``in_head``; lists without a bound have no tail."""
    head = F.coalesce(_level(F.col("impact")) >= F.col("head_level"), F.lit(False))
    return entries.join(bounds, "term", "left").withColumn(
        "in_head", F.col("tail_max").isNull() | head
    )


def _by_shard(entries: DataFrame, n_shards: int) -> DataFrame:
    """``entries`` in tasks that write one file for each of their shards, where there are shards enough to keep all
    tasks busy; else every task would write a file for every shard, and files grow with the square of the postings."""
    return entries.repartition("shard") if n_shards >= entries.sparkSession.sparkContext.defaultParallelism else entries


def _packed(heads: DataFrame) -> DataFrame:
    """One row per list; a head holds no more than ``head_size`` entries."""
    entries = F.arrays_zip(F.col("doc_no"), F.col("impact"))
    return collected(heads).select("term", entries.alias("entries"), "shard")


def collected(entries: DataFrame) -> DataFrame:
    """``(shard, term, doc_no, impact)`` with the postings of a list as two arrays, which are shorter on their way than
    one of structs. Both take each row in turn, so their elements belong together by place."""
    return entries.groupBy("shard", "term").agg(F.collect_list("doc_no").alias("doc_no"), F.collect_list("impact").alias("impact"))
