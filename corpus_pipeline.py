"""From raw documents to packed sequences, in five stages.

Each stage takes the documents that the one before kept, as a stored table, and all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierlens.llm import decontamination, language, near_duplicates, packing, secrets
from dossierlens.llm.common import kept, small

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

ORACLE_SQL = None
"""Naive Bayes, the forest and the tokenizer have no SQL; tests compare with brute force."""


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` but those whose id is in ``ids(doc_id)``; rows without an id stay."""
    ids = kept(ids.where("doc_id is not null").distinct(), "dropped")
    return docs.join(small(ids, ids.count(), 16), "doc_id", "left_anti").select(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of no determinable language: null texts and texts without a letter.

    Where no row has a language to learn from, all others stay.
    """
    model = language.train(docs.select("text", "lang"))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    # Other columns go through under names that cannot clash with what is found.
    others = {c: f"_column_{i}" for i, c in enumerate(docs.columns) if c != "text"}
    found = language.identify(docs.select("text", *(F.col(f"`{c}`").alias(n) for c, n in others.items())), model)
    known = found.where(F.col("lang_pred") != language.UNDETERMINED)
    return known.select(*(F.col(others.get(c, "text")).alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least id of each group of near copies, and of rows that share id and text the least one.

    Different texts of one id are one document: they stay or go together.
    """
    found = near_duplicates.near_duplicates(docs)
    left = _without(docs, found.where("not kept").select("doc_id"))
    repeated = kept(left.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    again = small(repeated, repeated.count(), 16)
    least = F.min(F.struct(*docs.columns)).alias("row")
    once = left.join(again, "doc_id", "left_semi").groupBy("doc_id", "text").agg(least).select("row.*").select(*docs.columns)
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, also with other numbers or names."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, decontamination.find_leaks(docs, benchmark).select("doc_id"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; every document stays."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences of 4096 tokens."""
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secret_scan", redact_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
