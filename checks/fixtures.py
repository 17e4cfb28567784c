"""Article pages and case documents made from the given tables.

The same expressions, as text, serve Spark and the SQL check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierlens.functions.rows import computed_once

BODY = """
replace(replace(text, '&', '&amp;'), '<', '&lt;')
|| case when doc_id % 13 = 0 then '' else
     chr(10) || '[[Category:lang  ' || lang || ']]'
  || chr(10) || '[[Category: ' || source || case when doc_id % 3 = 0 then '|*' else '' end || ']]'
  || case when doc_id % 11 = 0 then chr(10) || '[[Category:Lang ' || lang || ' ]]' else '' end
   end
"""

RECORD = f"""
chr(10) || '  <page>' || chr(10) || '    <title>doc ' || doc_id || '</title>'
|| case when doc_id % 17 = 0 then chr(10) || '    <redirect />' else '' end
|| chr(10) || '    <revision>' || chr(10) || '      <text xml:space="preserve">' || {BODY} || '</text>'
|| chr(10) || '    </revision>' || chr(10) || '  </page>'
"""


FORMS = """
chr(10) || 'Ann.B-' || {id} || '@mail.example.org O''Neil''s state''s U.S.A. u.s.a at&t rock''n''roll www.site.org. ' || {id} || '.5 x2''y a.b@c end.Next Ann.b@'
"""
"""Word forms, as text that serves Spark and the SQL check."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, spread out if its files split into fewer tasks than there are cores.

    The test files hold one row group each; tables of a size that matters have more splits
    than cores and are read as they are.
    """
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(4 * cores) if rows.rdd.getNumPartitions() < cores else rows


def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(page_id, value)``: a page record of every row of ``documents``."""
    record = computed_once(F.expr(RECORD)).alias("value")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), record)


def benchmark_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(filename, text)``: every benchmark item as a case document."""
    return table(spark, sf_dir, "benchmark").selectExpr("'case/' || item_id as filename", "text")


def conversation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(filename, text)``: every conversation as a case document, turns in order."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "text")))
    text = F.array_join(F.transform(turns, lambda t: t["text"]), "\n")
    return (
        table(spark, sf_dir, "conversations")
        .groupBy("conv_id")
        .agg(text.alias("text"))
        .select(F.concat(F.lit("conv/"), F.col("conv_id")).alias("filename"), "text")
    )
