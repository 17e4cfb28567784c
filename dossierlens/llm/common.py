"""Helpers the operators of this package share."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stored import scratch_path

BROADCAST_BYTES = 64 << 20
"""Most bytes of a counted table that are broadcast; larger ones are joined by a shuffle."""


SALT_ROWS = 1000
"""Rows of one key that are never dealt to several tasks."""

BATCH_ROWS = 1000


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new table in the shared folder and read back.

    This cuts the lineage with files that outlive any executor, and gives the optimizer
    the true size of the table.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(table: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``table`` with a broadcast hint if its counted rows are within the bound."""
    return F.broadcast(table) if rows * row_bytes <= BROADCAST_BYTES else table


def tasks_of(spark: SparkSession, rows: int, rows_per_task: int) -> int:
    """How many tasks ``rows`` are dealt to, no fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / rows_per_task))


def salted_join(many: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """``many`` joined with ``few``, which has at most one row per key, without a hot task.

    A key with more rows in ``many``, a stored table, than a task has on average is dealt to several tasks, and its row
    of ``few`` is repeated there. There are fewer such keys than tasks, so their list is broadcast.
    """
    tasks = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot_at = max(SALT_ROWS, math.ceil(many.count() / tasks))
    counts = many.groupBy(*keys).agg(F.count("*").alias("_n"))
    hot = F.broadcast(counts.where(F.col("_n") > hot_at).select(*keys, F.ceil(F.col("_n") / hot_at).alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1).cast("long"))
    dealt = many.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*many.columns), parts)).drop("_parts")
    every = few.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    return dealt.join(every, [*keys, "_salt"]).drop("_salt")


def read_documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The named columns of ``documents``."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on hands Python at most ``BATCH_ROWS`` rows at a time.

    Texts can be long, and a batch stands in the memory of both Spark and Python.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches cut to at most ``rows`` rows, so that a task holds few long texts twice."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


class Bounded(dict):
    """A cache for what a Python worker computes again and again; emptied when full."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def put(self, key, value):
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value
