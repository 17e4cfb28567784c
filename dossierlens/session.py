"""A session with the settings the jobs are written for."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

BYTES_PER_SHUFFLE_PARTITION = 32 << 20
"""Input bytes, which may be compressed, for each partition a shuffle begins with."""


def session(master: str | None = None, shuffle_partitions: int | None = None, **settings: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName("dossierlens")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.parquet.compression.codec", "zstd")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def size_in_bytes(spark: SparkSession, *paths: str) -> int:
    """Bytes of all files below ``paths``."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n_bytes = 0
    for path in map(jvm.org.apache.hadoop.fs.Path, paths):
        system = path.getFileSystem(conf)
        n_bytes += sum(system.getContentSummary(found.getPath()).getLength() for found in system.globStatus(path) or [])
    return n_bytes


def size_shuffles(spark: SparkSession, *paths: str) -> int:
    """Let shuffles begin with as many partitions as the files below ``paths`` ask for.

    Adaptive execution merges partitions but never adds any, so its first number has to fit
    the input. It is set for this session, and no lower than Spark's own.
    """
    n_bytes = size_in_bytes(spark, *paths)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_bytes / BYTES_PER_SHUFFLE_PARTITION))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(n))
    return n
