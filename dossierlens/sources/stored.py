"""Tables kept between jobs, and the folder for those nobody named a path for."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "_manifest"
"""The name, in a fingerprinted table's folder, of the place that says which data are current and what for."""

PACKING = "zstd"
"""How tables are compressed, whatever the session's default: texts take about two thirds of the room they take by Spark's own."""

_local_scratch: tempfile.TemporaryDirectory | None = None


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared checkpoint folder.

    Only a local session without ``spark.checkpoint.dir`` (a test, a notebook) gets a
    temporary folder of this machine instead; it goes when the process ends.
    """
    global _local_scratch
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        if _local_scratch is None:
            _local_scratch = tempfile.TemporaryDirectory(prefix="dossierlens-")
        base = _local_scratch.name
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a finished job left its success mark at ``path``."""
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def _current_data(spark: SparkSession, path: str, fingerprint: str) -> str | None:
    """The folder of the data that the manifest at ``path`` names for ``fingerprint``."""
    manifest = f"{path}/{MANIFEST}"
    if not is_complete(spark, manifest):
        return None
    name, _, made_for = "\n".join(r[0] for r in spark.read.text(manifest).collect()).partition("\t")
    return f"{path}/{name}" if made_for == fingerprint and is_complete(spark, f"{path}/{name}") else None


def is_current(spark: SparkSession, path: str, fingerprint: str | None) -> bool:
    """Whether ``path`` holds a finished table, made for ``fingerprint`` if that is given."""
    return is_complete(spark, path) if fingerprint is None else _current_data(spark, path, fingerprint) is not None


def files_fingerprint(spark: SparkSession, path: str | list[str], *settings) -> str:
    """A digest of the names, sizes and times of the files below ``path``, and of settings."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .load(path)
        .select(F.xxhash64("path", "length", "modificationTime").alias("h"))
        .agg(F.count("*"), F.bit_xor("h"), F.sum(F.pmod("h", F.lit(1 << 31))))
    )
    return f"{'/'.join(map(str, files.first()))} {settings}"


def rows_fingerprint(rows: DataFrame, *settings) -> str:
    """A digest of all rows, whatever their order, and of settings."""
    h = F.xxhash64(*rows.columns)
    found = rows.agg(F.count("*"), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 31)))).first()
    return f"{'/'.join(map(str, found))} {settings}"


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that this run made and has no further reader."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def materialize(
    spark: SparkSession,
    compute: Callable[[], DataFrame],
    path: str,
    if_exists: str = "reuse",
    fingerprint: str | None = None,
    partition_by: list[str] | None = None,
    schema: str | None = None,
) -> DataFrame:
    """The table at ``path``, computed and written first where needed.

    ``reuse`` takes a finished table as it is; one without its success mark is written
    again. ``overwrite`` always replaces it. Reading the table back cuts the lineage and gives the
    optimizer its size. A table in folders by ``partition_by`` needs its ``schema`` to be read
    when it is empty.

    With a ``fingerprint`` of its inputs, data go to a new folder in ``path``, and a manifest written last
    names folder and fingerprint together. A run that is lost at any time leaves the
    former manifest with the data it names, or none; data that no manifest names are never
    read, and go when the next ones are in place.
    """
    if if_exists not in ("reuse", "overwrite"):
        raise ValueError(f"if_exists must be 'reuse' or 'overwrite', not {if_exists!r}")
    place = path if fingerprint is None else _current_data(spark, path, fingerprint)
    if if_exists == "overwrite" or place is None or not is_complete(spark, place):
        if fingerprint is None:
            compute().write.mode("overwrite").parquet(path, partitionBy=partition_by, compression=PACKING)
        else:
            name = f"made-{uuid.uuid4().hex}"
            place = f"{path}/{name}"
            compute().write.parquet(place, partitionBy=partition_by, compression=PACKING)
            spark.range(1).select(F.lit(f"{name}\t{fingerprint}")).write.mode("overwrite").text(f"{path}/{MANIFEST}")
            _drop_others(spark, path, name)
    return (spark.read.schema(schema) if schema else spark.read).parquet(place)


def _drop_others(spark: SparkSession, path: str, name: str) -> None:
    """Delete the data in ``path`` that the manifest no longer names."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in system.listStatus(folder):
        if found.getPath().getName() not in (name, MANIFEST):
            system.delete(found.getPath(), True)
