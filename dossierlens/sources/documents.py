"""A folder of plain-text case documents."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import size_in_bytes

BYTES_PER_TASK = 32 << 20


def read_case_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Read ``(filename, text)``: each file directly in ``folder`` is one document.

    ``filename`` is the path from the folder's parent, such as ``case/one.txt``.
    Sub-folders are not entered. Spark's file listing leaves out names that begin with a
    dot or an underscore, and files of no bytes.
    """
    # Without partition inference, sub-folders of any name are listed alike; the filter on
    # the path leaves their files out before anything is read.
    files = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True)
    # A file counts as 4 MB when Spark deals them out, so small ones would come a few to a task; tasks are as many as the bytes ask for.
    n_tasks = max(4 * spark.sparkContext.defaultParallelism, math.ceil(size_in_bytes(spark, folder) / BYTES_PER_TASK))
    files = files.coalesce(n_tasks)
    # File paths are percent-encoded, but a plus sign in them stands for itself.
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    name = F.substring_index(path, "/", -1)
    parent = F.substr(path, F.lit(1), F.length(path) - F.length(name) - 1)
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    absolute = location.getFileSystem(hadoop).makeQualified(location).toUri().getPath()
    without_store = F.regexp_replace(parent, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return files.where(without_store == F.lit(absolute)).select(
        F.concat(F.lit(location.getName() + "/"), name).alias("filename"),
        F.col("value").alias("text"),
    )
