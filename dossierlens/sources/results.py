"""Tab-separated result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _ordered(rows: DataFrame, order_by: list[str] | None) -> DataFrame:
    return rows.orderBy(*order_by) if order_by else rows


def write_weights(
    weights: DataFrame, path: str, mode: str = "errorifexists", order_by: list[str] | None = None
) -> None:
    """Write ``category<TAB>weight`` lines. Plain text, as a CSV writer would quote names."""
    line = F.concat_ws("\t", "category", F.col("weight").cast("string"))
    _ordered(weights, order_by).select(line.alias("value")).write.mode(mode).text(path)


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """Read ``(category, weight)`` from all parts that ``write_weights`` left."""
    fields = F.split("value", "\t")
    return spark.read.text(path).select(
        F.get(fields, F.lit(0)).alias("category"),
        F.get(fields, F.lit(1)).cast("double").alias("weight"),
    )


def write_context(
    rendered: DataFrame, path: str, mode: str = "overwrite", order_by: list[str] | None = None
) -> None:
    """Write ``filename<TAB>rendered`` lines, in place of an earlier result."""
    line = F.concat_ws("\t", "filename", "rendered")
    _ordered(rendered, order_by).select(line.alias("value")).write.mode(mode).text(path)
