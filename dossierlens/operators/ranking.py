"""Top-k rows per group, and places of rows within groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import scratch_path


def top_per_group(
    rows: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """The first ``k`` rows of each group, numbered in ``rank``.

    The filter on ``row_number`` lets Spark cut every group to ``k`` rows in each map task,
    so a group of any size sends at most ``k`` rows per task to the shuffle.
    """
    numbered = rows.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return numbered.where(F.col(rank) <= k)


def places_within(rows: DataFrame, group: list[str], order: list[str], place: str = "place") -> DataFrame:
    """``rows`` with their place, from 1, in the ascending order (nulls first) of ``order`` in their group.

    See ``dealt_in_order``. An empty ``group`` numbers the whole table. Rows equal in group and order get places in any order.
    """
    dealt, runs = dealt_in_order(rows, group, order, place)
    named = {c: f"_of_{c}" for c in [*group, "_task"]}
    shift = runs.select(*(F.col(c).alias(n) for c, n in named.items()), "_shift")
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(n)) for c, n in named.items()))
    return dealt.join(shift, same).select(*rows.columns, (F.col(place) + F.col("_shift")).alias(place))


def dealt_in_order(rows: DataFrame, group: list[str], order: list[str], place: str = "place") -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``place`` and ``_task``, and ``(*group, _task, _n, _before, _shift)``: a row's place in its group is ``place + _shift``.

    Rows are dealt by ranges of group and order, so a group of any size is spread over as many
    tasks as it fills. Each task numbers its part, and sums of the parts' counts in front of it
    are added. The sorted rows are a written table, so that numbers and parts stay fixed.
    """
    path = scratch_path(rows.sparkSession, "sorted")
    keys = [*group, *order]
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(place, F.monotonically_increasing_id()).write.parquet(path)
    # A number holds the task's above its lower 33 bits.
    dealt = rows.sparkSession.read.parquet(path).withColumn("_task", F.shiftright(place, 33))
    runs = dealt.groupBy(*group, "_task").agg(F.min(place).alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumn("_before", before).withColumn("_shift", F.col("_before") + 1 - F.col("_first")).drop("_first")
    return dealt, runs
