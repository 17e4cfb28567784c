"""Records that begin with one fixed mark and end with another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rows import computed_once
from .stored import scratch_path

BROADCAST_FILES = 100_000
"""Names of so many files are broadcast; more are joined by a shuffle."""


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    start: str,
    end: str,
    max_bytes: int | None = None,
    anchor: str = "auto",
) -> DataFrame:
    """Read ``(value)``: every record from a ``start`` mark to the next ``end`` mark.

    Both marks stay in the record; text outside is skipped, and so is a record that the file
    does not end. A start mark inside a record is part of it. The result is that of reading each file
    from its first byte to its last, however it is packed and split.

    The text source cuts files (bzip2 ones too, in splits) at end marks. A piece then begins
    outside any record, and holds one at most, from its first start mark on; so no task needs to know what
    another has read. Only the piece behind a file's last end mark is no record, and the reader does
    not tell whether an end mark closed a piece. A first job finds the last piece of each file; where that
    has a start mark, a second one looks for an end mark behind the file's last start mark. Both
    run over splits, and only names of files with an open record come back.

    ``max_bytes`` drops records above that many bytes, marks included: one that has got longer is
    forgotten there, and the next start mark may begin a record before the same end mark. A
    piece is held as a whole, so two gigabytes between two end marks are the most there can be.

    ``anchor`` takes the first job away for callers who know their files: with ``"end"`` an open record at the end
    comes through; ``"start"`` cuts at start marks, for files whose records hold none and have
    no end mark in front of them.
    """
    if not start or not end:
        raise ValueError("both marks must be non-empty")
    if anchor not in ("auto", "start", "end"):
        raise ValueError(f"anchor must be 'auto', 'start' or 'end', not {anchor!r}")
    if start in end or end in start or any(start.endswith(end[:n]) for n in range(1, len(end))):
        raise ValueError("the marks must not overlap")
    value = F.col("value")
    if anchor == "start":
        record = F.concat(F.lit(start), F.substring_index(value, end, 1), F.lit(end))
        records = spark.read.option("lineSep", start).text(path).where(F.contains(value, F.lit(end))).select(computed_once(record).alias("value"))
        return records if max_bytes is None else records.where(F.octet_length("value") <= max_bytes)
    pieces = _pieces(spark, path, end)
    if anchor == "auto":
        left_open = _open_records(spark, path, start, end, pieces)
        if left_open is not None:
            pieces = pieces.join(left_open, ["file", "block", "row"], "left_anti")
    begin = F.locate(start, value)
    if max_bytes is not None:
        begin = _begin_within(value, start, len(end.encode()), max_bytes)
    # Without a place to begin at the record is null, and the row goes.
    record = F.when(begin > 0, F.concat(F.substr(value, begin), F.lit(end)))
    return pieces.where(F.contains(value, F.lit(start))).select(computed_once(record).alias("value"))


def _pieces(spark: SparkSession, path: str | list[str], cut: str) -> DataFrame:
    """``(value, file, block, row)``: what stands between the cuts, in the order of ``block`` and ``row`` in each file."""
    return spark.read.option("lineSep", cut).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
    )


def _last_pieces(pieces: DataFrame, has: str) -> DataFrame:
    """``(file, block, row, has)`` of the last piece of each file."""
    last = F.max(F.struct("block", "row", F.contains("value", F.lit(has)).alias("has")))
    return pieces.groupBy("file").agg(last.alias("last")).select("file", "last.*")


def _open_records(spark: SparkSession, path: str | list[str], start: str, end: str, pieces: DataFrame) -> DataFrame | None:
    """``(file, block, row)`` of the pieces that are an open record at the end of a file; none if there are none."""

    def written(found: DataFrame, name: str) -> tuple[DataFrame, int]:
        place = scratch_path(spark, name)
        found.write.parquet(place)
        table = spark.read.parquet(place)
        return table, table.count()

    doubtful, n = written(_last_pieces(pieces, start).where("has").drop("has"), "last-pieces")
    if not n:
        return None
    small = F.broadcast if n <= BROADCAST_FILES else lambda table: table
    behind = _pieces(spark, path, start).join(small(doubtful.select("file")), "file", "left_semi")
    left_open, n = written(doubtful.join(_last_pieces(behind, end).where("not has").select("file"), "file", "left_semi"), "open-records")
    return (F.broadcast(left_open) if n <= BROADCAST_FILES else left_open) if n else None


def _begin_within(value: Column, start: str, end_bytes: int, max_bytes: int) -> Column:
    """Where the record of a piece begins (from 1, in characters) that has at most ``max_bytes``; 0 if there is none.

    Reading forgets a record as soon as it has more bytes, and only then looks for the next start mark.
    """
    mark = len(start.encode())
    total = F.octet_length(value) + end_bytes
    first = F.locate(start, value)
    fits = F.octet_length(F.substr(value, first)) + end_bytes <= max_bytes
    # Bytes in front of each start mark of the piece: those of the parts before it, and of the marks between.
    parts = F.transform(F.split(value, rf"\Q{start}\E", -1), lambda part: F.octet_length(part))
    before = F.aggregate(
        F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("resume"), F.lit(-1).alias("found")),
        lambda state, length: F.struct(
            (state["at"] + length + mark).alias("at"),
            F.when((state["found"] >= 0) | (state["at"] + length < state["resume"]), state["resume"]).otherwise(state["at"] + length + max_bytes + 1).alias("resume"),
            F.when((state["found"] < 0) & (state["at"] + length >= state["resume"]) & (total - state["at"] - length <= max_bytes), state["at"] + length)
            .otherwise(state["found"]).alias("found"),
        ),
        lambda state: state["found"],
    )
    in_bytes = F.substr(F.encode(value, "utf-8"), F.lit(1), before)
    later = F.when(before >= 0, F.length(F.decode(in_bytes, "utf-8")) + 1).otherwise(0)
    return F.when(fits, first).otherwise(later)
