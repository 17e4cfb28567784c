"""Passages that repeat across documents, by content-defined chunking.

A gear rolling hash over the last 16 bytes cuts each text where the hash says so, so an
insertion moves only the cuts beside it and equal passages fall into equal chunks wherever they
stand. What is matched are stretches: from each chunk on, and up to each chunk, the fewest
chunks that hold enough words. A stretch is matched as a whole, so its parts may stand in
whatever other documents; and as each is matched with its first occurrence only, rows
stay within twice the chunks whatever the number of copies. Matched stretches that meet or overlap on one
diagonal (the same shift between a document and the document of the first occurrence) make a passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, read_documents, slices, small_batches

WINDOW = 16
MEAN_BYTES = 24
"""Of so many positions one may be cut at."""

MIN_BYTES = 12
MAX_BYTES = 1024
MIN_WORDS = 20
"""Words in adjacent matched chunks that make a passage; one cut at the start counts. A passage
loses up to a chunk at either end, so one of 50 words or more is found; a shared line is not."""

_GEAR = np.random.default_rng(9).integers(0, 2**32, 256, dtype=np.uint32)
_WHITE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


def cuts(data: bytes) -> np.ndarray:
    """Ends of the chunks of ``data``.

    Cuts lie at positions whose hash of the last 16 bytes is chosen, at least 12 bytes
    behind the one before; a chunk of 1024 bytes without one is cut there.
    """
    size = len(data)
    if not size:
        return np.empty(0, dtype=np.int64)
    gear = _GEAR[np.frombuffer(data, dtype=np.uint8)]
    # hash[i] = sum of gear[i - k] << k over the window, by doubling.
    span = 1
    while span < WINDOW:
        ahead = gear.copy()
        ahead[span:] += gear[:-span] << np.uint32(span)
        gear, span = ahead, 2 * span
    chosen = np.flatnonzero((gear >> np.uint32(8)) % np.uint32(MEAN_BYTES) == 0) + 1
    ends, last = [], 0
    for end in chosen[chosen < size].tolist():
        if end - last < MIN_BYTES:
            continue
        while end - last > MAX_BYTES:
            last += MAX_BYTES
            ends.append(last)
        if end - last >= MIN_BYTES:
            ends.append(end)
            last = end
    while size - last > MAX_BYTES:
        last += MAX_BYTES
        ends.append(last)
    ends.append(size)
    return np.array(ends)


def _stretches(data: bytes, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of the stretches of ``data``, the words before each, and up to its end.

    How far a stretch goes depends on its own bytes alone: a word that it begins within is
    counted as if it began there.
    """
    ends = cuts(data)
    begins = np.concatenate(([0], ends[:-1])).astype(np.int64)
    if not len(ends):
        return begins[:0], begins[:0], begins[:0], begins[:0]
    black = ~_WHITE[np.frombuffer(data, dtype=np.uint8)]
    begun = np.cumsum(black & ~np.concatenate(([False], black[:-1])))
    before, upto = begun[begins] - black[begins], begun[ends - 1]
    n, every = len(ends), np.arange(len(ends))
    last = np.searchsorted(upto, before + min_words, "left")
    first = np.searchsorted(before, upto - min_words, "right") - 1
    onward, back = last < n, first >= 0
    pairs = np.unique(np.concatenate([every[onward] * n + last[onward], first[back] * n + every[back]]))
    i, j = pairs // n, pairs % n
    return begins[i], ends[j], before[i], upto[j]


def _chunked(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 200):
        ids, digests, starts, sizes, befores, words, firsts = [], [], [], [], [], [], []
        for at, text in enumerate(batch.column("text").to_pylist()):
            data = text.encode("utf-8", "surrogatepass")
            begins, ends, before, upto = _stretches(data, min_words)
            if not len(ends):
                continue
            found = np.array(
                [xxhash.xxh64_intdigest(data[b:e]) for b, e in zip(begins.tolist(), ends.tolist())], dtype=np.uint64
            )
            first = np.zeros(len(found), dtype=bool)
            first[np.unique(found, return_index=True)[1]] = True
            ids.append(np.full(len(found), at))
            digests.append(found.view(np.int64))
            starts.append(begins)
            sizes.append(ends - begins)
            befores.append(before)
            words.append(upto - before)
            firsts.append(first)
        if not ids:
            continue
        column = lambda parts, kind: pa.array(np.concatenate(parts), kind)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(column(ids, pa.int64())),
                column(digests, pa.int64()),
                column(starts, pa.int64()),
                column(sizes, pa.int32()),
                column(befores, pa.int32()),
                column(words, pa.int32()),
                pa.array(np.concatenate(firsts)),
            ],
            names=["doc_id", "digest", "start", "size", "before", "words", "first"],
        )


CHUNKS = "doc_id long, digest long, start long, size int, before int, words int, first boolean"


def chunks(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, digest, start, size, before, words, first)`` of every stretch of chunks;
    ``before`` counts the words in front of it, and ``first`` is not true of what an
    earlier stretch of the same text already holds."""
    texts = small_batches(docs).where("text is not null and doc_id is not null").select("doc_id", "text")
    return texts.mapInArrow(lambda batches: _chunked(batches, min_words), CHUNKS)


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, start, length, n_words, first_doc_id, first_start, is_first)``.

    One row for each passage of ``docs(doc_id, text)`` that an earlier document (by id) holds as
    well, and one with ``is_first`` for each place such a passage was first. A passage is
    the same at both places from end to end; where its parts were first in different documents, rows
    overlap. Positions count UTF-8 bytes; ``n_words`` are the words between start and end.
    Null and empty texts and rows without an id have no passages; a passage that repeats in
    one document only is none; rows that share an id are one document.
    """
    every = kept(chunks(docs, min_words), "chunks")
    owners = every.where("first").groupBy("digest", "size").agg(
        F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.min_by("start", "doc_id").alias("owner_start")
    ).where("owner < last").drop("last")
    owners = kept(owners, "owners")  # as a table, so that the join can split a stretch of a third of all rows
    matched = every.join(owners, ["digest", "size"]).where("doc_id <> owner").select(
        "doc_id", "owner", (F.col("start") - F.col("owner_start")).alias("shift"), "start",
        (F.col("start") + F.col("size")).alias("stop"), "before", (F.col("before") + F.col("words")).alias("upto"),
    )
    diagonal = Window.partitionBy("doc_id", "owner", "shift").orderBy("start", "stop")
    gap = F.col("start") > F.max("stop").over(diagonal.rowsBetween(Window.unboundedPreceding, -1))
    runs = matched.withColumn("gap", F.coalesce(gap, F.lit(False)).cast("int")).withColumn(
        "run", F.sum("gap").over(diagonal.rowsBetween(Window.unboundedPreceding, 0))
    )
    found = kept(
        runs.groupBy("doc_id", "owner", "shift", "run").agg(
            (F.max("upto") - F.min("before")).cast("long").alias("n_words"), F.min("start").alias("start"), F.max("stop").alias("stop")
        ),
        "passages",
    )
    first = F.col("start") - F.col("shift")
    length = F.col("stop") - F.col("start")
    copies = found.select(
        "doc_id", "start", length.alias("length"), "n_words", F.col("owner").alias("first_doc_id"),
        first.alias("first_start"), F.lit(False).alias("is_first"),
    )
    originals = (
        found.groupBy(F.col("owner").alias("doc_id"), first.alias("start"), length.alias("length"))
        .agg(F.max("n_words").alias("n_words"))
        .select("*", F.col("doc_id").alias("first_doc_id"), F.col("start").alias("first_start"), F.lit(True).alias("is_first"))
    )
    return copies.unionByName(originals)


def _whole_characters(data: bytes, first: int, stop: int) -> tuple[int, int]:
    """The stretch of the characters that lie in it as a whole."""
    while first < stop and first < len(data) and data[first] & 0xC0 == 0x80:
        first += 1
    while stop > first and stop < len(data) and data[stop] & 0xC0 == 0x80:
        stop -= 1
    return first, stop


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with every passage cut out of ``text`` but where it was first; rows stay, with all their columns.

    Passages are stretches of bytes: of a character that a passage holds in part nothing is cut. Null texts stay null, and rows that
    share an id are cut at the same places, as ``repeated_passages`` takes them for one document.
    """
    spans_name = "_spans"
    while spans_name in docs.columns:
        spans_name += "_"
    spans = repeated_passages(docs, min_words).where("not is_first").groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("start", "length"))).alias(spans_name)
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            at = batch.schema.names.index("text")
            out = []
            for text, cut_out in zip(batch.column("text").to_pylist(), batch.column(spans_name).to_pylist()):
                if not cut_out or text is None:
                    out.append(text)
                    continue
                data, pieces, end = text.encode("utf-8", "surrogatepass"), [], 0
                for span in cut_out:
                    first, stop = _whole_characters(data, span["start"], span["start"] + span["length"])
                    if stop > max(end, first):
                        pieces.append(data[end : max(end, first)])
                        end = stop
                out.append(b"".join([*pieces, data[end:]]).decode("utf-8", "surrogatepass"))
            columns = list(batch.columns)[:-1]
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    joined = docs.join(spans, "doc_id", "left").select(*docs.columns, spans_name)
    return joined.mapInArrow(cut, fields)


def op9_substring_dedup(spark, sf_dir):
    return repeated_passages(read_documents(spark, sf_dir, "doc_id", "text"))
