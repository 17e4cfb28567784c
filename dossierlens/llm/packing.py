"""Packing of documents into sequences of bounded length by best fit over a histogram.

The plan is made over counts, not documents: the histogram of piece lengths has at most
``limit`` rows whatever the corpus holds. Best fit (decreasing) then runs on runs of equal
sequences, and says for each length which ranks take which sequences and at what offset.
Pieces are ranked within their length by a count per salted group, so that no task has to
see all pieces of a length, and take the slot that the plan gives their rank.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Bounded, kept, read_documents, slices, small_batches

LIMIT = 4096
END_ID = 1
PIECES = "doc_id {key}, piece int, start long, length long, ids_crc32 long"

# The byte alphabet of byte-level vocabularies. Printable bytes stand for
# themselves, the others for the characters from 256 up, in order.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = [b for b in range(256) if b not in _PRINTABLE]
BYTE_ALPHABET = {b: chr(256 + i) for i, b in enumerate(_OTHERS)}

LATIN_END = "\u0250"
"""Letters below it are composed as they stand, and their lower case is one letter each
(the one exception is screened)."""


class Seen(Bounded):
    """A cache that makes what it does not hold, so that a word it holds costs one look."""

    def __init__(self, limit: int, make: Callable[[str], bytes]):
        super().__init__(limit)
        self.make = make

    def __missing__(self, word: str) -> bytes:
        return self.put(word, self.make(word))


class WordIds:
    """Ids of texts by a tokenizer that never looks across a space or a line break.

    Words repeat, so a distinct one goes through the tokenizer once per worker. Only space
    and line feed are cut at; all else is left to the tokenizer.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        probes = ["a b", "a\nb", "ab  \n ba", "<|endoftext|> a"]
        for probe in probes:  # the assumption holds for this vocabulary
            parts = [self._ids(w) for w in probe.replace("\n", " ").split(" ")]
            if b"".join(parts) != self._ids(probe):
                raise ValueError("this tokenizer looks across spaces")
        self.seen = Seen(500_000, self._new)
        self.marks = {mark: self._ids(mark) for mark in ",."}
        self.is_plain = self._by_model("straße") == self._ids("straße")

    def _ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _by_model(self, word: str) -> bytes:
        """The ids of lower-case letters: what the library's normalizer and splitter would
        hand to its model, in the byte alphabet."""
        # ASCII letters stand for themselves.
        symbols = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_ALPHABET)
        return array("I", [token.id for token in self.model.tokenize(symbols)]).tobytes()

    def _new(self, word: str) -> bytes:
        body, mark = word, b""
        if word[-1:] in self.marks and len(word) > 1 and "A" <= word[-2] < LATIN_END:
            body, mark = word[:-1], self.marks[word[-1]]
        if self.is_plain and body.isalpha() and (body.isascii() or max(body) < LATIN_END):
            low = body.lower()
            if low.isalpha():
                known = self.seen.get(low) if low != word else None
                return (known or self._by_model(low)) + mark
        return self._ids(word)

    def ids(self, text: str) -> bytes:
        """The ids as unsigned 32-bit numbers in the machine's (little-endian) order."""
        return b"".join(map(self.seen.__getitem__, text.replace("\n", " ").split(" ")))


@cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces_of(docs: DataFrame, path: str, limit: int = LIMIT, keep_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``, and ``ids`` if asked for.

    A document is its ids and the end id; a null text is empty and so one end id. Longer
    ones are cut into pieces of ``limit`` ids, the last of which may be shorter. Every row
    of ``docs`` is a document, whether or not its id repeats.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = word_ids(path), np.array([END_ID], dtype="<u4").tobytes()
        for batch in slices(batches):
            rows: list[tuple] = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = tokenizer.ids(text or "") + end
                for piece, begin in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[begin : begin + 4 * limit]
                    rows.append((i, piece, begin // 4, len(part) // 4, zlib.crc32(part), part))
            if not rows:
                continue
            at, piece, start, length, crc, parts = zip(*rows)
            columns = [
                batch.column("doc_id").take(pa.array(at, pa.int64())),
                pa.array(piece, pa.int32()),
                *(pa.array(x, pa.int64()) for x in (start, length, crc)),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns.append(pa.array([np.frombuffer(p, "<u4").astype(np.int64) for p in parts], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)
        tokenizer.seen.clear()  # a worker that goes on to other tasks keeps no words

    schema = PIECES.format(key=docs.schema["doc_id"].dataType.simpleString())
    return small_batches(docs).select("doc_id", "text").mapInArrow(cut, schema + (", ids array<long>" if keep_ids else ""))


def plan(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit-decreasing over counts.

    Rows ``(length, rank_from, rank_to, sequence_from, per, offset)``: the pieces of ``length`` with
    a rank in the range take offset ``offset + length * (i % per)`` of sequence
    ``sequence_from + i // per``, where ``i = rank - rank_from``. Sequences with the same
    room are a run of consecutive numbers; each step fills runs from the tightest up.
    """
    rooms: dict[int, list[tuple[int, int, int]]] = {}  # room: [(first sequence, number, filled)]
    rows, next_sequence = [], 0
    for length in sorted(histogram, reverse=True):
        if not 0 < length <= limit:
            raise ValueError(f"a piece of {length} ids does not fit")
        rank, left = 0, histogram[length]

        def fill(first: int, number: int, used: int, length: int = length) -> None:
            """Put as many pieces as fit into each of ``number`` sequences, tightest first."""
            nonlocal rank, left
            per = (limit - used) // length
            whole, rest = divmod(min(left, number * per), per)
            for n, each in ((whole, per), (1 if rest else 0, rest)):
                if n:
                    rows.append((length, rank, rank + n * each, first, each, used))
                    rank, left = rank + n * each, left - n * each
                    after = used + each * length
                    if after < limit:
                        rooms.setdefault(limit - after, []).append((first, n, after))
                    first, number = first + n, number - n
            if number:
                rooms.setdefault(limit - used, []).append((first, number, used))

        for room in sorted(r for r in rooms if r >= length):
            runs = rooms.pop(room)
            while runs and left:
                fill(*runs.pop())
            if runs:
                rooms.setdefault(room, []).extend(runs)
            if not left:
                break
        if left:
            number = -(-left // (limit // length))
            first, next_sequence = next_sequence, next_sequence + number
            fill(first, number, 0)
    return rows


def pack(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; ``pieces`` is a stored table.

    Every row gets a slot; sequences are gapless from offset 0. An empty table stays empty.
    """
    spark = pieces.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    planned = plan(counted, limit)
    group = max(256, sum(counted.values()) // (32 * shuffles))
    salts = np.ones(limit + 1, dtype=np.int64)
    for length, n in counted.items():
        salts[length] = -(-n // group)
    salts_of = F.get(F.lit([int(s) for s in salts]), F.col("length").cast("int"))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(7)), salts_of))
    # A rank is the place in the salted group behind all groups before it.
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = salted.groupBy("length", "_salt").count().select(
        "length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before")
    )
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        salted.withColumn("_place", F.row_number().over(order) - 1)
        .join(groups, ["length", "_salt"])
        .withColumn("_rank", F.col("_place") + F.col("_before"))
        .select(*pieces.columns, "_rank")
    )

    table = np.array(planned, dtype=np.int64).reshape(-1, 6)
    # The plan is in order of length (falling) and rank; this key makes it one sorted array.
    keys = np.array([(limit - r[0]) for r in planned], dtype=np.float64)
    order_key = np.lexsort((table[:, 1], keys)) if len(table) else np.array([], dtype=int)
    table = table[order_key]
    begins = {int(l): int(i) for i, l in reversed(list(enumerate(table[:, 0])))}
    shared = spark.sparkContext.broadcast((table, begins))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, begins = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            row = np.empty(len(rank), dtype=np.int64)
            for value in np.unique(length):
                mine = length == value
                first = begins[int(value)]
                same = table[first:, 0] == value
                ranks_from = table[first : first + int(same.sum()), 1]
                row[mine] = first + np.searchsorted(ranks_from, rank[mine], side="right") - 1
            _, rank_from, _, sequence, per, offset = table[row].T
            i = rank - rank_from
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence + i // per), pa.array(offset + length * (i % per))],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """The pieces of ``docs(doc_id, text)`` and their places in sequences."""
    return pack(kept(pieces_of(docs, path, limit), "pieces"), limit)


def op2_best_fit_packing(spark, sf_dir):
    import public_tokenizers

    docs = read_documents(spark, sf_dir, "doc_id", "text")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
