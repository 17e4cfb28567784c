"""Token counts by byte-pair merging, without making any identifier.

A count needs no ids: it is the number of initial symbols less the number of merges. The
symbols of a chunk stand in a linked list; a heap holds the adjacent pairs whose join is a
piece of the vocabulary, and the pair of lowest rank, leftmost on ties, is merged until the
heap is empty.

A text is cut into chunks where no piece of the vocabulary reaches across: in front of a
run of spaces, at characters that are in no longer piece (such as line breaks), and between
a letter and a final mark that no piece holds side by side. Chunks repeat, so each Python worker counts a distinct chunk once and keeps the number.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bounded, read_documents, slices, small_batches

MAX_TOKENS = 4096
SPACE = "▁"
"""Fixed value: the character that stands for a space in the pieces."""


class MergeCounter:
    """Counts the pieces of texts for one vocabulary.

    ``ranks`` orders the pieces (lower merges first); ``prefix`` puts a space in front of
    every non-empty text. A character that is no piece counts as its UTF-8 bytes.
    """

    def __init__(self, ranks: dict[str, int], prefix: bool = True):
        if any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece in ranks):
            raise ValueError("a piece reaches across a space; chunks would not be independent")
        self.ranks = ranks
        self.symbols = {piece for piece in ranks if len(piece) == 1}
        self.prefix = prefix
        joined = {c for piece in ranks if len(piece) > 1 for c in piece}
        inner = {piece[i : i + 2] for piece in ranks for i in range(len(piece) - 1)}
        self.stops = {  # marks that are a piece of their own behind the given letter
            mark: {p for p in {piece[-1] for piece in ranks} if p + mark not in inner}
            for mark in ",."
            if mark in ranks
        }
        self.line_break = None if "\n" in joined else (1 if "\n" in ranks else len("\n".encode()))
        self.seen = Bounded(600_000)

    def chunk(self, chunk: str) -> int:
        """Symbols less merges of one chunk."""
        rank_of, size = self.ranks.get, len(chunk)
        count = size
        if not self.symbols.issuperset(chunk):
            count = sum(1 if c in self.symbols else len(c.encode("utf-8", "surrogatepass")) for c in chunk)
        end = list(range(1, size + 1))  # of the symbol that begins here; 0 once merged away
        before = list(range(-1, size))
        # A heap entry is rank and left position in one number, so ties go to the left.
        bits = size.bit_length()
        low = (1 << bits) - 1
        heap = [
            rank << bits | i
            for i in range(size - 1)
            if (rank := rank_of(chunk[i : i + 2])) is not None
        ]
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            left = entry & low
            right = end[left]
            if not right or right == size:
                continue  # merged away, or the last symbol by now
            last = end[right]
            if rank_of(chunk[left:last]) != entry >> bits:
                continue  # the pair has grown since
            end[left], end[right] = last, 0
            before[last] = left
            count -= 1
            if last < size and (rank := rank_of(chunk[left : end[last]])) is not None:
                heapq.heappush(heap, rank << bits | left)
            left = before[left]
            if left >= 0 and (rank := rank_of(chunk[left:last])) is not None:
                heapq.heappush(heap, rank << bits | left)
        return count

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(" ", SPACE)
        if self.prefix:
            text = SPACE + text
        total, seen = 0, self.seen
        lines = [text] if self.line_break is None else text.split("\n")
        total += (len(lines) - 1) * (self.line_break or 0)
        for line in lines:
            first, *words = line.split(SPACE)
            chunks = ([first] if first else []) + [SPACE + w for w in words]
            if "" in words:  # runs of spaces stay together, in front of their word
                chunks = re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", line)
            for chunk in chunks:
                n = seen.get(chunk)
                if n is None and chunk[-1] in self.stops and chunk[-2:-1] in self.stops[chunk[-1]]:
                    chunk = chunk[:-1]
                    total += 1
                    n = seen.get(chunk)
                total += seen.put(chunk, self.chunk(chunk)) if n is None else n
        return total


@cache
def piece_counter(path: str) -> MergeCounter:
    """The counter of a sentencepiece BPE model with identity normalization."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = (model.is_byte, model.is_control, model.is_unknown, model.is_unused)
    ranks = {
        model.id_to_piece(i): (-model.get_score(i), i)
        for i in range(model.get_piece_size())
        if not any(test(i) for test in special)
    }
    order = {piece: rank for rank, piece in enumerate(sorted(ranks, key=ranks.get))}
    # Pieces of equal score merge from the left, so they share a rank.
    scores = {}
    for piece, (score, _) in ranks.items():
        scores.setdefault(score, order[piece])
        scores[score] = min(scores[score], order[piece])
    return MergeCounter({piece: scores[score] for piece, (score, _) in ranks.items()})


def token_counts(docs: DataFrame, path: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every row of ``docs(doc_id, text)``.

    Null and empty texts count 0 bytes and 0 tokens; ids may be null or repeat, each row
    is counted by itself; other columns are left aside. There is no shuffle.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(path)
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            n_tokens = pa.array([counter.count(t) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), n_tokens],
                names=["doc_id", "n_bytes", "n_tokens"],
            )
        counter.seen.clear()  # a worker that goes on to other tasks keeps no chunks

    rows = small_batches(docs).select(
        "doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    )
    key = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(counted, f"doc_id {key}, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > max_tokens
    )


def op6_token_counts(spark, sf_dir):
    import public_tokenizers

    docs = read_documents(spark, sf_dir, "doc_id", "text")
    return token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))
