"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams per language on the tasks and sums them in a shuffle; only
the ``languages x buckets`` matrix, whose size does not depend on the corpus, reaches the
driver. It is broadcast. Documents are counted into sparse rows of buckets, in pieces of bounded length,
and batches of such rows are multiplied with the matrix.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_documents, slices, small_batches

SAMPLE_PER_LANGUAGE = 4000
"""About so many labelled rows of each language are learned from, chosen by a hash."""

BITS = 15
"""The n-grams fall into 2^15 buckets."""

PIECE = 1 << 18
"""Characters whose n-grams stand in memory at a time."""

ENTRIES = 1 << 20
"""Numbers of the matrix that a batch of documents takes from it at a time."""

SMOOTHING = 0.1
UNDETERMINED = "und"
MODEL_BYTES = 64 * (8 << 20)
"""Bound of the model: with 2^15 buckets of 8 bytes, 2048 languages. More are refused, none is left out."""

_ODD = [np.uint32(m) for m in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]


@dataclass(frozen=True)
class Model:
    """``weights[bucket, language]``: log probability of a bucket; ``prior[language]``."""

    languages: list[str]
    weights: np.ndarray
    prior: np.ndarray


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def _grams(code: np.ndarray, bits: int, starts: int) -> np.ndarray:
    """The buckets of the 1-, 2- and 3-grams that begin in the first ``starts`` characters."""
    grams, mixed = [], np.zeros(len(code), dtype=np.uint32)
    for n, odd in enumerate(_ODD, 1):
        if len(code) < n:
            break
        mixed = (mixed[: len(code) - n + 1] + code[n - 1 :]) * odd
        hashed = mixed[:starts]
        grams.append((hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x27D4EB2F) >> np.uint32(32 - bits))
    return np.concatenate(grams) if grams else code


def counted(text: str, bits: int = BITS, piece: int = PIECE) -> np.ndarray:
    """How many 1-, 2- and 3-grams of the lower-cased characters of ``text`` fall into each bucket."""
    lowered, total = text.lower(), np.zeros(1 << bits, dtype=np.int64)
    for begin in range(0, len(lowered), piece):
        characters = lowered[begin : begin + piece + len(_ODD) - 1]
        code = np.frombuffer(characters.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        total += np.bincount(_grams(code, bits, piece), minlength=1 << bits)
    return total


def train(
    labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, bits: int = BITS
) -> Model:
    """Learn from ``labelled(text, lang)``; rows without a language or text are left out.

    Rows of a language are sampled by a hash of the text, and of ``doc_id`` where there is one, at the
    rate that keeps ``per_language`` of them in expectation, so the model is the same in every run and
    copies of a text are not taken or left all together.
    """
    size = 1 << bits
    drawn_by = ["text", *(c for c in labelled.columns if c == "doc_id")]
    known = small_batches(labelled).where("lang is not null and text is not null").select("lang", "text", *drawn_by[1:])
    most = MODEL_BYTES // (8 * size)
    counts = known.groupBy("lang").count().orderBy("lang").limit(most + 1).collect()
    if len(counts) > most:
        raise ValueError(f"more than {most} languages: a model of 2^{bits} buckets would pass MODEL_BYTES")
    languages = [row["lang"] for row in counts]
    rows = np.array([row["count"] for row in counts], dtype=float)
    if not languages:
        return Model([], np.zeros((size, 0)), np.zeros(0))
    rate = F.element_at(
        F.create_map(*[F.lit(x) for l, n in zip(languages, rows) for x in (l, min(1.0, per_language / n))]),
        F.col("lang"),
    )
    drawn = known.where(F.pmod(F.xxhash64(*drawn_by), F.lit(1 << 30)) < rate * (1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                total = sums.setdefault(lang, np.zeros(size, dtype=np.int64))
                total += counted(text, bits)
        for lang, total in sums.items():
            found = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(total[found])],
                names=["lang", "bucket", "n"],
            )

    summed = drawn.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(
        F.sum("n").alias("n")
    )
    table = summed.toArrow()
    matrix = np.full((size, len(languages)), SMOOTHING)
    place = {lang: i for i, lang in enumerate(languages)}
    column = np.array([place[x] for x in table.column("lang").to_pylist()], dtype=int)
    matrix[table.column("bucket").to_numpy(), column] += table.column("n").to_numpy()
    return Model(languages, np.log(matrix / matrix.sum(axis=0)), np.log(rows / rows.sum()))


def _scores(model: Model, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The log odds of documents given as ``(buckets, counts)``: one sparse product with the matrix."""
    begins = np.cumsum([0] + [len(found) for found, _ in rows[:-1]])
    taken = model.weights[np.concatenate([found for found, _ in rows])] * np.concatenate([n for _, n in rows])[:, None]
    return np.add.reduceat(taken, begins, axis=0) + model.prior


def classify_all(model: Model, texts: Iterable[str | None], bits: int = BITS) -> list[tuple[str, float]]:
    """Of each text the most probable language, the first in the alphabet among equals, and its posterior probability."""
    out: list[tuple[str, float]] = []
    places: list[int] = []
    rows: list[tuple[np.ndarray, np.ndarray]] = []

    def score() -> None:
        if rows:
            logs = _scores(model, rows)
            odds = np.exp(logs - logs.max(axis=1, keepdims=True))
            best = odds.argmax(axis=1)
            for k, place in enumerate(places):
                out[place] = model.languages[best[k]], float(odds[k, best[k]] / odds[k].sum())
        places.clear()
        rows.clear()

    waiting = 0
    for text in texts:
        out.append((UNDETERMINED, 0.0))
        if not text or not model.languages or not has_letter(text):
            continue
        n = counted(text, bits)
        found = np.flatnonzero(n)
        places.append(len(out) - 1)
        rows.append((found, n[found]))
        waiting += len(found) * len(model.languages)
        if waiting > ENTRIES:
            score()
            waiting = 0
    score()
    return out


def classify(model: Model, text: str | None, bits: int = BITS) -> tuple[str, float]:
    """The most probable language and its posterior probability."""
    return classify_all(model, [text], bits)[0]


def identify(docs: DataFrame, model: Model, bits: int = BITS) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` behind its columns (which they replace).

    The prediction sees ``text`` alone. Null texts and texts without a letter are ``und``
    with score 0, as is everything if no language was learned. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = small_batches(docs).drop("lang_pred", "score")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = classify_all(shared.value, batch.column("text").to_pylist(), bits)
            lang, score = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"],
            )

    return plain.mapInArrow(predict, f"{fields}, lang_pred string, score double")


def held_out():
    """Rows whose language is not learned from: a quarter, by the crc32 of the id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op1_language_id(spark, sf_dir):
    docs = read_documents(spark, sf_dir, "doc_id", "text", "lang")
    model = train(docs.where(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
