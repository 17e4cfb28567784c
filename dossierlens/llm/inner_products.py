"""What the exact searches by inner product share: whole-number vectors, blocks of them with
bounds, and rounds in which queries open the blocks their bounds allow.

An index gives every vector a centre and its distance from it. Vectors are sorted by ranges of both and packed
into blocks of at most ``BLOCK_ROWS``, so that no centre, however many rows it has, is one group. Runs
of blocks are cells; a cell takes in more blocks as the table grows, so the directory of cells
never has many more than ``MOST_CELLS`` rows and can be given to every task. A round opens the best cells of
each query, scores their blocks exactly, and raises the score that a cell must be able to reach. The
last round opens every cell left that can. Nothing is cut: the bounds alone decide.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import top_per_group
from .common import kept, slices

BLOCK_ROWS = 1000
MOST_CELLS = 100_000
QUERIES_AT_ONCE = 1024
"""Queries that meet a block in one task."""

OPENED = (4, 32)
"""Cells a query has opened after each round but the last."""

SAMPLE_ROWS = 10_000
SAMPLE_BYTES = 32 << 20
"""Centres are chosen from no more rows, and no more bytes, than these; every row is indexed."""

BROADCAST_BYTES = 16 << 20
"""Most bytes of a table that a join gives to every task, by its counted rows. Spark would go by packed bytes, of which
ids that repeat take a hundredth: millions of pairs would be built into one table on the driver."""

ROW_BYTES = 64
"""What a row of a few numbers takes in such a table."""

SLACK = 1e-6
"""Share of the squared norms added to a bound, far above the rounding of doubles."""

EXACT = 2.0**53
LEAST, MOST = -(2**63) + 1, 2**63 - 1
ANY = -1
"""The centre of vectors that no bound is known for."""

VECTORS = "vec_id long, label long, dim int, norm double, vec binary"
PLACED = f"{VECTORS}, centre int, distance double, far array<double>"
BLOCKS = "dim int, centre int, low double, high double, norm double, label_low long, label_high long, far array<double>, ids binary, labels binary, vectors binary"


def integers(vec: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(vec, dtype=np.int64).reshape(-1, dim) if dim else np.zeros((1, 0), dtype=np.int64)


def is_wide(x: np.ndarray) -> bool:
    """Whether products of such vectors may not be exact in doubles."""
    return bool(x.size) and float(np.abs(x.astype(np.float64)).max()) ** 2 * x.shape[-1] >= EXACT


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All inner products of the rows of ``q`` and ``x``, held within the range of a long."""
    if not (is_wide(q) or is_wide(x)):
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    found = q.astype(object) @ x.astype(object).T
    return np.clip(found, LEAST, MOST).astype(np.int64)


def first_k(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` highest allowed scores of each row, ties to the smaller id."""
    if scores.shape[1] > k:
        kth = np.partition(np.where(allowed, scores, LEAST), scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        allowed = allowed & (scores >= kth[:, None])
    i, j = np.nonzero(allowed)
    order = np.lexsort((ids[j], -scores[i, j], i))
    i, j = i[order], j[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    return i[rank < k], j[rank < k]


def whole_vectors(rows: DataFrame, scale: int) -> DataFrame:
    """``(vec_id, label, dim, norm, vec)`` of ``rows(vec_id, label, embedding)``: each component x as floor(scale * x).

    Vectors that are null or hold a null or non-finite component, and rows without an id, are
    left out. Numbers beyond a long count as its ends; the norm of such ``is_wide`` vectors is infinite.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for vec_id, label, value in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "label", "embedding"))):
                if vec_id is None or value is None or any(v is None for v in value):
                    continue
                x = np.array(value, dtype=np.float64)
                if not np.isfinite(x).all():
                    continue
                with np.errstate(over="ignore"):
                    x = np.clip(np.floor(scale * x), -(2.0**63), 2.0**63 - 2048).astype(np.int64)
                norm = math.inf if is_wide(x) else float(np.sqrt((x.astype(np.float64) ** 2).sum()))
                out.append((vec_id, label, len(x), norm, x.tobytes()))
            schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("norm", pa.float64()), ("vec", pa.binary())])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema) if out else pa.RecordBatch.from_pylist([], schema=schema)

    numbers = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return kept(numbers.mapInArrow(whole, VECTORS), "vectors")


def draw(vectors: DataFrame, count: int, row_bytes: float) -> dict[int, np.ndarray]:
    """A bounded sample of the vectors by their length, those of bounded norm only; drawn by hashes of the numbers."""
    n = int(min(SAMPLE_ROWS, max(1, SAMPLE_BYTES // max(1, row_bytes))))
    some = vectors.where((F.col("norm") < math.inf) & (F.pmod(F.xxhash64("vec", "vec_id"), F.lit(1 << 30)) < min(1.0, 1.2 * n / max(1, count)) * (1 << 30)))
    found: dict[int, list] = {}
    for r in some.select("dim", "vec").limit(n).toArrow().to_pylist():
        if r["dim"]:
            found.setdefault(r["dim"], []).append(integers(r["vec"], r["dim"])[0])
    return {dim: np.array(sorted(map(tuple, rows)), dtype=np.float64) for dim, rows in sorted(found.items())}


def placed(vectors: DataFrame, place: Callable[[int, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """``vectors`` with the centre, distance and distances further up that ``place(dim, vectors, norms)`` finds for them."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            dims, norms = batch.column("dim").to_numpy(), batch.column("norm").to_numpy()
            vecs = batch.column("vec")
            centre, distance = np.full(len(dims), ANY, dtype=np.int32), np.zeros(len(dims))
            far: list[list[float]] = [[] for _ in dims]
            for dim in np.unique(dims[np.isfinite(norms)]).tolist():
                at = np.flatnonzero((dims == dim) & np.isfinite(norms))
                x = np.array([integers(vecs[k].as_py(), dim)[0] for k in at.tolist()], dtype=np.float64)
                centre[at], distance[at], up = place(dim, x, norms[at])
                for k, row in zip(at.tolist(), up.tolist()):
                    far[k] = row
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(centre), pa.array(distance), pa.array(far, pa.list_(pa.float64()))],
                names=[*batch.schema.names, "centre", "distance", "far"],
            )

    return vectors.mapInArrow(found, PLACED)


def _packing(rows: int):
    def packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows):
            if not batch.num_rows:
                continue
            dim, centre = batch.column("dim").to_numpy(), batch.column("centre").to_numpy()
            new = np.flatnonzero((dim[1:] != dim[:-1]) | (centre[1:] != centre[:-1])) + 1
            out = []
            for b, e in zip([0, *new.tolist()], [*new.tolist(), len(dim)]):
                part = batch.slice(b, e - b)
                distance, norm = part.column("distance").to_numpy(), part.column("norm").to_numpy()
                labels = part.column("label").fill_null(0).to_numpy()
                far = np.array(part.column("far").to_pylist(), dtype=np.float64).reshape(e - b, -1).max(axis=0)
                out.append(
                    {
                        "dim": int(dim[b]), "centre": int(centre[b]), "low": float(distance.min()), "high": float(distance.max()), "norm": float(norm.max()),
                        "label_low": int(labels.min()), "label_high": int(labels.max()), "far": far.tolist(),
                        "ids": part.column("vec_id").to_numpy().tobytes(), "labels": labels.tobytes(), "vectors": b"".join(part.column("vec").to_pylist()),
                    }
                )
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                ("dim", pa.int32()), ("centre", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("norm", pa.float64()), ("label_low", pa.int64()),
                ("label_high", pa.int64()), ("far", pa.list_(pa.float64())), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary())]))

    return packing


@dataclass(frozen=True)
class Index:
    blocks: DataFrame
    """``(block, ...)`` as in ``BLOCKS``."""
    members: DataFrame
    """``(cell, block)``: the blocks of each cell."""
    n_blocks: int
    cells: dict[str, np.ndarray]
    """The directory: ``cell, dim, centre, low, high, norm, label_low, label_high``, a value per cell."""


def packed(rows: DataFrame, *order: str) -> Index:
    """Blocks of ``rows`` as ``placed`` makes them, sorted by length, centre and ``order``."""
    keys = ["dim", "centre", *order, "vec_id"]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_packing(BLOCK_ROWS), BLOCKS)
    blocks = kept(dealt.withColumn("block", F.monotonically_increasing_id()), "blocks")
    n_blocks = blocks.count()
    run = F.floor(F.col("block") / math.ceil(max(1, n_blocks) / MOST_CELLS)).alias("run")
    cells = blocks.groupBy("dim", "centre", run).agg(
        F.min("block").alias("cell"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("norm").alias("norm"),
        F.min("label_low").alias("label_low"), F.max("label_high").alias("label_high"),
    )
    cells = kept(cells, "cells")
    named = blocks.select("dim", "centre", run, "block").join(F.broadcast(cells.select("dim", "centre", "run", "cell")), ["dim", "centre", "run"])
    found = cells.drop("run").orderBy("cell").toArrow()
    return Index(blocks, kept(named.select("cell", "block"), "members"), n_blocks, {name: found.column(name).to_numpy() for name in found.column_names})


def beside(table: DataFrame, n_bytes: float = math.inf) -> DataFrame:
    """``table`` as a side of a join: given to every task if it is counted to be within the bound, else met by a sort."""
    return F.broadcast(table) if n_bytes <= BROADCAST_BYTES else table.hint("merge")


Bounds = Callable[[int, np.ndarray, np.ndarray, np.ndarray, dict], tuple[np.ndarray, np.ndarray]]
"""``(length, queries, least wanted score, highest wanted score, cells of that length)`` to the least and the highest
score that each query can have in each cell; a cell that holds none wanted may be given as empty (highest below least)."""


def _opened(limit: int | None, index: Index, bounds: Bounds, same_label: bool | None):
    cells, whole = index.cells, np.arange(len(index.cells["cell"]))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dim = {int(d): whole[cells["dim"] == d] for d in np.unique(cells["dim"])}
        for batch in slices(batches, max(1, min(1000, (1 << 21) // max(1, len(whole))))):
            out = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            dims, ids = batch.column("dim").to_numpy(), batch.column("query").to_numpy()
            labels = batch.column("label").fill_null(0).to_numpy()
            floors, highs = batch.column("floors").to_pylist(), batch.column("highs").to_pylist()
            for dim in np.unique(dims).tolist():
                asked, at = np.flatnonzero(dims == dim), by_dim.get(dim)
                if at is None:
                    continue
                mine = {name: values[at] for name, values in cells.items()}
                q = np.concatenate([integers(batch.column("vec")[k].as_py(), dim) for k in asked.tolist()]).astype(np.float64)
                slots = max(len(floors[k]) for k in asked.tolist())
                low, high = (np.array([(values[k] + [fill] * slots)[:slots] for k in asked.tolist()], dtype=np.float64).reshape(len(asked), slots) for values, fill in ((floors, math.inf), (highs, -math.inf)))
                none_wanted = np.where(low <= high, low, math.inf), np.where(low <= high, high, -math.inf)
                least, most = bounds(dim, q, none_wanted[0].min(axis=1), none_wanted[1].max(axis=1), mine)
                free = np.array([is_wide(row) for row in q])[:, None] | (mine["centre"] == ANY)[None, :] | ~np.isfinite(mine["norm"])[None, :]
                least, most = np.where(free, -math.inf, least), np.where(free, math.inf, most)
                ok = np.zeros(most.shape, dtype=bool)
                for s in range(slots):
                    ok |= (most >= low[:, s, None]) & (least <= high[:, s, None]) & (low[:, s] <= high[:, s])[:, None]
                mark = labels[asked][:, None]
                if same_label is True:
                    ok &= (mine["label_low"][None, :] <= mark) & (mark <= mine["label_high"][None, :])
                elif same_label is False:
                    ok &= (mine["label_low"][None, :] != mark) | (mark != mine["label_high"][None, :])
                if limit is not None and limit < len(at):
                    worth = np.where(ok, most, -math.inf)
                    best = np.argsort(-worth, axis=1, kind="stable")[:, :limit]
                    cut = np.zeros_like(ok)
                    np.put_along_axis(cut, best, True, axis=1)
                    ok &= cut
                i, j = np.nonzero(ok)
                out[0].append(ids[asked][i])
                out[1].append(mine["cell"][j])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(part), pa.int64()) for part in out], names=["query", "cell"])

    return opened


def _scored(k: int, same_label: bool | None):
    def scored(asked: pa.Table, block: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows and block.num_rows:
            dim = block.column("dim")[0].as_py()
            ids, labels = (np.frombuffer(block.column(c)[0].as_py(), dtype=np.int64) for c in ("ids", "labels"))
            x = integers(block.column("vectors")[0].as_py(), dim) if dim else np.zeros((len(ids), 0), dtype=np.int64)
            queries = asked.column("query").to_numpy()
            q = np.concatenate([integers(v, dim) for v in asked.column("vec").to_pylist()])
            marks = asked.column("label").fill_null(0).to_numpy()
            floors, highs = asked.column("floors").to_pylist(), asked.column("highs").to_pylist()
            scores = exact_scores(q, x)
            allowed = queries[:, None] != ids[None, :]
            if same_label is not None:
                allowed &= (marks[:, None] == labels[None, :]) == same_label
            for s in range(max(map(len, floors))):
                low = np.array([f[s] if s < len(f) else MOST for f in floors], dtype=np.int64)
                high = np.array([h[s] if s < len(h) else LEAST for h in highs], dtype=np.int64)
                i, j = first_k(scores, allowed & (scores >= low[:, None]) & (scores <= high[:, None]), ids, k)
                out.append((queries[i], np.full(len(i), s, dtype=np.int32), ids[j], scores[i, j]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [[]] * 4
        return pa.table(dict(zip(("query", "slot", "vec_id", "score"), (pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))))))

    return scored


def search(queries: DataFrame, index: Index, bounds: Bounds, k: int, same_label: bool | None = None) -> DataFrame:
    """``(query, slot, vec_id, score, rank)``: the first ``k`` vectors of each window of each query.

    ``queries(query, label, dim, vec, lows, highs)``: window number ``slot`` takes scores from ``lows[slot]`` to
    ``highs[slot]``. Rows with the query's own id are no candidates, nor are those of another label, or
    of the same, as ``same_label`` says. Vectors of other lengths are none either.
    """
    order = [F.col("score").desc(), F.col("vec_id")]
    asked = queries.withColumn("floors", F.col("lows"))
    n_queries, query_bytes = queries.agg(F.count("*"), F.sum(ROW_BYTES + F.octet_length("vec") + 16 * F.size("lows"))).first()
    buckets = math.ceil(max(1, n_queries) / QUERIES_AT_ONCE)
    bucket = F.pmod(F.xxhash64("query"), F.lit(buckets)).alias("bucket")
    seen = best = None
    for limit in (*OPENED, None):
        pairs = asked.select("query", "label", "dim", "vec", "floors", "highs").mapInArrow(_opened(limit, index, bounds, same_label), "query long, cell long")
        pairs = kept(pairs if seen is None else pairs.join(beside(seen), ["query", "cell"], "left_anti"), "pairs")
        dealt = pairs.join(beside(index.members, index.n_blocks * ROW_BYTES), "cell").select("query", "block", bucket)
        wanted = dealt.select(F.col("block").alias("asked"), F.col("bucket").alias("part")).distinct()
        full = dealt.join(beside(asked.select("query", "label", "vec", "floors", "highs"), query_bytes or 0), "query")
        wanted = beside(wanted, index.n_blocks * buckets * ROW_BYTES)
        held = index.blocks.select("block", "dim", "ids", "labels", "vectors").join(wanted, F.col("block") == F.col("asked")).drop("block")
        found = full.groupBy("block", "bucket").cogroup(held.groupBy("asked", "part")).applyInArrow(
            _scored(k, same_label), "query long, slot int, vec_id long, score long"
        )
        every = found if best is None else best.drop("rank").unionByName(found)
        best = kept(top_per_group(every, ["query", "slot"], order, k), "best")
        seen = pairs if seen is None else seen.unionByName(pairs)
        if limit is None or len(index.cells["cell"]) <= limit:
            break
        # A full window only takes what is no worse than its last; a cell has to be able to hold that.
        full_slots = best.where(F.col("rank") == k).groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("kth"))
        raised = F.transform("lows", lambda low, s: F.greatest(low, F.coalesce(F.element_at("kth", s), low)))
        asked = kept(queries.join(beside(full_slots), "query", "left").withColumn("floors", raised).drop("kth"), "asked")
    return best


def one_query_each(vectors: DataFrame) -> DataFrame:
    """``(query, label, dim, vec)``: one vector of each id, the first by its numbers where an id is repeated."""
    first = F.min(F.struct("dim", "vec", "label"))
    return vectors.groupBy(F.col("vec_id").alias("query")).agg(first.alias("first")).select("query", "first.label", "first.dim", "first.vec")
