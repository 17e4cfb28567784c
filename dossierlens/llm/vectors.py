"""Near-duplicate embeddings: iterative quantisation, Hamming tables, exact rerank.

Rotations are learned on a bounded sample, each by iterative quantisation from another start;
every vector is indexed. A rotation gives a balanced code of 64 bits, whose parts index a table
each: codes whose Hamming distance is less than their parts share one. There are as many tables
as pairs at the least similarity need to share one with probability 0.999.
How wide a part is, and how much of the mean is subtracted first, follows from two angles
measured on the sample, that of pairs at the least similarity and that of any two: of all widths
and centres the one is taken whose rows and expected comparisons cost least. Wide parts take more
tables and hold fewer vectors in a bucket; a direction that all vectors share is subtracted
where that sets them further apart. Each length of vectors is searched by itself, by codes at
every size. A vector's work grows as a small power of their number; where a shared direction leaves any two nearly as
close as links, a model's most rotations leave a fixed share of the pairs to be compared as codes.
Within a bucket, vectors stay that have a partner near enough over the first codes; only these meet
as vectors, in blocks, where the cosine is taken in double precision. A pair belongs to
the first table that holds it, so links are counted once and need not be written as pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, slices
from .components import connected

MIN_COSINE = 0.95
SAMPLE_ROWS = 10_000
SAMPLE_BYTES = 32 << 20
"""The rotations are learned on no more rows, and no more bytes, than these."""

BITS = 64
LEAST_PART = 8
MISS = 0.001
ROUNDS = 25
LEARN_ROWS = 2_000
"""Rows of the sample on which a rotation is turned; its axes are those of the whole sample."""

CENTRES = (1.0, 0.5, 0.0)
"""Shares of the mean that may be subtracted."""

COMPARED = 64
"""Codes that are compared in the time that a row more in the tables takes."""

CHECKED = 8
"""Rotations whose codes go into the tables, to be compared there."""

MOST_ROTATIONS = 512
"""A model has no more, some 10 MB; where wide parts would take more, parts are narrower and buckets larger."""

BLOCK = 256
HOT = 2048
"""Buckets with more members are searched by several tasks."""

PLAIN = math.acos(MIN_COSINE) / math.pi


@dataclass(frozen=True)
class Rotations:
    mean: np.ndarray
    axes: np.ndarray
    turns: list[np.ndarray]
    dim: int
    share: float = PLAIN
    """The share of bits in which nearly no pair at the least similarity is expected to differ more."""


@dataclass(frozen=True)
class Layout:
    part: int
    rotations: int
    cost: float
    """Rows in the tables for each vector, and comparisons in terms of rows."""


def layout(n: int, n_bits: int = BITS, near: np.ndarray | None = None, apart: np.ndarray | None = None) -> Layout:
    """The width of parts, and the rotations, that cost least for ``n`` vectors with codes of ``n_bits``.

    ``near`` are the shares of bits in which pairs at the least similarity differ, ``apart`` those of any two.
    """
    near = np.maximum(PLAIN, [PLAIN] if near is None or not len(near) else near)
    apart = np.array([0.5]) if apart is None or not len(apart) else apart
    found = []
    for part in range(min(LEAST_PART, n_bits), n_bits + 1):
        per = n_bits // part
        tables = _tables(near, part)
        rotations = math.ceil(tables / per) if tables <= MOST_ROTATIONS * per else 0
        cost = (rotations * per or math.inf) * (1 + n * float(np.mean((1 - apart) ** part)) / COMPARED)
        found.append(Layout(part, rotations, cost))
    return min(found, key=lambda way: way.cost)


def _tables(near: np.ndarray, part: int) -> float:
    """How many tables of parts so wide leave ``MISS`` of the pairs out; infinite beyond a million."""
    apart = 1 - (1 - near) ** part

    def enough(tables: int) -> bool:
        return float(np.mean(apart**tables)) <= MISS * 1.0001

    most = 1
    while not enough(most):
        most *= 2
        if most > 1 << 20:
            return math.inf
    least = most // 2
    while most - least > 1:
        middle = (least + most) // 2
        least, most = (least, middle) if enough(middle) else (middle, most)
    return most


def shares(sample: np.ndarray, centre: float = 1.0, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The shares of bits in which unit vectors of ``sample`` and others at the least similarity
    differ, and those in which they differ from any other one: their angles as codes see them, about
    ``centre`` of the mean and along the principal axes.

    The vector at the least similarity lies towards another one of the sample.
    """
    mean, axes = _axes(sample, centre)
    others = sample[np.random.default_rng(seed).permutation(len(sample))]
    towards = others - (others * sample).sum(axis=1)[:, None] * sample
    size = np.linalg.norm(towards, axis=1)
    known = size > 1e-9
    mine, towards = sample[known], towards[known] / size[known][:, None]
    near = MIN_COSINE * mine + math.sqrt(1 - MIN_COSINE**2) * towards
    return _angles((mine - mean) @ axes, (near - mean) @ axes), _angles((mine - mean) @ axes, (others[known] - mean) @ axes)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angles of the rows, as shares of half a turn."""
    norms = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
    cosines = (a * b).sum(axis=1) / np.where(norms > 0, norms, 1.0)
    return np.arccos(np.clip(np.where(norms > 0, cosines, 0.0), -1.0, 1.0)) / math.pi


def _axes(sample: np.ndarray, centre: float) -> tuple[np.ndarray, np.ndarray]:
    """What is subtracted, and the principal axes of most variance about it.

    The mean of a few vectors would set near ones apart; it counts in the measure of their number.
    """
    mean = sample.mean(axis=0) * (centre * len(sample) / (len(sample) + BITS))
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    return mean, axes[:, ::-1][:, : min(BITS, sample.shape[1])]


def _units(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """Which vectors can be compared, and each as doubles."""
    found = []
    for value in column.to_pylist():
        x = None if value is None or any(v is None for v in value) else np.array(value, dtype=np.float64)
        found.append(x if x is not None and len(x) and np.isfinite(x).all() and x.any() else None)
    return np.array([x is not None for x in found]), found


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max()
    return x / np.linalg.norm(x)


def fit(sample: np.ndarray, rotations: int, centre: float = 1.0, share: float = PLAIN, seed: int = 3) -> Rotations:
    """Iterative quantisation: turn the principal axes so that signs lose the least."""
    mean, axes = _axes(sample, centre)
    projected = (sample[:LEARN_ROWS] - mean) @ axes
    turns, rng = [], np.random.default_rng(seed)
    for _ in range(rotations):
        turn, _ = np.linalg.qr(rng.standard_normal((axes.shape[1],) * 2))
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(np.where(projected @ turn >= 0, 1.0, -1.0).T @ projected)
            turn = (u @ v).T
        turns.append(turn.astype(np.float32))
    return Rotations(mean, axes, turns, sample.shape[1], share)


def codes(units: np.ndarray, model: Rotations) -> np.ndarray:
    """``(rows, rotations)`` 64-bit codes."""
    out = np.zeros((len(units), len(model.turns)), dtype=np.uint64)
    projected = ((units - model.mean) @ model.axes).astype(np.float32)
    weights = np.uint64(1) << np.arange(projected.shape[1], dtype=np.uint64)
    for r, turn in enumerate(model.turns):
        out[:, r] = ((projected @ turn >= 0) * weights).sum(axis=1, dtype=np.uint64)
    return out


def _classes(vectors: DataFrame) -> DataFrame:
    """``vectors`` with the digest of the numbers; null where they cannot be compared."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 5000):
            _, found = _units(batch.column("embedding"))
            keys = [None if x is None else xxhash.xxh128_digest((x + 0.0).tobytes()) for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("embedding"), pa.array(keys, pa.binary())],
                names=["vec_id", "embedding", "key"],
            )

    return vectors.mapInArrow(keyed, "vec_id long, embedding array<double>, key binary")


def _parts(codes: np.ndarray, width: int, n_bits: int) -> np.ndarray:
    """The parts of codes in the order of the tables."""
    mask = np.uint64((1 << width) - 1) if width < 64 else np.uint64(2**64 - 1)
    shifts = np.arange(0, n_bits - n_bits % width, width, dtype=np.uint64)
    return ((codes[:, :, None] >> shifts) & mask).reshape(len(codes), -1)


def _block_links(table: pa.Table, width: int, n_bits: int) -> pa.Table:
    """Links of one pair of blocks of a bucket: how many each vector has, and enough of them
    to connect what is connected here."""
    part = table.column("part")[0].as_py()
    ids, copies = (table.column(c).to_numpy() for c in ("id", "copies"))
    first = table.column("first").to_numpy(zero_copy_only=False)
    second = table.column("second").to_numpy(zero_copy_only=False)
    units = np.array([_unit(np.array(v)) for v in table.column("embedding").to_pylist()])
    parts = _parts(np.array(table.column("codes").to_pylist(), dtype=np.int64).reshape(len(ids), -1).view(np.uint64), width, n_bits)
    left, right = np.flatnonzero(first), np.flatnonzero(second)
    near = units[left] @ units[right].T >= MIN_COSINE
    # In a block against itself each pair counts once; ids are distinct in a bucket.
    i, j = np.nonzero(near & (ids[left][:, None] != ids[right][None, :]))
    i, j = left[i], right[j]
    one_block = first[i] & second[i] & first[j] & second[j]
    keep = ~one_block | (ids[i] < ids[j])
    i, j = i[keep], j[keep]
    mine = np.ones(len(i), dtype=bool)
    for begin in range(0, len(i), 100_000):
        same = parts[i[begin : begin + 100_000]] == parts[j[begin : begin + 100_000]]
        mine[begin : begin + 100_000] = same.argmax(axis=1) == part
    i, j = i[mine], j[mine]
    links = np.zeros(len(ids), dtype=np.int64)
    np.add.at(links, i, copies[j])
    np.add.at(links, j, copies[i])
    root = list(range(len(ids)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    joined: dict[int, int] = {}
    for a, b in zip(i.tolist(), j.tolist()):
        ra, rb = find(a), find(b)
        if ra != rb:
            root[rb] = ra
            joined[rb] = ra
    some = np.flatnonzero(links)
    # Each vector hangs on the one it was joined to; a root hangs on itself.
    other = [int(ids[joined.get(k, k)]) for k in some.tolist()]
    return pa.table({"id": pa.array(ids[some], pa.int64()), "n": pa.array(links[some], pa.int64()), "other": pa.array(other, pa.int64())})


def near_vectors(vectors: DataFrame) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row of ``vectors(vec_id, embedding)``.

    Vectors that are null, empty, zero or hold a null or non-finite component have no
    links, and neither have rows without an id (their component is null; they are kept).
    Equal vectors are linked with each other and are one class in the search. Vectors of
    different lengths are not linked. Rows that share an id are one vector with several values.
    """
    spark = vectors.sparkSession
    rows = kept(_classes(vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))), "vectors")
    classes = kept(
        rows.where("key is not null and vec_id is not null")
        .groupBy("key")
        .agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")),
        "classes",
    )
    sizes = classes.groupBy(F.size("embedding").alias("dim")).count().where("count > 1").orderBy(F.desc("count"), "dim").collect()
    coded = [_links(classes.where(F.size("embedding") == dim), *_model(classes, dim, count)) for dim, count in sizes]
    none = spark.createDataFrame([], "id long, n long, other long")
    links = kept(reduce(DataFrame.unionByName, coded), "links") if coded else none

    counts = links.groupBy("id").agg(F.sum("n").alias("n"))
    found = connected(links.select(F.col("id").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "id")
    placed = classes.select("key", "id", "copies").join(counts, "id", "left").join(found, "id", "left").select(
        "key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
    own = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return rows.select("vec_id", "key").join(placed, "key", "left").select(
        "vec_id",
        F.when(F.col("vec_id").isNull(), F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        own.alias("component_id"),
        F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"),
    )


def planned(sample: np.ndarray, count: int) -> tuple[Layout, float, float]:
    """The layout that costs least for ``count`` vectors like the sample's, the share of the mean it
    subtracts, and the share of bits in which nearly no pair at the least similarity differs more."""
    n_bits = min(BITS, sample.shape[1])
    ways = []
    for centre in CENTRES:
        near, apart = shares(sample, centre)
        ways.append((layout(count, n_bits, near, apart), centre, near))
    way, centre, near = min(ways, key=lambda found: found[0].cost)
    if way.cost == math.inf:  # the sample's angles hold for no model: plain angles about the origin
        way, centre = layout(count, n_bits), 0.0
    return way, centre, max(PLAIN, float(np.quantile(near, 0.999)) if len(near) else 0.0)


def _model(classes: DataFrame, dim: int, count: int) -> tuple[Rotations, int]:
    """The rotations of the ``count`` vectors of one length, and the bits of a part."""
    n = min(SAMPLE_ROWS, max(BITS, SAMPLE_BYTES // (8 * dim)))
    drawn = classes.where(F.size("embedding") == dim).select("embedding").where(
        F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < max(1.2 * n / count, 64 / count) * (1 << 30)
    ).limit(n).toArrow()
    sample = np.array([_unit(np.array(v)) for v in drawn.column("embedding").to_pylist()]).reshape(-1, dim)
    way, centre, share = planned(sample, count)
    return fit(sample, way.rotations, centre, share), way.part


def _links(classes: DataFrame, model: Rotations, width: int) -> DataFrame:
    """``(id, n, other)``: links counted per block, and a link of each vector that has one."""
    shared = classes.sparkSession.sparkContext.broadcast(model)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 5000):
            if not batch.num_rows:
                continue
            units = np.array([_unit(np.array(v)) for v in batch.column("embedding").to_pylist()])
            found = codes(units, shared.value).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(list(found), pa.list_(pa.int64()))], names=["id", "codes"]
            )

    coded_ids = kept(classes.select("id", "embedding").mapInArrow(coded, "id long, codes array<long>"), "codes")
    n_bits, rotations = min(BITS, model.dim), len(model.turns)
    shifts = range(0, n_bits - n_bits % width, width)
    mask = (1 << width) - 1 if width < 64 else -1
    parts = F.array(
        *[
            F.struct(
                F.lit(r * len(shifts) + p).alias("part"),
                F.shiftrightunsigned(F.get("codes", F.lit(r)), shift).bitwiseAND(F.lit(mask)).cast("long").alias("bits"),
            )
            for r in range(rotations)
            for p, shift in enumerate(shifts)
        ]
    )
    checked = min(CHECKED, rotations)
    first = F.slice("codes", 1, checked).alias("codes")
    entries = coded_ids.select("id", first, F.explode(parts).alias("e")).select("id", "codes", "e.part", "e.bits")
    bucket = ["part", "bits"]
    counted = entries.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1")
    crowded = kept(entries.join(counted, bucket), "buckets")

    # Who has a partner near over all bits: a pair at the least cosine differs in the model's
    # share of them, with a standard error that 4.5 times over is added here.
    share, total = model.share, checked * n_bits
    most = math.ceil(total * share + 4.5 * 1.5 * math.sqrt(total * share * (1 - share)))
    distance = sum((F.bit_count(F.get("codes", F.lit(r)).bitwiseXOR(F.get("codes2", F.lit(r)))) for r in range(checked)), F.lit(0))
    tasks = F.ceil(F.col("n") / HOT)
    asking = crowded.withColumn("salt", F.pmod(F.xxhash64("id"), tasks))
    asked = crowded.select(
        *bucket, F.col("id").alias("id2"), F.col("codes").alias("codes2"),
        F.explode(F.sequence(F.lit(0).cast("long"), tasks - 1)).alias("salt"),
    )
    near = kept(
        asking.join(
            asked,
            (asking["part"] == asked["part"]) & (asking["bits"] == asked["bits"]) & (asking["salt"] == asked["salt"])
            & (asking["id"] != asked["id2"]) & (distance <= most),
            "left_semi",
        ).select(*bucket, "id"),
        "near",
    )
    return _meet(classes.select("id", "copies", "embedding").join(coded_ids, "id"), near, width, n_bits)


def _meet(members: DataFrame, near: DataFrame, width: int, n_bits: int) -> DataFrame:
    """``(id, n, other)`` of the members of each bucket of ``near(part, bits, id)``, in pairs of blocks;
    ``members(id, copies, embedding, codes)`` holds what they are."""
    bucket = ["part", "bits"]
    sizes = near.groupBy(*bucket).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = near.join(sizes, bucket).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")))
    # Every pair of blocks of a bucket, each block with itself included.
    pairs = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda k: F.struct(F.least("mine", k).alias("i"), F.greatest("mine", k).alias("j")),
    )
    dealt = placed.select(*bucket, "id", "mine", F.explode(pairs).alias("p")).select(
        *bucket, "id", "p.i", "p.j", (F.col("mine") == F.col("p.i")).alias("first"), (F.col("mine") == F.col("p.j")).alias("second")
    )
    full = dealt.join(members, "id")
    return full.groupBy(*bucket, "i", "j").applyInArrow(lambda table: _block_links(table, width, n_bits), "id long, n long, other long")


def op3_embedding_near_dedup(spark, sf_dir):
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
