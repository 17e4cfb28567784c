"""Near-duplicate documents by an LSH forest over MinHash signatures.

1. Each text becomes the set of its 5-word shingles (64-bit hashes) and a signature of 96
   minima. Texts with equal sets are one class from here on, whatever their number.
2. The forest has 24 orders of the signature, one beginning at every fourth place. A region
   is what shares the first 4 values of an order; one of many members is descended by two values
   at a time until few share the longer prefix, so that each region has the depth its own crowd asks
   for, up to 12 values. Members are sorted by the rest of their order. Candidates are those with
   the longest common prefixes: the two members of a region of two, or neighbours in the sorted order.
   What still crowds at 12 values is nearly equal; it is cut by a hash to be sorted.
3. Candidates whose signatures agree in too few places are left; the others are confirmed
   on full sets, and what is linked forms components.
4. Neighbours are not all pairs of a large region. So in regions of more than a neighbourhood
   that hold several components, members outside the largest component are compared with
   every member of another component, in blocks. Nothing is capped: a pair that shares a
   region of any order is either confirmed or refuted, or already in one component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Bounded, kept, read_documents, slices, small, small_batches
from .components import connected

WORDS = 5
PERCENT = 75
DEPTH = 4
SORTED = 8
"""Values of an order behind those of the region, by which members are sorted."""

STEP = 2
"""Values by which a crowded region is descended at once."""

ORDERS = 24
HASHES = DEPTH * ORDERS
NEAR = 4
"""Neighbours on either side in a sorted region."""

MIN_AGREEING = int(0.59 * HASHES)
"""Of 96 values at least 56 agree: 3.8 standard errors below a similarity of 0.75."""

BLOCK = 256
"""Members of a region that one sort or one block comparison takes."""

_SEEDS = np.random.default_rng(20).integers(1, 2**63, HASHES, dtype=np.uint64) | np.uint64(1)
_STEPS = np.random.default_rng(21).integers(1, 2**63, WORDS, dtype=np.uint64) | np.uint64(1)
_SHIFT = np.uint64(32)


class WordHashes(Bounded):
    def __missing__(self, word: bytes) -> int:
        return self.put(word, xxhash.xxh64_intdigest(word))


_word_hashes = WordHashes(50_000)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 5-word shingles of a text as 64-bit hashes.

    A-Z are lower-cased; words are what ASCII white space separates. Fewer than five words
    are one shingle; none give an empty set.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    code = np.fromiter(map(_word_hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(code) - WORDS + 1)
    mixed = np.zeros(n, dtype=np.uint64)
    for place, step in enumerate(_STEPS[: len(code)]):
        mixed += code[place : place + n] * step
    if len(code) < WORDS:
        mixed += np.uint64(len(code))
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    mixed.sort()
    return mixed if n == 1 else mixed[np.concatenate(([True], mixed[1:] != mixed[:-1]))]


def signature(found: np.ndarray) -> np.ndarray:
    """The 96 minima of a set, 32 bits each; a long set is taken in parts."""
    least = np.full(HASHES, 2**63, dtype=np.uint64)
    for begin in range(0, len(found), 8192):
        part = found[begin : begin + 8192]
        np.minimum(least, ((part * _SEEDS[:, None]) >> _SHIFT).min(axis=1), out=least)
    return least.astype(np.uint32).view(np.int32)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        counts, keys, signatures = [], [], []
        for text in batch.column("text").to_pylist():
            found = shingles(text)
            counts.append(len(found))
            keys.append(xxhash.xxh128_digest(found.tobytes()) if len(found) else None)
            signatures.append(signature(found) if len(found) else None)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(counts, pa.int64()),
                pa.array(keys, pa.binary()),
                pa.array(signatures, pa.list_(pa.int32())),
            ],
            names=["doc_id", "n_shingles", "set_key", "signature"],
        )


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 200):
        sets = [shingles(text).view(np.int64) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"]
        )


def _in_orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 4000):
        column = batch.column("signature")
        values = column.flatten().to_numpy().view(np.uint32).reshape(-1, HASHES).astype(np.uint64)
        ids = batch.column("id").to_numpy()
        for order in range(ORDERS):
            begin = order * DEPTH
            region = np.full(len(ids), order + 1, dtype=np.uint64)
            for place in range(begin, begin + DEPTH):
                region = (region ^ values[:, place]) * np.uint64(0x9E3779B97F4A7C15)
                region ^= region >> np.uint64(32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(region.view(np.int64)), pa.array(np.full(len(ids), order, dtype=np.int8)), pa.array(ids)],
                names=["region", "tree", "id"],
            )


def _forest(classes: DataFrame) -> DataFrame:
    """``(region, tree, id)``: every class in every order."""
    return classes.select("id", "signature").mapInArrow(_in_orders, "region long, tree byte, id long")


def _rest_of_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 4000):
        values = batch.column("signature").flatten().to_numpy().view(np.uint32).reshape(-1, HASHES)
        begin = (batch.column("tree").to_numpy().astype(np.int64) + 1) * DEPTH
        rest = np.take_along_axis(values, (begin[:, None] + np.arange(SORTED)) % HASHES, axis=1).astype(">u4")
        deeper = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * SORTED), len(rest), [None, pa.py_buffer(rest.tobytes())])
        yield pa.RecordBatch.from_arrays(
            [batch.column("region"), deeper.cast(pa.binary()), batch.column("id"), batch.column("n")],
            names=["region", "deeper", "id", "n"],
        )


def _sorted_by(crowded: DataFrame, classes: DataFrame) -> DataFrame:
    """``(region, deeper, id, n)``: members with the bytes of the next values of their order.

    In a region of no more than a neighbourhood all are neighbours in any order, and nothing is read.
    """
    larger = crowded.where(F.col("n") > NEAR + 1).join(classes.select("id", "signature"), "id")
    found = larger.mapInArrow(_rest_of_order, "region long, deeper binary, id long, n long")
    few = crowded.where(F.col("n") <= NEAR + 1).select("region", F.lit(None).cast("binary").alias("deeper"), "id", "n")
    return kept(found, "sorted").unionByName(few)


def _descended(members: DataFrame) -> DataFrame:
    """``members(region, deeper, id, n)`` with ``cut``: what of a crowded region shares a prefix so long that few do.

    Of prefixes only the crowded ones are looked up, and there are fewer of them than members by ``BLOCK``.
    """
    depths = range(STEP, SORTED + 1, STEP)
    crowded = F.col("n") > BLOCK

    def prefix(depth: int):
        return F.xxhash64("region", F.substring("deeper", 1, 4 * depth))

    longer = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), prefix(d).alias("prefix")) for d in depths]))
    counted = members.where(crowded).select(longer.alias("p")).groupBy("p.depth", "p.prefix").agg(F.count("*").alias("held"))
    full = kept(counted.where(F.col("held") > BLOCK), "prefixes")
    rows = full.count()
    cut = None
    for depth in reversed(depths):
        mine = small(full.where(F.col("depth") == depth), rows, 24).select(
            F.col("prefix").alias(f"prefix{depth}"), F.col("held").alias(f"held{depth}")
        )
        members = members.withColumn(f"prefix{depth}", F.when(crowded, prefix(depth))).join(mine, f"prefix{depth}", "left")
        if cut is None:
            cut = F.xxhash64(f"prefix{depth}", F.pmod(F.xxhash64("id"), F.ceil(F.coalesce(f"held{depth}", F.lit(1)) / BLOCK)))
        else:
            cut = F.when(F.col(f"held{depth}").isNull(), F.col(f"prefix{depth}")).otherwise(cut)
    return members.select("region", "deeper", "id", "n", F.when(crowded, cut).otherwise(F.lit(0).cast("long")).alias("cut"))


def _neighbours(members: DataFrame) -> DataFrame:
    """``(a, b)``: members of a region with the longest common prefixes, near in its sorted order."""
    order = Window.partitionBy("region", "cut").orderBy("deeper", "id")
    ahead = F.array(*[F.lead("id", k).over(order) for k in range(1, NEAR + 1)])
    paired = _descended(members).select("id", ahead.alias("ahead"))
    return paired.select(F.col("id").alias("a"), F.explode("ahead").alias("b")).where("b is not null")


def _alike(a: str, b: str):
    """How many values of two signatures agree."""
    same = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda total, x: total + x)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs(a, b)`` whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb")).alias("common")
    counted = pairs.join(left, "a").join(right, "b").select(
        "a", "b", common, (F.size("sa") + F.size("sb")).alias("both")
    )
    return counted.where(100 * F.col("common") >= PERCENT * (F.col("both") - F.col("common"))).select("a", "b")


def _block_links(table: pa.Table) -> pa.Table:
    """Links between members of different components in one pair of blocks of a region."""
    asks = table.column("asks").to_numpy(zero_copy_only=False)
    ids = table.column("id").to_numpy()
    labels = table.column("label").to_numpy()
    signatures = np.array(table.column("signature").to_pylist(), dtype=np.int32)
    sets = [np.asarray(s.values) for s in table.column("shingles")]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            x = up
        return x

    links = []
    others = np.flatnonzero(~asks)
    for i in np.flatnonzero(asks):
        agreeing = (signatures[others] == signatures[i]).sum(axis=1)
        likely = others[agreeing >= MIN_AGREEING]
        for j in likely[np.argsort(-agreeing[agreeing >= MIN_AGREEING], kind="stable")]:
            mine, its = find(labels[i]), find(labels[j])
            if mine == its:
                continue
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * common >= PERCENT * (len(sets[i]) + len(sets[j]) - common):
                links.append((ids[i], ids[j]))
                root[max(mine, its)] = min(mine, its)
    a, b = zip(*links) if links else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _rest(members: DataFrame, labels: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links that neighbours missed in regions of more than a neighbourhood.

    ``members(region, id, n)`` are compared in blocks, unless they are of one component.
    """
    label = F.coalesce("component", "id").alias("label")
    labelled = kept(
        members.join(labels.withColumnRenamed("node", "id"), "id", "left").select("region", "id", "n", label),
        "members",
    )
    parts = labelled.groupBy("region", "label", "n").agg(F.count("*").alias("size"))
    mixed = parts.groupBy("region", "n").agg(F.max_by("label", F.struct("size", "label")).alias("main"), F.max("size").alias("most")).where("most < n")
    open_members = labelled.join(mixed.select("region", "main", "most"), "region").select(
        "region", "id", "label", (F.col("label") != F.col("main")).alias("asks"),
        F.ceil(F.col("n") / BLOCK).alias("blocks"), F.ceil((F.col("n") - F.col("most")) / BLOCK).alias("ask_blocks"),
    )
    open_members = kept(open_members, "open")
    ids = open_members.select("id").distinct()
    sets = _sets_of(ids, texts).join(classes.select("id", "signature"), "id")

    def block(of: str):
        return F.pmod(F.xxhash64("id"), F.col(of))

    all_blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    ask_blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("ask_blocks") - 1))
    asking = open_members.where("asks").select(
        "region", "id", "label", F.lit(True).alias("asks"), block("ask_blocks").alias("i"), all_blocks.alias("j")
    )
    asked = open_members.select(
        "region", "id", "label", F.lit(False).alias("asks"), block("blocks").alias("j"), ask_blocks.alias("i")
    )
    rows = asking.unionByName(asked).join(sets, "id")
    return rows.groupBy("region", "i", "j").applyInArrow(_block_links, "a long, b long")


def _sets_of(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """``(id, shingles)`` of the documents ``ids(id)``, made anew from their texts."""
    ids = kept(ids, "asked")
    wanted = small(ids.withColumnRenamed("id", "doc_id"), ids.count(), 16)
    return texts.join(wanted, "doc_id", "left_semi").mapInArrow(_with_sets, "id long, shingles array<long>")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every row of ``docs(doc_id, text)``.

    Null and word-less texts have no shingles and are linked with nothing. Rows that share
    an id are one document with several texts. A row without an id takes part in no link;
    its component is null and it is kept. Other columns are left aside.
    """
    texts = small_batches(docs).select("doc_id", "text")
    sketches = kept(
        texts.mapInArrow(_sketched, "doc_id long, n_shingles long, set_key binary, signature array<int>"),
        "sketches",
    )
    classes = kept(
        sketches.where("set_key is not null and doc_id is not null")
        .groupBy("set_key")
        .agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature")),
        "classes",
    )
    entries = kept(_forest(classes), "forest")
    regions = entries.groupBy("region").agg(
        F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b")
    ).where("n > 1")
    regions = kept(regions, "regions")
    members = kept(entries.join(regions.where("n > 2").select("region", "n"), "region"), "crowded")
    pairs = regions.where("n = 2").select("a", "b").unionByName(_neighbours(_sorted_by(members, classes)))
    a, b = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    left = classes.select(F.col("id").alias("a"), F.col("signature").alias("ga"))
    right = classes.select(F.col("id").alias("b"), F.col("signature").alias("gb"))
    likely = kept(
        pairs.select(a, b).where("a <> b").distinct().join(left, "a").join(right, "b")
        .where(_alike("ga", "gb") >= MIN_AGREEING).select("a", "b").distinct(),
        "likely",
    )
    sets = kept(_sets_of(likely.select(F.explode(F.array("a", "b")).alias("id")).distinct(), texts), "sets")
    labels = connected(_confirmed(likely, sets))

    more = kept(_rest(members.where(F.col("n") > NEAR + 1).select("region", "id", "n"), labels, classes, texts), "more")
    if not more.isEmpty():
        known = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
        labels = connected(known.unionByName(more))

    component = F.coalesce("component", "id").alias("component_id")
    placed = classes.select("set_key", "id").join(labels.withColumnRenamed("node", "id"), "id", "left").select("set_key", component)
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return (
        sketches.select("doc_id", "n_shingles", "set_key")
        .join(placed, "set_key", "left")
        .select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))
    )


def op8_near_duplicates(spark, sf_dir):
    return near_duplicates(read_documents(spark, sf_dir, "doc_id", "text"))
