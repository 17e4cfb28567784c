"""Shards of bounded size by extendible hashing.

The directory is indexed by the leading bits of a hash. A bucket above the byte limit is
split on its next bit, and only such buckets are; so a document's shard is the shortest
prefix of its hash whose bytes fit. All buckets of a level are split in one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, read_documents

LIMIT_BYTES = 64 << 20
HASH_BITS = 60
STEP = 12
"""Levels that one round of splitting looks ahead."""


def hash_bits(key: Column) -> Column:
    """60 bits of the MD5 of a key, which any engine can recompute; null is hashed as ''."""
    return F.conv(F.substr(F.md5(F.coalesce(key.cast("string"), F.lit(""))), F.lit(1), F.lit(15)), 16, 10).cast("long")


def _prefix(depth: int | Column) -> Column:
    return F.shiftright(F.col("hash"), HASH_BITS - depth) if isinstance(depth, int) else F.call_function("shiftright", "hash", F.lit(HASH_BITS) - depth)


def shard(docs: DataFrame, limit: int = LIMIT_BYTES, key: str = "doc_id") -> DataFrame:
    """``(doc_id, n_bytes, depth, bucket, part)`` of every row of ``docs(doc_id, text)``.

    ``bucket`` is the leading ``depth`` bits of the hash of the id; depth 0 is a corpus in one
    shard. Null texts have 0 bytes. Rows with the same id have the same hash and cannot be
    told apart by bits: if they alone exceed the limit, their bucket is of the full depth
    and is cut into ``part`` 0, 1, ... by the hash of their texts, as many as it takes on
    average; a text above the limit, or equal rows that exceed it together, share one part.
    """
    return _placed(docs, limit, key).drop("content")


def _placed(docs: DataFrame, limit: int, key: str) -> DataFrame:
    """``shard`` with ``content``, the hash of the text; rows of equal id and content share a place."""
    rows = kept(
        docs.select(
            F.col(key).alias("doc_id"),
            F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
            hash_bits(F.col(key)).alias("hash"),
            F.xxhash64("text").alias("content"),
        ),
        "hashed",
    )
    directory, base = None, 0
    # Buckets still too large after a round go on with the next bits; others are done.
    open_rows = rows.select("hash", "n_bytes")
    while True:
        top = min(base + STEP, HASH_BITS)
        fine = kept(
            open_rows.groupBy(_prefix(top).alias("slot")).agg(F.sum("n_bytes").alias("bytes")), "slots"
        )
        level = F.explode(F.sequence(F.lit(base), F.lit(top))).alias("depth")
        sized = (
            fine.select("bytes", "slot", level)
            .withColumn("bucket", F.call_function("shiftright", "slot", F.lit(top) - F.col("depth")))
            .groupBy("depth", "bucket")
            .agg(F.sum("bytes").alias("bytes"))
        )
        fits = sized.where(F.col("bytes") <= limit).select("depth", "bucket")
        under = fine.select("slot", level).withColumn("bucket", F.call_function("shiftright", "slot", F.lit(top) - F.col("depth")))
        leaves = under.join(fits, ["depth", "bucket"]).groupBy("slot").agg(F.min("depth").alias("depth"))
        leaves = kept(fine.select("slot", "bytes").join(leaves, "slot", "left"), "leaves")
        done = leaves.where("depth is not null").select("slot", F.lit(top).alias("top"), "depth", "bytes")
        large = leaves.where("depth is null").select("slot")
        if top == HASH_BITS:
            done = leaves.select("slot", F.lit(top).alias("top"), F.coalesce("depth", F.lit(HASH_BITS)).alias("depth"), "bytes")
        directory = done if directory is None else directory.unionByName(done)
        if top == HASH_BITS or large.isEmpty():
            break
        open_rows = kept(open_rows.withColumn("slot", _prefix(top)).join(large, "slot", "left_semi").drop("slot"), "open")
        base = top
    tops = [r["top"] for r in directory.select("top").distinct().collect()]  # at most 5
    found = None
    for top in sorted(tops):
        slots = directory.where(F.col("top") == top).drop("top").withColumnRenamed("bytes", "in_slot")
        mine = rows.withColumn("slot", _prefix(top)).join(slots, "slot")
        found = mine if found is None else found.unionByName(mine)
    if found is None:
        found = rows.withColumns({"slot": F.lit(0).cast("long"), "in_slot": F.lit(0).cast("long"), "depth": F.lit(0)})
    parts = F.when(F.col("depth") == HASH_BITS, F.ceil(F.col("in_slot") / limit)).otherwise(1)
    return found.select(
        "doc_id",
        "n_bytes",
        "depth",
        _prefix(F.col("depth")).alias("bucket"),
        F.pmod(F.col("content"), F.greatest(parts, F.lit(1))).cast("int").alias("part"),
        "content",
    )


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT_BYTES) -> None:
    """Write ``docs`` as one folder per shard, ``path/depth=/bucket=/part=``; a shard is one task.

    Every row is written once, with all its columns: rows of one id that hold different texts may go to different parts,
    repeated rows stay repeated. Where ``docs`` has a column of such a name, the folders' is ``shard_`` and that name.
    Null ids and texts have places as in ``shard``; an empty table writes no folder.
    """
    names = []
    for name in ("depth", "bucket", "part"):
        while name.lower() in {c.lower() for c in docs.columns}:
            name = f"shard_{name}"
        names.append(name)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    whole = docs.select(row, F.col("doc_id").alias("id"), F.xxhash64("text").alias("its_content"))
    placed = _placed(docs, limit, "doc_id").select("doc_id", "content", *(F.col(p).alias(n) for p, n in zip(("depth", "bucket", "part"), names))).distinct()
    joined = whole.join(placed, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("its_content") == F.col("content")))
    joined.select("row.*", *names).repartition(*names).write.partitionBy(*names).parquet(path)


def op5_extendible_sharding(spark, sf_dir):
    return shard(read_documents(spark, sf_dir, "doc_id", "text"))


def oracle(limit: int = LIMIT_BYTES) -> str:
    """The same shards, by trying every depth for every document; ids are distinct."""
    return f"""
    with d as (select doc_id, coalesce(strlen(text), 0)::bigint as n_bytes,
                      ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as hash from documents),
    tried as (select doc_id, n_bytes, depth, hash >> ({HASH_BITS} - depth) as bucket
              from d, (select unnest(range(0, {HASH_BITS} + 1))::int as depth)),
    sized as (select *, sum(n_bytes) over (partition by depth, bucket) as bytes from tried)
    select doc_id, n_bytes, min(depth) as depth, min_by(bucket, depth) as bucket, 0::int as part
    from sized where bytes <= {limit} group by doc_id, n_bytes"""
