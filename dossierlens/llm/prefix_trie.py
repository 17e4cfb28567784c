"""A trie of conversations: which turns they share from the start, and what sharing saves.

Conversations are first grouped by digests of fixed-length blocks of ``BLOCK_TURNS`` turns. The
path of a conversation to the end of a block is the exclusive or of hashes of its blocks with
their numbers, 128 bits wide, so it is summed up along the conversation, and equal paths meet in one
``groupBy``; from then on there is one row per distinct block. A block without siblings is a
chain of nodes with the same members, and none of its turns is looked at again. Only where
siblings diverge are their turn boundaries refined, by digests of the turns so far.

A node is named by its smallest member and its depth. The nodes a conversation gives its name to
are the lower end of its path, since members only get fewer further down; so the trie is a
tree of such chains, and a chain's top hangs on a node of another one. Sums over subtrees are
doubled along that tree in as many rounds as the logarithm of its height, and then run up each chain.

No conversation, node or group of equal conversations is gathered in one row or task: turns get
their places from a sort by ranges, running values go in stretches of ``STRETCH``, joins on a
parent are salted, and members' ids are joined to texts in parts before they are digested. Most tables are written; the
small ones of a row a conversation, on which no long chain of steps hangs, are persisted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import dealt_in_order
from .common import kept, salted_join

BLOCK_TURNS = 4
STRETCH = 4096
"""Rows of one conversation that a window runs over."""

MOST_HEAD = 5
"""A conversation takes over fewer turns than six."""

IDS_PER_TEXT = 4096
SCHEMA = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _digest(value: Column) -> Column:
    return F.left(F.sha2(value, 256), F.lit(32))


def running(rows: DataFrame, key: str, place: str, values: dict[str, str], descending: bool = False, most: int | None = None) -> DataFrame:
    """``rows`` with each of ``values`` (column: ``sum`` or ``bit_xor``) taken over the rows of
    equal ``key`` up to its own ``place``, or from it on if ``descending``.

    Places are distinct within a key, from 0 and, if it is given, not above ``most``. If that may be more than one stretch of ``STRETCH`` places, rows are
    written and stretches folded first, so no window runs over more rows of a key than a stretch has, or than it has stretches.
    """
    fold = {"sum": F.sum, "bit_xor": F.bit_xor}
    if most is not None and most < STRETCH:
        along = Window.partitionBy(key).orderBy(F.col(place).desc() if descending else F.col(place)).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumns({c: fold[f](c).over(along) for c, f in values.items()})
    cut = kept(rows, "running").withColumn("_stretch", F.floor(F.col(place) / STRETCH).cast("long"))
    order = F.col("_stretch").desc() if descending else F.col("_stretch")
    earlier = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    folded = cut.groupBy(key, "_stretch").agg(*(fold[f](c).alias(c) for c, f in values.items()))
    before = folded.select(key, "_stretch", *(F.coalesce(fold[f](c).over(earlier), F.lit(0)).alias(f"_before_{c}") for c, f in values.items()))
    inside = Window.partitionBy(key, "_stretch").orderBy(F.col(place).desc() if descending else F.col(place)).rowsBetween(Window.unboundedPreceding, 0)

    def total(c: str, f: str) -> Column:
        here, up = fold[f](c).over(inside), F.col(f"_before_{c}")
        return here + up if f == "sum" else here.bitwiseXOR(up)

    return cut.join(before, [key, "_stretch"]).withColumns({c: total(c, f) for c, f in values.items()}).select(*rows.columns)


def taken_over(conv_id: Column) -> Column:
    """How many turns a conversation takes over from the one its hundred begins with."""
    return F.pmod(F.crc32(conv_id.cast("string")), F.lit(MOST_HEAD + 1))


def _rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv_id, place, digest, n_chars)`` of all rebuilt turns, and ``(conv_id, n_turns)`` of all conversations."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    given = conversations.where("conv_id is not null").select(
        "conv_id", "turn", _digest(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("digest"), F.length(text).cast("long").alias("n_chars")
    )
    dealt, runs = dealt_in_order(given, ["conv_id"], ["turn", "digest"])
    runs = runs.persist()
    run, at = ["conv_id", "_task"], F.col("place") + F.col("_shift")
    base, h = F.col("conv_id") - F.col("conv_id") % 100, taken_over(F.col("conv_id"))
    is_base = F.col("conv_id") % 100 == 0
    first = F.struct(at.alias("place"), "digest", "n_chars")
    heads = (
        dealt.where(is_base).join(runs.where(is_base & (F.col("_before") < MOST_HEAD)), run).where(at <= MOST_HEAD)
        .groupBy(F.col("conv_id").alias("base"))
        .agg(F.sort_array(F.collect_list(first)).alias("head"))
    )
    members = (
        runs.groupBy("conv_id").agg(F.sum("_n").alias("n_own"))
        .withColumns({"base": base, "h": h})
        .join(heads, "base", "left")
        .withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<struct<place:bigint,digest:string,n_chars:bigint>>")), F.lit(1), F.col("h").cast("int")))
        .select("conv_id", "h", "n_own", "head", F.size("head").cast("long").alias("n_head"))
    )
    members = members.persist()
    copied = members.select("conv_id", F.inline("head"))
    # Turns meet what is known of their run, so a long conversation is no hot key.
    known = runs.join(members.where("n_own > h").select("conv_id", "h", "n_head"), "conv_id").select(*run, "_shift", "h", "n_head")
    own = dealt.join(known, run).where(at > F.col("h")).select("conv_id", (at - F.col("h") + F.col("n_head")).alias("place"), "digest", "n_chars")
    return copied.unionByName(own), members.select("conv_id", (F.col("n_head") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("n_turns"))


def _hashes(block: Column, digest: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.lit("a"), block, digest), F.xxhash64(digest, F.lit("b"), block)


def _joined_digest(turns: Column) -> Column:
    return _digest(F.array_join(F.transform(turns, lambda t: t["digest"]), ""))


def _paths(turns: DataFrame, most: int) -> DataFrame:
    """``(conv_id, block, turns, p1, p2, k1, k2)``: the path before (p) and after (k) each block of conversations of at most ``most`` turns."""
    blocks = (
        turns.groupBy("conv_id", F.floor((F.col("place") - 1) / BLOCK_TURNS).cast("long").alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct("place", "digest", "n_chars"))).alias("turns"))
        .select("conv_id", "block", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["n_chars"].alias("n_chars"))).alias("turns"))
    )
    h1, h2 = _hashes(F.col("block"), _joined_digest(F.col("turns")))
    hashed = blocks.withColumns({"h1": h1, "h2": h2, "k1": h1, "k2": h2})
    along = running(hashed, "conv_id", "block", {"k1": "bit_xor", "k2": "bit_xor"}, most=most // BLOCK_TURNS)
    return along.withColumns({"p1": F.col("k1").bitwiseXOR(F.col("h1")), "p2": F.col("k2").bitwiseXOR(F.col("h2"))}).drop("h1", "h2")


def _nodes(paths: DataFrame, members: DataFrame) -> DataFrame:
    """``(conv_id, depth, n_convs, n_chars, k1, k2, p1, p2)``: every node by its smallest member.

    ``k`` is the path to the node where a child or an end can stand, else null, and ``p`` that to its parent.
    """
    distinct = kept(
        paths.groupBy("p1", "p2", "k1", "k2", "block").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("turns").alias("turns")),
        "distinct",
    )
    row = F.struct("k1", "k2", "block", "n_convs", "conv_id", "turns")
    only = distinct.groupBy("p1", "p2").agg(F.count("*").alias("siblings"), F.first(row).alias("row")).where("siblings = 1").select("p1", "p2", "row.*")
    only = kept(only, "chains")
    last = F.col("at") == F.size("turns") - 1
    alone = only.select("*", F.posexplode("turns").alias("at", "turn")).select(
        "conv_id", (F.col("block") * BLOCK_TURNS + F.col("at") + 1).alias("depth"), "n_convs", "turn.n_chars",
        *(F.when(last, F.col(k)).alias(k) for k in ("k1", "k2")), *(F.when(F.col("at") == 0, F.col(p)).alias(p) for p in ("p1", "p2")),
    )
    forked = distinct.join(only.select("k1", "k2"), ["k1", "k2"], "left_anti")
    so_far = F.transform(F.sequence(F.lit(1), F.size("turns")), lambda n: _joined_digest(F.slice("turns", F.lit(1), n)))
    at, here = F.col("at"), F.get("so_far", F.col("at"))
    up = F.get("so_far", at - 1)
    keys = {f"k{i}": F.col(f"p{i}").bitwiseXOR(h) for i, h in enumerate(_hashes(F.col("block"), here), 1)}
    parents = {f"q{i}": F.when(at == 0, F.col(f"p{i}")).otherwise(F.col(f"p{i}").bitwiseXOR(h)) for i, h in enumerate(_hashes(F.col("block"), up), 1)}
    refined = (
        forked.withColumn("so_far", so_far).select("p1", "p2", "block", "n_convs", "conv_id", "so_far", F.posexplode("turns").alias("at", "turn"))
        .select("conv_id", "n_convs", (F.col("block") * BLOCK_TURNS + at + 1).alias("depth"), "turn.n_chars", *(c.alias(k) for k, c in (keys | parents).items()))
        .groupBy("k1", "k2", "depth", "n_chars", F.col("q1").alias("p1"), F.col("q2").alias("p2"))
        .agg(F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    )
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    root = members.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        "conv_id", zero.alias("depth"), "n_convs", zero.alias("n_chars"), zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2")
    )
    return kept(alone.unionByName(refined).unionByName(root), "nodes")


def _texts_of_ids(most: int):
    """``(k1, k2, first, ids)``: sorted ids of equal keys as texts of at most so many ids."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            k1, k2, ids = (batch.column(c).to_numpy() for c in ("k1", "k2", "conv_id"))
            new = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
            cuts = sorted({0, len(ids), *new.tolist(), *range(0, len(ids), most)})
            found = [(int(k1[b]), int(k2[b]), int(ids[b]), ",".join(map(str, ids[b:e].tolist()))) for b, e in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=["k1", "k2", "first", "ids"])

    return texts


def _digests_of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(k1, k2, ends_sha256)`` of sorted texts; a key's digest runs over as many batches as it has."""
    key, state = None, None
    for batch in batches:
        done = []
        for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids"))):
            if (k1, k2) == key:
                state.update(b"," + ids.encode())
                continue
            if key is not None:
                done.append((*key, state.hexdigest()))
            key, state = (k1, k2), hashlib.sha256(ids.encode())
        yield _digest_rows(done)
    if key is not None:
        yield _digest_rows([(*key, state.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])
    return pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)


def _ends(paths: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(k1, k2, ends_sha256)`` of every path at which a conversation ends."""
    zero = F.lit(0).cast("long")
    last = paths.groupBy("conv_id").agg(F.max(F.struct("block", "k1", "k2")).alias("last")).select("last.k1", "last.k2", "conv_id")
    every = last.unionByName(members.where("n_turns = 0").select(zero.alias("k1"), zero.alias("k2"), "conv_id"))
    # Nodes of more members than a text has ids are few; the ends of all others need no order over tasks.
    path = ["k1", "k2"]
    long = F.broadcast(nodes.where(F.col("k1").isNotNull() & (F.col("n_convs") > IDS_PER_TEXT)).select(*path))
    ids = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",")
    short = every.join(long, path, "left_anti").groupBy(*path).agg(F.sha2(ids, 256).alias("ends_sha256"))
    return short.unionByName(_digests_in_parts(every.join(long, path, "left_semi")))


def _digests_in_parts(ends: DataFrame) -> DataFrame:
    """``(k1, k2, ends_sha256)`` of ``ends(k1, k2, conv_id)``, however many ids a path has."""
    keys = ["k1", "k2", "conv_id"]
    texts = ends.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_texts_of_ids(IDS_PER_TEXT), "k1 long, k2 long, first long, ids string")
    return texts.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(_digests_of_texts, "k1 long, k2 long, ends_sha256 string")


def _chain_totals(chains: DataFrame) -> DataFrame:
    """``(conv_id, saved, leaves)`` summed over each chain of ``chains(conv_id, up, saved, leaves)`` and all below it.

    In round k a chain holds the sums of those less than 2^k steps below, and ``up`` is the chain 2^k steps above.
    """
    while chains.where("up is not null").limit(1).count():
        below = chains.where("up is not null").groupBy(F.col("up").alias("conv_id")).agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
        higher = chains.where("up is not null").select(F.col("conv_id").alias("up"), F.col("up").alias("above"))
        jumped = salted_join(chains.where("up is not null").select("conv_id", "up"), higher, ["up"])
        zero = F.lit(0).cast("long")
        chains = kept(
            chains.drop("up").join(below, "conv_id", "left").join(jumped.select("conv_id", F.col("above").alias("up")), "conv_id", "left").select(
                "conv_id", "up", (F.col("saved") + F.coalesce("more_saved", zero)).alias("saved"), (F.col("leaves") + F.coalesce("more_leaves", zero)).alias("leaves")
            ),
            "totals",
        )
    return chains.select("conv_id", "saved", "leaves")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt ``conversations(conv_id, turn, role, text)``.

    ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``, one row per
    node. Turns go by number, null first, equal numbers by the digest of role and text; repeated rows
    are repeated turns. Null roles and texts are empty. Rows without an id are left out. An empty
    table has no nodes. Other columns are not looked at.
    """
    turns, members = _rebuilt(conversations.select("conv_id", "turn", "role", "text"))
    most = members.agg(F.max("n_turns")).first()[0] or 0
    paths = kept(_paths(turns, most), "paths")
    nodes = _nodes(paths, members)

    spans = nodes.groupBy("conv_id").agg(
        F.min(F.struct("depth", "p1", "p2")).alias("top"), F.max("depth").alias("last"), F.sum((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved")
    ).select("conv_id", "top.*", "last", "saved").persist()
    places = nodes.where("k1 is not null").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("up"))
    hung = kept(salted_join(spans.where("depth > 0").drop("last", "saved"), places, ["p1", "p2"]).select("conv_id", "depth", "up"), "hung")
    # A chain's last node is a leaf if no chain hangs on it.
    holding = hung.select(F.col("up").alias("conv_id"), (F.col("depth") - 1).alias("last")).distinct()
    leaves = spans.join(holding.withColumn("held", F.lit(True)), ["conv_id", "last"], "left").select("conv_id", "saved", F.when(F.col("held").isNull(), 1).otherwise(0).cast("long").alias("leaves"))
    totals = _chain_totals(kept(leaves.join(hung.select("conv_id", "up"), "conv_id", "left"), "totals"))

    # What is known of single nodes: chains that hang on them, who their own chain hangs on, and where it ends.
    none, zero, one = F.lit(None).cast("long"), F.lit(0).cast("long"), F.lit(1).cast("long")
    known = (
        hung.join(totals, "conv_id").select(F.col("up").alias("conv_id"), (F.col("depth") - 1).alias("depth"), none.alias("parent"), zero.alias("last"), one.alias("forks"), "saved", "leaves")
        .unionByName(hung.select("conv_id", "depth", F.col("up").alias("parent"), zero.alias("last"), zero.alias("forks"), zero.alias("saved"), zero.alias("leaves")))
        .unionByName(spans.select("conv_id", F.col("last").alias("depth"), none.alias("parent"), one.alias("last"), zero.alias("forks"), zero.alias("saved"), zero.alias("leaves")))
        .groupBy("conv_id", "depth")
        .agg(F.max("parent").alias("parent"), *(F.sum(c).alias(c) for c in ("last", "forks", "saved", "leaves")))
    )
    continues = F.lit(1) - F.coalesce("last", zero)
    children = F.coalesce("forks", zero) + continues
    own = nodes.join(known, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "n_convs", "k1", "k2",
        F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"),
        children.alias("n_children"),
        (F.coalesce("leaves", zero) + F.when(children == 0, one).otherwise(zero)).alias("n_leaves"),
        (F.coalesce("saved", zero) + (F.col("n_convs") - 1) * F.col("n_chars")).alias("saved_tokens"),
    )
    summed = running(own, "conv_id", "depth", {"n_leaves": "sum", "saved_tokens": "sum"}, descending=True, most=most)
    ended = summed.join(_ends(paths, members, nodes), ["k1", "k2"], "left")
    nobody = F.lit(hashlib.sha256(b"").hexdigest())
    return ended.withColumn("ends_sha256", F.coalesce("ends_sha256", nobody)).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


_CRC = """list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda d: ascii(d)::bigint)),
  lambda c, d: list_reduce(list_prepend(xor(c, d), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))"""

ORACLE = f"""
with turned as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (
    partition by conv_id order by turn nulls first, left(sha256(octet_length(coalesce(role, '')::blob) || ':' || coalesce(role, '') || coalesce(text, '')), 32)) as place
  from conversations where conv_id is not null),
own as (select conv_id, xor({_CRC}, 4294967295) % 6 as h, list(struct_pack(role, text) order by place) as turns from turned group by conv_id),
rebuilt as (
  select o.conv_id, list_concat(coalesce(b.turns[1:o.h], []), o.turns[o.h + 1:]) as turns
  from own o left join own b on b.conv_id = o.conv_id - o.conv_id % 100),
step as (select conv_id, turns, unnest(range(0, len(turns) + 1)) as depth from rebuilt),
node as (
  select turns[1:depth] as path, depth, min(conv_id) as conv_id, count(*) as n_convs,
         coalesce(sha256(string_agg(conv_id::varchar, ',' order by conv_id) filter (len(turns) = depth)), sha256('')) as ends_sha256
  from step group by all),
child as (select path[1:depth - 1] as path, depth - 1 as depth, count(*) as n_children from node where depth > 0 group by all),
full_node as (
  select n.*, coalesce(c.n_children, 0) as n_children, p.conv_id as parent_conv_id,
         case when n.depth = 0 then 0 else (n.n_convs - 1) * length(n.path[-1].text) end as saved
  from node n left join child c on c.path = n.path and c.depth = n.depth
  left join node p on p.depth = n.depth - 1 and p.path = n.path[1:n.depth - 1])
select n.conv_id, n.depth, any_value(n.parent_conv_id) as parent_conv_id, any_value(n.n_convs) as n_convs, any_value(n.n_children)::bigint as n_children,
       count(*) filter (b.n_children = 0)::bigint as n_leaves, sum(b.saved)::bigint as saved_tokens, any_value(n.ends_sha256) as ends_sha256
from full_node n join full_node b on b.depth >= n.depth and b.path[1:n.depth] = n.path
group by n.conv_id, n.depth"""


def op11_prefix_trie(spark, sf_dir):
    """The trie of all conversations; see ``prefix_trie`` for nulls, ties and repeated rows."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
