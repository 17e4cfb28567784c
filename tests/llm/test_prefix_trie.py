import hashlib
import math
import zlib

import pytest

from dossierlens.llm import common
from dossierlens.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string"


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]


def by_hand(rows):
    own = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            own.setdefault(conv_id, []).append((turn is not None, turn or 0, digest(role, text), role, text))
    own = {c: [(r, x) for *_, r, x in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:])
    nodes = {}
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        ends = sorted(c for c in members if len(rebuilt[c]) == len(path))
        out.append(
            (
                min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members),
                sum(len(p) == len(path) + 1 for p in below),
                sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below) for p in below),
                sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p),
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return sorted(out, key=repr)


def found(spark, rows, extra=()):
    df = spark.createDataFrame([r + tuple(range(len(extra))) for r in rows], SCHEMA + "".join(f", {c} long" for c in extra))
    return sorted((tuple(r) for r in trie.prefix_trie(df).collect()), key=repr)


def conversations(rng, n, words="ab", longest=14):
    return [(c, t, rng.choice("ua"), rng.choice(words)) for c in range(n) for t in range(rng.randint(1, longest))]


@pytest.mark.parametrize("block", [1, 3, 4])
def test_any_block_length_gives_the_same_trie(spark, rng, monkeypatch, block):
    monkeypatch.setattr(trie, "BLOCK_TURNS", block)
    monkeypatch.setattr(trie, "STRETCH", 2)
    monkeypatch.setattr(trie, "IDS_PER_TEXT", 3)
    rows = [(c, t, "u", rng.choice("ab")) for c in range(90, 140) for t in range(rng.randint(1, 14))]
    # A group of copies, and one that stands behind the first eight turns of a longer one.
    rows += [(c, t, "u", "é" * t) for c in range(300, 330) for t in range(8 if c % 2 else 11)]
    assert found(spark, rows) == by_hand(rows)


def test_odd_rows(spark):
    rows = [
        (7, None, None, None), (7, None, None, "x"), (7, 2, "user", None), (7, 2, "user", None), (7, -1, None, "é😀"), (7, 2, "user", "b"),
        (None, 1, "user", "lost"), (100, 1, "user", "a"), (101, 1, "user", "a"), (102, 1, "user", "b"), (102, 2, "a", "x" * 200_000), (-5, 1, "user", "a"),
        (2**62, 1, "r", "1:"), (2**62 + 1, 1, "r", ""),
    ]
    clashing = ("place", "n_chars", "k1", "depth", "block", "digest", "n_turns", "_task")
    assert found(spark, rows, clashing) == by_hand(rows)


def test_only_turnless_conversations_and_an_empty_table(spark):
    # Conversation 301 keeps nothing of its one turn, and conversation 300 is not there.
    lonely = next(c for c in range(301, 400) if zlib.crc32(str(c).encode()) % 6 > 1)
    assert found(spark, [(lonely, 1, "u", "gone")]) == [(lonely, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lonely).encode()).hexdigest())]
    assert found(spark, []) == []


def test_blocks_without_siblings_are_not_taken_apart(spark, monkeypatch):
    """Only blocks that have siblings reach the refinement; chains come out of the block digests alone."""
    seen = []
    real = trie.kept
    monkeypatch.setattr(trie, "kept", lambda df, name: seen.append((name, real(df, name))) or seen[-1][1])
    rows = [(c, t, "u", f"t{t}" if t < 20 else f"{c}") for c in (500, 600, 700) for t in range(22)]
    got = found(spark, rows)
    assert got == by_hand(rows)
    tables = dict(seen)
    assert tables["chains"].count() and tables["distinct"].count() == 5 + 3  # the sixth block of each differs


def test_running_values_of_one_long_key(spark, monkeypatch):
    monkeypatch.setattr(trie, "STRETCH", 7)
    df = spark.range(100).selectExpr("1L as key", "id as place", "id as v", "id * 31 as x")
    rows = trie.running(df, "key", "place", {"v": "sum", "x": "bit_xor"}).collect()
    total, mixed = 0, 0
    for r in sorted(rows, key=lambda r: r["place"]):
        total, mixed = total + r["place"], mixed ^ (r["place"] * 31)
        assert (r["v"], r["x"]) == (total, mixed)
    down = trie.running(df, "key", "place", {"v": "sum"}, descending=True).collect()
    assert all(r["v"] == sum(range(r["place"], 100)) for r in down)


def test_short_conversations_need_few_tables(spark, rng, monkeypatch):
    """Short conversations are one stretch, so what runs along them is not written first, nor are counts and ids of small groups."""
    written = []
    real = trie.kept
    monkeypatch.setattr(trie, "kept", lambda df, name: written.append(name) or real(df, name))
    monkeypatch.setattr(common, "kept", lambda df, name: written.append(name) or real(df, name))
    rows = conversations(rng, 60)
    assert found(spark, rows) == by_hand(rows)
    assert [name for name in written if name != "totals"] == ["paths", "distinct", "chains", "nodes", "hung"]


@pytest.mark.parametrize("stretch", [14, 15, 16])
def test_stretches_about_as_long_as_the_longest_conversation(spark, rng, monkeypatch, stretch):
    monkeypatch.setattr(trie, "STRETCH", stretch)
    monkeypatch.setattr(trie, "BLOCK_TURNS", 1)
    monkeypatch.setattr(trie, "IDS_PER_TEXT", 2)
    rows = conversations(rng, 30) + [(500, t, "u", "a") for t in range(15)]
    assert found(spark, rows) == by_hand(rows)


def test_running_values_within_one_stretch_and_over_several(spark, monkeypatch):
    df = spark.range(50).selectExpr("id % 3 as key", "id as place", "id as v")
    one = trie.running(df, "key", "place", {"v": "sum"}, descending=True, most=49)
    assert one._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    monkeypatch.setattr(trie, "STRETCH", 7)
    assert sorted(one.collect()) == sorted(trie.running(df, "key", "place", {"v": "sum"}, descending=True, most=49).collect())
