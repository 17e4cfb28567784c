import math

import numpy as np
import pytest

from dossierlens.llm import cover_tree, inner_products, pivots

SCHEMA = "vec_id long, embedding array<double>, label int"
LOW, HIGH = inner_products.LEAST, inner_products.MOST


def whole(rows, scale):
    out = []
    for vec_id, value, label in rows:
        if vec_id is None or value is None or any(v is None or not math.isfinite(v) for v in value):
            continue
        out.append((vec_id, [max(-(2**63), min(2**63 - 2048, math.floor(scale * v))) if abs(scale * v) < math.inf else (2**63 - 2048 if v > 0 else -(2**63)) for v in value], label))
    return out


def product(a, b):
    return max(LOW, min(HIGH, sum(x * y for x, y in zip(a, b))))


def asking(rows):
    first = {}
    for vec_id, x, label in rows:
        if vec_id % 100 == 0:
            key = (len(x), np.array(x, dtype=np.int64).tobytes(), label)
            if vec_id not in first or key < first[vec_id][0]:
                first[vec_id] = key, x, label
    return [(vec_id, x, label) for vec_id, (_, x, label) in first.items()]


def scored(rows, x, vec_id):
    return sorted(((product(x, y), other, label) for other, y, label in rows if other != vec_id and len(x) == len(y)), key=lambda r: (-r[0], r[1]))


def top_by_hand(rows):
    rows = whole(rows, 1024)
    return sorted((q, k, other, s) for q, x, _ in asking(rows) for k, (s, other, _) in enumerate(scored(rows, x, q)[:10], 1))


def negatives_by_hand(rows):
    rows = [(i, v, (m + 1) % 10 if i % 7 == 0 else m) for i, v, m in whole([r for r in rows if r[0] is not None and r[2] is not None], 256)]
    out = []
    for a, x, label in asking(rows):
        every = scored(rows, x, a)
        for p, positive, _ in [r for r in every if r[2] == label][:5]:
            fit = [r for r in every if r[2] != label and 80 * p <= 100 * r[0] <= 100 * p][:5]
            out += [(a, positive, k, n, p, s) for k, (s, n, _) in enumerate(fit, 1)]
    return sorted(out)


def run(spark, rows, operator, extra=()):
    schema = SCHEMA + "".join(f", {c} long" for c in extra)
    return sorted(tuple(r) for r in operator(spark.createDataFrame([r + (1,) * len(extra) for r in rows], schema)).collect())


def vectors(rng, n, dim=8, clusters=6, spread=0.3):
    r = np.random.default_rng(rng.randrange(1 << 30))
    centres = r.standard_normal((clusters, dim)) * 3
    which = r.integers(clusters, size=n)
    return [(i * 10, (centres[c] + spread * r.standard_normal(dim)).tolist(), int(c % 3)) for i, c in enumerate(which)]


OPERATORS = [(pivots.top_products, top_by_hand), (cover_tree.hard_negatives, negatives_by_hand)]


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(inner_products, "BLOCK_ROWS", 7)
    monkeypatch.setattr(inner_products, "OPENED", (2, 5))
    monkeypatch.setattr(inner_products, "QUERIES_AT_ONCE", 8)


@pytest.mark.parametrize("operator,by_hand", OPERATORS)
@pytest.mark.parametrize("most_cells", [3, 100_000])
def test_same_as_brute_force(spark, rng, monkeypatch, small_blocks, operator, by_hand, most_cells):
    monkeypatch.setattr(inner_products, "MOST_CELLS", most_cells)
    rows = vectors(rng, 400)
    # A third of all rows is one vector, so its scores tie.
    rows = [(i, rows[0][1], label) if k % 3 == 0 else (i, v, label) for k, (i, v, label) in enumerate(rows)]
    assert run(spark, rows, operator) == by_hand(rows) != []


@pytest.mark.parametrize("operator,by_hand", OPERATORS)
def test_odd_rows(spark, rng, small_blocks, operator, by_hand):
    rows = vectors(rng, 60)
    some = rows[3][1]
    odd = [
        (None, some, 1), (1000, None, 1), (1100, [1.0, None] * 4, 1), (1200, [math.nan] * 8, 0), (1300, [math.inf] + [0.0] * 7, 0), (1400, some, None),
        (1500, [0.0] * 8, 1), (1600, [], 1), (1700, [], 2), (1800, [1.0, 2.0], 1), (1803, [2.0, 1.0], 2), (1804, [1.0, 1.0], 1), (1810, [9.0, 9.5], 1),
        (1900, [1e300] + [0.0] * 7, 0), (2000, [3e9] * 8, 1), (2001, [2.9e9] * 8, 2), (2001, [2.9e9] * 8, 2), (2002, [3e9, -3e9] * 4, 1), (2100, some, 1), (2100, some, 1), (2100, [0.5] * 8, 1),
        (-100, some, 2), (0, [4.0] * 8, 0),
    ]
    clashing = ("dim", "vec", "norm", "query", "cell", "block", "score", "centre", "rank", "slot")
    assert run(spark, rows + odd, operator, clashing) == by_hand(rows + odd)


@pytest.mark.parametrize("operator,by_hand", OPERATORS)
def test_no_rows(spark, operator, by_hand):
    assert run(spark, [], operator) == [] == run(spark, [(100, None, None)], operator)
    assert run(spark, [(100, [1.0], 1)], operator) == []


def opened(spark, monkeypatch, rows, operator):
    tables = []
    real = inner_products.kept
    monkeypatch.setattr(inner_products, "kept", lambda df, name: tables.append((name, real(df, name))) or tables[-1][1])
    run(spark, rows, operator)
    pairs = sum(t.count() for name, t in tables if name == "pairs")
    blocks = next(t for name, t in tables if name == "blocks").count()
    return pairs, blocks


@pytest.mark.parametrize("operator,searches", [(pivots.top_products, 1), (cover_tree.hard_negatives, 2)])
def test_bounds_stop_the_search(spark, rng, monkeypatch, small_blocks, operator, searches):
    """Where vectors lie in clusters most cells stay closed."""
    rows = vectors(rng, 800, dim=4, clusters=12, spread=0.05)
    pairs, blocks = opened(spark, monkeypatch, rows, operator)
    asked = sum(i % 100 == 0 for i, _, _ in rows)
    assert 0 < pairs < 0.6 * searches * asked * blocks


def test_tree_is_nested_and_its_radii_cover_all_rows(rng):
    sample = np.array([v for _, v, _ in vectors(rng, 300)])
    norm = float(np.sqrt((sample**2).sum(axis=1)).max())
    tree = cover_tree.grow(sample[:100], norm, 20)
    rows = cover_tree.augmented(sample, norm)
    assert np.allclose((rows**2).sum(axis=1), norm**2)
    assert tree.sizes == [1, 4, 16, 20]
    node, far = cover_tree.descend(tree, rows)
    reach = {int(n): far[node == n].max(axis=0).tolist() for n in np.unique(node)}
    tree = cover_tree.measured(tree, reach)
    up = node
    for level in range(len(tree.sizes) - 1, -1, -1):
        away = np.linalg.norm(rows - tree.centres[: tree.sizes[level]][up], axis=1)
        assert (away <= tree.radii[level][up] + 1e-6).all()
        if level:
            up = tree.parents[level - 1][up]
    # A node left out holds no score inside the window.
    q = sample[:5]
    scores = q @ sample.T
    least, most = np.quantile(scores, 0.9, axis=1), np.quantile(scores, 0.99, axis=1)
    wanted, _ = cover_tree.open_leaves(tree, q, least, most)
    inside = (scores >= least[:, None]) & (scores <= most[:, None])
    assert not (inside & ~wanted[:, node]).any() and not wanted.all()


def test_scores_beyond_doubles_are_exact():
    q = np.array([[2**31 + 1, 3]], dtype=np.int64)
    assert inner_products.exact_scores(q, q).tolist() == [[(2**31 + 1) ** 2 + 9]]
    big = np.array([[2**62, 2**62]], dtype=np.int64)
    assert inner_products.exact_scores(big, -big).tolist() == [[LOW]]


@pytest.mark.parametrize("operator,by_hand", OPERATORS)
def test_tables_that_grow_with_the_queries_are_not_broadcast(spark, rng, monkeypatch, small_blocks, operator, by_hand):
    """Packed, pairs are small; built into a table on the driver they are not."""
    rows = vectors(rng, 300)
    plans, real = {}, inner_products.kept

    def seen(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString())
        return real(df, name)

    monkeypatch.setattr(inner_products, "kept", seen)
    monkeypatch.setattr(inner_products, "BROADCAST_BYTES", 0)
    assert run(spark, rows, operator) == by_hand(rows) != []
    assert len(plans["pairs"]) > 1 and "LeftAnti" in plans["pairs"][1]
    for name in ("pairs", "best", "asked"):
        assert [plan for plan in plans[name] if "BroadcastHashJoin" in plan] == []
