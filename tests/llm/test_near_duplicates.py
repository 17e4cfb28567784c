import itertools

import numpy as np
import pytest

from dossierlens.llm import near_duplicates as near
from dossierlens.llm import vectors
from dossierlens.llm.components import connected

from .conftest import prose


def components(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(table, rng, shape):
    links = {
        "path": [(i, i + 1) for i in range(60)] + [(100, 101)],
        "star": [(50, i) for i in range(50)] + [(7, 7)],
        "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)],
        "none": [],
    }[shape]
    found = connected(table([*links, (None, 3)], "a long, b long")).collect()
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert {r["node"]: r["component"] for r in found} == components(links, nodes)
    assert len(found) == len(nodes)


def shingle_set(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lowered) if w]
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def by_hand(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    links = [
        (a, b)
        for a, b in itertools.combinations(sets, 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    return {i: (len(sets[i]), c) for i, c in components(links, sets).items()}


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = prose(rng, 1)
    return " ".join(words)


def test_near_duplicates_match_brute_force(table, rng):
    base = [prose(rng, rng.randint(5, 150)) for _ in range(25)]
    rows = [(3 * i, t) for i, t in enumerate(base)]
    rows += [(1000 + i, edited(rng, rng.choice(base[:8]), rng.randint(0, 9))) for i in range(150)]
    rows += [(5000 + i, base[3].upper() if i % 2 else base[3]) for i in range(40)]
    found = near.near_duplicates(table(rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == by_hand(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_a_crowded_region_loses_no_link(table, rng, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 16)
    text = prose(rng, 60)
    rows = [(i, edited(rng, text, rng.randint(1, 7))) for i in range(160)]
    found = near.near_duplicates(table(rows)).collect()
    expected = by_hand(rows)
    assert len({c for _, c in expected.values()}) > 1
    assert {r["doc_id"]: r["component_id"] for r in found} == {i: c for i, (_, c) in expected.items()}


def test_crowded_regions_are_descended_until_few_share_a_prefix(table, rng, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 10)

    def order(*values):
        return b"".join(v.to_bytes(4, "big") for v in (*values, *(rng.randrange(2**32) for _ in range(near.SORTED - len(values)))))

    shallow = [order() for _ in range(8)]  # a region that is small as it is
    deep = [order(7, 7, k % 4, 1) for k in range(30)]  # small groups at the second step
    equal = [bytes(4 * near.SORTED)] * 45  # no depth is enough
    rows = [(1, d, i, len(shallow)) for i, d in enumerate(shallow)]
    rows += [(2, d, 100 + i, len(deep + equal)) for i, d in enumerate(deep + equal)]
    found = near._descended(table(rows, "region long, deeper binary, id long, n long")).collect()
    assert sorted(r["id"] for r in found) == [r[2] for r in rows]
    cuts = {}
    for r in found:
        cuts.setdefault((r["region"], r["cut"]), []).append(bytes(r["deeper"]))
    small = [c for (region, _), c in cuts.items() if region == 1]
    assert [len(c) for c in small] == [8]
    descended = [c for (region, _), c in cuts.items() if region == 2 and c[0][0:4] == (7).to_bytes(4, "big")]
    assert sorted(len(c) for c in descended) == [7, 7, 8, 8]
    assert all(len({d[: 4 * 2 * near.STEP] for d in c}) == 1 and len({d for d in c}) > 1 for c in descended)
    assert 1 < len([c for (region, _), c in cuts.items() if c[0] == equal[0]]) <= 5
    pairs = near._neighbours(table(rows, "region long, deeper binary, id long, n long")).collect()
    by_id = {r[2]: r[1] for r in rows}
    common = lambda a, b: next((i for i in range(near.SORTED) if by_id[a][4 * i : 4 * i + 4] != by_id[b][4 * i : 4 * i + 4]), near.SORTED)
    assert all(common(r["a"], r["b"]) >= 2 * near.STEP for r in pairs if r["a"] >= 100)


def test_near_duplicates_of_odd_documents(odd_documents):
    found = near.near_duplicates(odd_documents).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["kept"]) for r in found if r["doc_id"] != 4) == [
        (0, 1, 0, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (5, 2, 5, True), (5, 2, 5, True), (6, 2, 5, False), (7, 1, 7, True), (8, 1, 8, True),
    ]
    assert next(r for r in found if r["doc_id"] == 4)["n_shingles"] == len(shingle_set(odd_documents.where("doc_id = 4").first()["text"]))
    assert near.near_duplicates(odd_documents.limit(0)).count() == 0


def vector_rows(rng, n=300, dim=24):
    random = np.random.default_rng(rng.randrange(99))
    base = random.standard_normal((n // 2, dim))
    near_copies = base[: n // 4] + 0.2 * random.standard_normal((n // 4, dim))
    hub = base[0] + 0.15 * random.standard_normal((n // 4, dim))
    every = np.vstack([base, near_copies, hub, base[:3], 7 * base[:3]]).astype(np.float32)
    return [(int(i), [float(x) for x in v]) for i, v in enumerate(every)]


def test_vectors_match_brute_force(table, rng, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rows = vector_rows(rng)
    found = vectors.near_vectors(table(rows, "vec_id long, embedding array<float>")).collect()
    units = np.array([v for _, v in rows], dtype=np.float64)
    units /= np.linalg.norm(units, axis=1)[:, None]
    cosines = units @ units.T
    linked = cosines >= 0.95
    np.fill_diagonal(linked, False)
    got = {r["vec_id"]: r["n_links"] for r in found}
    truth = {i: int(linked[i].sum()) for i in range(len(rows))}
    assert len(found) == len(rows)
    assert all(got[i] <= truth[i] for i in got)
    assert sum(got.values()) >= 0.99 * sum(truth.values())
    if got == truth:
        links = [(a, b) for a, b in zip(*np.nonzero(linked))]
        assert {r["vec_id"]: r["component_id"] for r in found} == components(links, range(len(rows)))


def links_by_hand(groups):
    truth = {}
    for ids, values in groups:
        units = values / np.linalg.norm(values, axis=1)[:, None]
        linked = units @ units.T >= 0.95
        truth |= {i: int(n) - 1 for i, n in zip(ids, linked.sum(axis=1))}
    return truth


@pytest.mark.parametrize("shift", [0.0, 1.2, 20.0])
def test_vectors_of_two_lengths_and_a_shifted_mean(table, shift):
    random = np.random.default_rng(5)
    groups, rows, begin = [], [], 0
    for dim, n in ((32, 180), (20, 120)):
        base = random.standard_normal((n, dim)) + shift * np.eye(dim)[0] * np.sqrt(dim)
        noise = random.standard_normal((n, dim))
        noise *= (0.3 * np.linalg.norm(base, axis=1) / np.linalg.norm(noise, axis=1))[:, None]
        values = np.vstack([base, base + noise])
        ids = list(range(begin, begin + 2 * n))
        begin += 2 * n
        groups.append((ids, values))
        rows += [(i, [float(x) for x in v]) for i, v in zip(ids, values)]
    truth = links_by_hand(groups)
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_vectors(table(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == len(rows) and all(got[i] <= truth[i] for i in got)
    for ids, _ in groups:
        assert sum(got[i] for i in ids) >= 0.99 * sum(truth[i] for i in ids) > 0


def shifted(shift, n=1500, dim=64):
    """Unit vectors, of which ``i`` and ``n + i`` are at a cosine of 0.95 and a little more."""
    random = np.random.default_rng(11)
    base = random.standard_normal((n, dim))
    base[:, 0] += shift
    base /= np.linalg.norm(base, axis=1)[:, None]
    aside = random.standard_normal((n, dim))
    aside -= (aside * base).sum(axis=1)[:, None] * base
    aside *= (np.sqrt(1 / 0.951**2 - 1) / np.linalg.norm(aside, axis=1))[:, None]
    near = base + aside
    return np.vstack([base, near / np.linalg.norm(near, axis=1)[:, None]])


@pytest.mark.parametrize("shift, most", [(0, 0.05), (3, 0.05), (20, 0.95)])
def test_codes_meet_near_vectors_and_not_all(shift, most):
    units = shifted(shift)
    n = len(units) // 2
    way, centre, share = vectors.planned(units, len(units))
    model = vectors.fit(units, way.rotations, centre, share)
    parts = vectors._parts(vectors.codes(units, model), way.part, 64)
    met = np.zeros((2 * n, 2 * n), dtype=bool)
    for column in parts.T:
        met |= column[:, None] == column[None, :]
    assert np.diagonal(met, n).mean() >= 0.99
    assert (met.sum() - 2 * n) / (2 * n * (2 * n - 1)) <= most


@pytest.mark.parametrize("shift, least, most, power", [(0, 18, 36, 0.3), (3, 18, 36, 0.3), (20, 12, 20, 0.9)])
def test_work_of_a_vector_grows_less_than_the_table(shift, least, most, power):
    units = shifted(shift)
    costs = [vectors.planned(units, 2**e)[0].cost for e in (least, most)]
    assert costs[1] / costs[0] <= 2 ** ((most - least) * power)
    assert all(vectors.planned(units, 2**e)[0].rotations <= vectors.MOST_ROTATIONS for e in (1, 10, 36))
    plain = vectors.layout(2**36)
    assert plain.rotations * (64 // plain.part) <= 8 * 36


def test_odd_vectors(table):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, [0.0, 0.0]), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []), (7, [1.0, 2.0]), (8, [1.0, 2.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 2.0]), (10, [1e200, 2e200])]
    found = vectors.near_vectors(table([(*r, 5) for r in odd], "vec_id long, embedding array<double>, id long")).collect()
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found}
    assert all(got[i] == (0, i, True) for i in (1, 2, 3, 4, 5, 6, 9))
    assert got[8] == (2, 7, False) and got[7] == (2, 7, True) and got[10] == (2, 7, False)
    assert got[None] == (0, None, True)
    empty = table([], "vec_id long, embedding array<double>")
    assert vectors.near_vectors(empty).count() == 0
