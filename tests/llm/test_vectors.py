"""Collision-counting projections against all pairs."""

import numpy as np
import pytest

from chatmill.llm import vectors


def brute(data, least):
    rows = []
    for i, v in data:
        ok = i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        rows.append((i, np.array(v, dtype=np.float32).astype(float) if ok else None))
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for a, (i, x) in enumerate(rows):
        for b, (j, y) in enumerate(rows[:a]):
            if x is not None and y is not None and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                links[a] += 1
                links[b] += 1
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return sorted(
        ((i, links[k], None if i is None else root(i), i is None or root(i) == i) for k, (i, _) in enumerate(rows)), key=str
    )


def made_up():
    rng = np.random.default_rng(3)
    data = []
    for c in range(60):
        base = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 6))):
            v = base + rng.normal(size=16) * rng.choice([0.005, 0.05, 0.2])
            data.append((len(data), v.astype(np.float32).tolist()))
    hub = rng.normal(size=16)
    for _ in range(40):
        data.append((len(data), (hub + rng.normal(size=16) * 0.02).astype(np.float32).tolist()))
    copy = data[5][1]
    n = len(data)
    data += [(n + k, copy) for k in range(4)] + [(n + 4, [2 * x for x in copy]), (n + 5, None), (n + 6, []), (n + 7, [0.0] * 16)]
    data += [(n + 8, [float("nan"), *copy[1:]]), (n + 9, [float("inf"), *copy[1:]]), (n + 10, [None, *copy[1:]]), (None, copy)]
    data += [(n + 11, [1.0, 2.0]), (n + 12, [1.0, 2.01]), (n + 13, copy[:15]), (7, data[7][1])]
    return data


@pytest.mark.parametrize("block", [2048, 8])
def test_near_duplicates_equal_all_pairs(spark, rows, block):
    data = made_up()
    given = rows(data, "vec_id long, embedding array<float>").selectExpr("*", "1 AS tag", "2 AS vec", "3 AS label").repartition(4)
    got = sorted((tuple(r) for r in vectors.near_duplicates(given, 0.95, 0.9999, block).collect()), key=str)
    assert got == brute(data, 0.95)


def test_calibrated_recall_at_the_limit():
    """Pairs exactly at the limit, the hardest ones, are found as often as calibrated."""
    rng = np.random.default_rng(5)
    plan = vectors.Plan.calibrated(20_000, 0.95, 0.99)
    a = rng.normal(size=(400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(400, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.9501 * a + np.sqrt(1 - 0.9501**2) * b
    (ka, za), (kb, zb) = plan.project(a), plan.project(b)
    hits = ((ka == kb) & (np.abs(za - zb) <= plan.window)).sum(axis=1)
    assert (hits >= plan.need).mean() >= 0.975


def test_planted_pairs_are_found(spark, rows):
    """2,000 pairs just above the limit and 2,000 just below among 20,000 vectors: at least 99 % and none."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(12_000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(size=(4_000, 64))
    side -= (base[:4_000] * side).sum(axis=1, keepdims=True) * base[:4_000]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = np.repeat([0.9503, 0.9497], 2_000)[:, None]
    near = cosine * base[:4_000] + np.sqrt(1 - cosine**2) * side
    data = np.concatenate([base, near, rng.normal(size=(4_000, 64))]).astype(np.float32)
    given = rows(list(enumerate(data.tolist())), "vec_id long, embedding array<float>").repartition(8)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(given).collect()}
    found = sum(got[12_000 + k] == (1, k) and got[k] == (1, k) for k in range(2_000))
    assert found >= 1_980 and sum(n for n, _ in got.values()) == 2 * found and len(got) == 20_000


@pytest.mark.parametrize("table", [1, 4])
def test_windows_of_a_sorted_cell_equal_all_pairs(table):
    rng = np.random.default_rng(9)
    plan = vectors.Plan(1, 0.8, 6, 2)
    unit = rng.normal(size=(5, 16))[rng.integers(0, 5, 300)] + rng.normal(size=(300, 16)) * 0.15
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    key, at = plan.project(unit)
    order = np.argsort(at[:, table], kind="stable")
    unit, key, at = unit[order], key[order], at[order]
    few_key, few_at = plan.project(unit, table)
    assert (few_key == key[:, :table]).all() and np.allclose(few_at, at[:, :table])
    own = rng.integers(0, 2, 300)
    for left, right in ((np.arange(300), None), (np.flatnonzero(own == 0), np.flatnonzero(own == 1))):
        right = left if right is None else right
        i, j = vectors.linked(unit, at[:, table], plan, table, left, right, 0.95)
        want = set()
        for a in left:
            for b in right:
                if a != b and abs(at[a, table] - at[b, table]) <= plan.window and unit[a] @ unit[b] >= 0.95:
                    if ((key[a] == key[b]) & (np.abs(at[a] - at[b]) <= plan.window))[:table].sum() == plan.need - 1:
                        want.add((min(a, b), max(a, b)))
        assert len(i) == len(want) > 0 and {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())} == want


def test_cells_grow_finer_with_the_table():
    small, large = vectors.Plan.calibrated(10_000, 0.95), vectors.Plan.calibrated(10_000_000, 0.95)
    assert large.cells > small.cells and large.tables > small.tables


def test_empty_table(spark, rows):
    assert vectors.near_duplicates(rows([], "vec_id long, embedding array<float>")).collect() == []
