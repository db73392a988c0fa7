import math

import numpy as np
import pytest

from docweft.llm import vectorpairs

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, row int"


def usable(v):
    return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v)


def brute(rows, threshold):
    """[(id, links, component, kept)] by all pairs."""
    units = [np.array(np.float32(r[1]), float) / np.linalg.norm(np.array(np.float32(r[1]), float)) if usable(r[1]) else None for r in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if units[i] is not None and units[j] is not None and rows[i][2] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        component = min(ids, default=None)
        out.append((r[0], links[i], component, component == r[0]))
    return sorted(out, key=str)


def got(spark, rows, threshold=0.93):
    found = vectorpairs.near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3), threshold)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def clustered(rng, n, dim, spread, labels=2):
    centres = rng.normal(0, 1, (max(1, n // 8), dim))
    rows = []
    for i in range(n):
        v = centres[rng.integers(len(centres))] + rng.normal(0, spread, dim)
        rows.append((int(1000 - i), [float(c) for c in v * rng.uniform(0.1, 30)], int(rng.integers(labels)), "x", 1))
    return rows


@pytest.mark.parametrize("dim,spread", [(2, 0.1), (16, 0.27), (64, 0.28)])
def test_equal_to_all_pairs(spark, monkeypatch, dim, spread):
    monkeypatch.setattr(vectorpairs, "ROOTS", 3)  # several tiles for each label
    rows = clustered(np.random.default_rng(dim), 260, dim, spread)
    want = brute(rows, 0.93)
    assert sum(w[1] for w in want) > 100
    assert got(spark, rows) == want


def test_what_links_with_nothing_and_repeats(spark):
    one, two = [1.0, 0.0, 0.5], [1.0, 0.01, 0.5]
    rows = [(1, one, 1, "a", 1), (1, one, 1, "a", 1), (2, two, 1, "b", 1), (3, two, 2, "b", 1), (4, one, None, "b", 1), (5, None, 1, "c", 1), (6, [0.0, 0.0, 0.0], 1, "c", 1)]
    rows += [(7, [float("nan"), 0.0, 0.5], 1, "c", 1), (8, [float("inf"), 0.0, 0.5], 1, "c", 1), (9, [1.0, None, 0.5], 1, "c", 1), (10, [], 1, "c", 1), (11, [1.0, 0.0], 1, "c", 1)]
    rows += [(None, one, 1, "d", 1), (None, one, 2, "d", 1), (None, [0.0, 1.0, 0.0], 3, "d", 1), (None, [0.0, 1.0, 0.0], 3, "d", 1)]
    rows += [(12, [-1.0, 0.0, -0.5], 1, "e", 1), (13, [2e38, 0.0, 1e38], 1, "e", 1), (14, [2e-40, 0.0, 1e-40], 1, "e", 1)]
    assert got(spark, rows) == brute(rows, 0.93)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_a_large_group_leaves_rows_in_proportion(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(0, 1, 32)
    rows = [(i, [float(c) for c in base + rng.normal(0, 0.02, 32)], 1, "x", 1) for i in range(400)]
    rows += [(400 + i, [float(c) for c in rng.normal(0, 1, 32)], 1, "x", 1) for i in range(200)]
    found = got(spark, rows)
    assert sum(r[1] for r in found) == 400 * 399 and sum(r[3] for r in found) == 201


def test_bounds_hold_for_every_pair():
    rng = np.random.default_rng(2)
    for dim in (1, 2, 3, 64, 1500):
        u = vectorpairs.unit(rng.standard_t(1.2, (60, dim)))
        v = vectorpairs.unit(u + rng.normal(0, 0.05, u.shape) * np.abs(u).max(axis=1, keepdims=True))
        left, right = (vectorpairs.Side(*vectorpairs.quantised(x)) for x in (u, v))
        true = u @ v.T
        for threshold in (0.5, 0.93, 0.99):
            seen = {}
            for p, q, sure in vectorpairs.bounded_pairs(left, right, threshold, own=False):
                seen.update(zip(zip(p.tolist(), q.tolist(), strict=True), sure.tolist(), strict=True))
            for i in range(60):
                for j in range(60):
                    if true[i, j] >= threshold:
                        assert (i, j) in seen
                    if seen.get((i, j)):
                        assert true[i, j] >= threshold


def test_most_pairs_are_settled_by_codes(spark):
    rng = np.random.default_rng(4)
    side = vectorpairs.Side(*vectorpairs.quantised(vectorpairs.unit(rng.normal(0, 1, (800, 64)))))
    undecided = sum(int((~sure).sum()) for _, _, sure in vectorpairs.bounded_pairs(side, side, 0.93, own=True))
    assert undecided == 0
