import math

import numpy as np
import pytest

from docweft.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, component string"


def brute(rows):
    """(ids, whole numbers) of the vectors that take part."""
    good = [(i, v) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    return [i for i, _ in good], [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in good]


def checked(spark, rows, dim, most=32, tile=whitening.TILE):
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA).repartition(3), most=most, tile=tile).toPandas()
    ids, x = brute(rows)
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    centred = np.array([[float((n * c - s) / n) for c, s in zip(r, sums, strict=True)] for r in x])
    cov = centred.T @ centred / n
    e = np.linalg.eigvalsh(cov)[::-1]
    k = min(most, int((e > 1e-12 * e[0]).sum()))
    assert len(got) == n * k and set(got.n) == {n}
    deviation = sorted(sum((n * c - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x)
    assert sorted(got[got.component == 1].deviation) == deviation
    assert np.allclose(got.groupby("component").explained.first(), e[:k] / np.trace(cov), rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    # whitened covariance by another way, and each component an eigenvector up to its sign
    w = np.stack([got[got.component == c].sort_values(["vec_id", "whitened"]).whitened for c in range(1, k + 1)], axis=1) if len(set(ids)) == n else None
    if w is not None:
        order = np.argsort(ids)
        assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-9
        back = np.linalg.lstsq(centred[order], w * np.sqrt(e[:k]), rcond=None)[0]
        assert np.abs(cov @ back - back * e[:k]).max() < 1e-6 * e[0]
    return got


@pytest.mark.parametrize("dim,tile", [(5, 16), (16, 4), (18, 4), (40, 16)])
def test_whitening_equals_a_plain_computation(spark, dim, tile):
    rng = np.random.default_rng(dim)
    rows = [(i, [float(c) for c in rng.normal(0, 0.3, dim) * (1 + np.arange(dim))], 1, 7, "x") for i in range(150)]
    checked(spark, rows, dim, tile=tile)


def test_rows_without_a_usable_vector_are_dropped(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(0, 1, 6)], None, None, None) for i in range(40)]
    bad = [(100, None, 1, 1, "a"), (101, [float("nan")] * 6, 1, 1, "a"), (102, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1, 1, "a"), (103, [float("inf")] + [0.0] * 5, 1, 1, "a")]
    got = checked(spark, rows + bad, 6)
    assert set(got.vec_id) == set(range(40))
    # vectors of another length than the most frequent
    odd = whitening.whitened(spark.createDataFrame(rows + [(200, [1.0], 1, 1, "a"), (201, [], 1, 1, "a")], SCHEMA)).toPandas()
    assert set(odd.vec_id) == set(range(40))


def test_repeated_rows_null_ids_and_lost_dimensions(spark):
    rng = np.random.default_rng(5)
    base = [[float(c) for c in rng.normal(0, 1, 4)] for _ in range(30)]
    # the fifth dimension repeats the first: one component less
    rows = [(i % 9 if i % 4 else None, [*v, v[0]], 1, 1, "a") for i, v in enumerate(base * 3)]
    got = checked(spark, rows, 5)
    assert got.component.max() == 4 and got.vec_id.isna().sum() > 0


def test_without_spread_there_is_no_component(spark):
    for rows in ([], [(1, [0.5, 0.5], 1, 1, "a")], [(i, [0.5, 0.25], 1, 1, "a") for i in range(9)], [(1, None, 1, 1, "a")]):
        got = whitening.whitened(spark.createDataFrame(rows, SCHEMA))
        assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.count() == 0


def test_deviations_beyond_64_bits_are_null(spark):
    rows = [(1, [3e10], 1, 1, "a"), (2, [-3e10], 1, 1, "a"), (3, [0.0], 1, 1, "a")]
    got = {r.vec_id: r.deviation for r in whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1] is None and got[2] is None
    x = [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in (3e10, -3e10, 0.0)]
    assert got[3] == (3 * x[2] - sum(x)) ** 2


def test_most_limits_components(spark):
    rng = np.random.default_rng(8)
    checked(spark, [(i, [float(c) for c in rng.normal(0, 1, 12)], 1, 1, "a") for i in range(60)], 12, most=3)
