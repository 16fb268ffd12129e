"""Whitening against eigenvectors of the whole covariance, with passes that must iterate."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.llm import whitening as wh

KIND = "vec_id long, embedding array<double>"


def direct(vectors, k, scale=64, offset=1_000_000):
    """Whitened values up to sign, shares and squared deviations, by one dense eigenproblem."""
    x = np.floor(np.array(vectors) * scale).astype(np.int64) + offset
    n, s = len(x), x.sum(axis=0)
    far = n * x - s
    z = far / n
    e, u = np.linalg.eigh(z.T @ z / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return z @ u / np.sqrt(e), e / np.trace(z.T @ z / n), [sum(int(v) ** 2 for v in row) for row in far]


def table(got, n, k):
    rows = sorted(map(tuple, got.collect()))
    assert len(rows) == n * k
    return rows, np.array([r[4] for r in rows]).reshape(n, k)


@pytest.mark.parametrize(("dim", "k", "n"), [(24, 8, 400), (100, 6, 300)])
def test_equals_dense_eigenvectors(spark, dim, k, n):
    rng = np.random.default_rng(dim)
    data = rng.standard_normal((n, dim)) * np.linspace(3, 0.2, dim) + rng.standard_normal(dim) * 5
    got = wh.whitened(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], KIND), k=k)
    want, shares, deviations = direct(data, k)
    rows, values = table(got, n, k)
    assert np.abs(np.abs(values) - np.abs(want)).max() < 1e-6
    assert np.allclose([r[5] for r in rows[:k]], shares, rtol=1e-9)
    assert [rows[i * k][3] for i in range(n)] == deviations
    assert {r[2] for r in rows} == {n} and len({r[6] for r in rows}) == 1 and rows[0][6] < 1e-9
    assert [r[1] for r in rows[:k]] == list(range(1, k + 1))


def test_iterates_until_residuals_are_certain(spark):
    rng = np.random.default_rng(2)
    data = rng.standard_normal((500, 60)) * np.geomspace(8, 0.05, 60)
    rows = wh.materialise(wh.whole_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], KIND), 64, 1_000_000), "x")
    whole = wh.Centred(rows, 500, 60)
    e, u, trace, passes = wh.principal(whole, 4)
    y, _ = whole.times(u)
    assert 1 < passes < 60 and np.linalg.norm(y - u * e, axis=0).max() <= 2e-12 * e[0]
    assert np.allclose(e / trace, direct(data, 4)[1], rtol=1e-10)
    with pytest.raises(RuntimeError, match="residuals"):
        wh.principal(whole, 4, max_passes=1)


def test_odd_vectors(spark):
    rng = np.random.default_rng(4)
    data = rng.standard_normal((40, 3)).tolist()
    data[5] = data[6]
    odd = [None, [], [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [float("-inf"), 1.0, 1.0], [1e300, 1.0, 1.0]]
    rows = [(i, v) for i, v in enumerate(data)] + [(100 + i, v) for i, v in enumerate(odd)] + [(5, data[5])] * 3 + [(None, data[0])]
    pairs = [(200 + i, v) for i, v in enumerate(rng.standard_normal((10, 2)).tolist())]
    clash = {c: F.lit("clash") for c in ("x", "dim", "n", "component", "whitened")}
    got = wh.whitened(spark.createDataFrame(rows + pairs, KIND).withColumns(clash))
    three = [tuple(r) for r in got.collect() if r["n"] == 44]
    want, _, _ = direct(data + [data[5]] * 3 + [data[0]], 3)
    assert len(three) == 44 * 3 and got.where("n = 10").count() == 20 and got.where("vec_id IS NULL").count() == 3
    by_key = {(r[0], r[1]): abs(r[4]) for r in three if r[0] is not None}
    assert np.allclose([by_key[i, c + 1] for i in range(40) for c in range(3)], np.abs(want[:40]).ravel(), atol=1e-7)


def test_too_few_and_constant(spark):
    frame = lambda rows: spark.createDataFrame(rows, KIND)
    assert wh.whitened(frame([])).count() == 0
    assert wh.whitened(frame([(1, [1.0, 2.0])])).count() == 0
    assert wh.whitened(frame([(i, [1.5, -2.0]) for i in range(9)])).count() == 0
    two = wh.whitened(frame([(1, [1.0, 2.0, 3.0]), (2, [2.0, 2.0, 1.0])])).collect()
    assert len(two) == 2 and sorted(round(r["whitened"], 9) for r in two) == [-1.0, 1.0] and two[0]["explained"] == pytest.approx(1)


def test_deviation_beyond_a_long(spark):
    rows = [(i, [4e9 if i == 3 else 1.0, float(i)]) for i in range(30)]
    got = {r["vec_id"]: r["deviation"] for r in wh.whitened(spark.createDataFrame(rows, KIND)).where("component = 1").collect()}
    want = direct([v for _, v in rows], 1)[2]
    assert got == {i: d if d < 2**63 else None for i, d in enumerate(want)} and None in got.values()
