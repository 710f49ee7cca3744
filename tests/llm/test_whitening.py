"""Whitening: counts and eigenpairs against a dense solver, sums against Python's integers."""

import math

import numpy as np
import pytest

from folioweave.llm import queries
from folioweave.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>"


def symmetric(rng, n, values):
    q, _ = np.linalg.qr(rng.normal(size=(n, n)))
    m = q @ np.diag(values) @ q.T
    return (m + m.T) / 2


def test_inertia_against_eigenvalues():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 20, 60):
        for _ in range(8):
            values = rng.normal(size=n)
            a = symmetric(rng, n, values)
            shift = float(rng.normal() / 2)
            assert W.inertia(a - shift * np.eye(n))[:2] == (int((values > shift).sum()), int((values < shift).sum()))
    assert W.inertia(np.zeros((3, 3))) == (0, 0, 3)
    assert W.inertia(np.array([[0.0, 1], [1, 0]])) == (1, 1, 0)


@pytest.mark.parametrize("values", [
    np.arange(1, 65.0), np.geomspace(1e-6, 1e4, 64), np.ones(64), np.repeat([5.0, 3, 1], [20, 20, 24]),
    np.append(np.full(40, 1e-9), np.linspace(1, 1 + 1e-7, 24)), np.array([7.0]), np.zeros(5), np.append(np.zeros(10), [1.0, 2])])
def test_pairs_against_a_dense_solver(values):
    rng = np.random.default_rng(2)
    v = symmetric(rng, len(values), values)
    found = [W.stretch_pairs(v, *s) for s in W.fences(v, 32)]
    got = np.sort(np.concatenate([f[0] for f in found] or [np.empty(0)]))[::-1][:32]
    want = np.sort(values[values > 1e-13 * max(values.max(), 1e-300) * len(values)])[::-1][:32]
    assert len(got) == len(want) and np.allclose(got, want, rtol=0, atol=1e-13 * max(values.max(), 1) * len(values))
    for e, x in found:
        assert np.abs(x.T @ x - np.eye(len(e))).max(initial=0) < 1e-12 and np.abs(v @ x - x * e).max(initial=0) < 1e-12 * max(values.max(), 1)


def brute(vectors):
    """n, deviations, covariance by Python's integers."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    z = [[n * a - s for a, s in zip(row, sums)] for row in x]
    cov = np.array([[sum(row[i] * row[j] for row in z) / n**3 for j in range(len(sums))] for i in range(len(sums))])
    return n, [sum(c * c for c in row) for row in z], cov, np.array([[c / n for c in row] for row in z])


def collected(df):
    return {(r["vec_id"], r["component"]): r for r in df.collect()}


def test_whole_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = np.float32(rng.normal(size=(300, 40)) * np.geomspace(0.01, 3, 40) + 500)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    odd = [(900, None), (901, [None] * 40), (902, [float("nan")] + [0.0] * 39), (903, [float("inf")] + [0.0] * 39)]
    data = W.integer_rows(spark.createDataFrame(rows + odd, SCHEMA).repartition(5))
    model = W.fit(data)
    got = collected(W.whitened(data, model))
    n, deviations, cov, centred = brute([v for _, v in rows])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:32], u[:, ::-1][:, :32]
    assert len(got) == 300 * 32 and {r["n"] for r in got.values()} == {n}
    white = np.array([[got[i, c + 1]["whitened"] for c in range(32)] for i in range(300)])
    want = centred @ (u / np.sqrt(e))
    sign = np.sign((white * want).sum(axis=0))
    assert np.abs(white - want * sign).max() < 1e-9
    assert all(got[i, 1]["deviation"] == deviations[i] for i in range(300))
    assert np.allclose([got[0, c + 1]["explained"] for c in range(32)], e / np.trace(cov), rtol=1e-9)
    assert W.identity_error(data, model) < 1e-9


def test_few_rows_and_odd_shapes(spark):
    def run(rows):
        data = W.integer_rows(spark.createDataFrame(rows, SCHEMA))
        model = W.fit(data)
        return W.whitened(data, model).collect(), W.identity_error(data, model)

    assert run([]) == ([], 0.0)
    assert run([(1, [1.0, 2.0])]) == ([], 0.0)          # no spread, no component
    assert run([(1, [1.0, 2.0])] * 5) == ([], 0.0)
    assert run([(1, []), (2, [])]) == ([], 0.0)
    got, error = run([(1, [1.0, 7.0]), (1, [1.0, 7.0]), (None, [3.0, 7.0]), (4, [1.0])])  # short ones are filled up
    assert len(got) == 8 and error < 1e-12 and sum(r["vec_id"] is None for r in got) == 2
    big, _ = run([(1, [1e12, 0.0]), (2, [-1e12, 5.0]), (3, [0.0, 1.0])])
    assert all(r["deviation"] is None for r in big if r["vec_id"] != 3) and all(math.isfinite(r["whitened"]) for r in big)


def test_query(spark):
    got = queries.op12_whitening(spark, "/root/testdata/sf0.001").toPandas()
    want = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    assert len(got) == want * 32 and got["identity_error"].max() < 1e-9 and got["identity_error"].nunique() == 1
    shares = got.groupby("component")["explained"].first()
    assert list(shares) == sorted(shares, reverse=True) and shares.sum() <= 1 + 1e-9
