"""Whitening against a dense eigendecomposition."""

from __future__ import annotations

import numpy as np
import pytest

from strata.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, id string, x string, v string, component int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c", 1) for i, v in rows], SCHEMA)


def run(spark, rows, components=32):
    x, size = whitening.integers(table(spark, rows))
    return whitening.whiten(x, size, whitening.fit(x, size, components)).toPandas()


def plain(rows, components=32):
    x = np.floor(64 * np.array([v for _, v in rows], np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    c = x - sums / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return (c @ vectors) / np.sqrt(values), values / (c**2).sum() * n, ((n * x - sums) ** 2).sum(axis=1)


@pytest.mark.parametrize(("size", "components"), [(48, 32), (7, 32), (90, 5)])
def test_matches_a_dense_decomposition(spark, size, components):
    rng = np.random.default_rng(size)
    data = rng.standard_normal((400, size)) * np.linspace(2, 0.4, size) + rng.standard_normal(size)
    rows = [(i, v) for i, v in enumerate(data.astype(np.float32).tolist())]
    got = run(spark, rows, components)
    k = min(size, components)
    assert len(got) == 400 * k and (got["n"] == 400).all() and got["identity_error"].max() < 1e-9
    white, explained, deviation = plain(rows, components)
    mine = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    sign = np.sign((mine * white).sum(axis=0))
    assert np.abs(mine * sign - white).max() < 1e-8
    first = got[got["vec_id"] == 0].sort_values("component")
    assert first["component"].tolist() == list(range(1, k + 1))
    assert np.allclose(first["explained"], explained, rtol=1e-10)
    assert got[got["component"] == 1].sort_values("vec_id")["deviation"].tolist() == deviation.tolist()


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 1.0]), (2, [1.0, 0.5]), (2, [1.0, 0.5]), (None, [-1.0, 0.25]), (4, None), (5, [0.0, None])]
    rows += [(6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, 2.0, 3.0]), (9, [])]
    got = run(spark, rows)
    assert sorted(got["vec_id"].fillna(0).tolist()) == [0, 0, 1, 1, 2, 2, 2, 2] and (got["n"] == 4).all()
    assert run(spark, []).empty
    assert run(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]).empty  # no direction
    assert run(spark, [(1, None)]).empty
    flat = run(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(6)])
    assert set(flat["component"]) == {1}  # the others have no spread
    assert run(spark, [(i, [float(i) * 1e30, 1.0 * i]) for i in range(3)])["deviation"].isna().all()


@pytest.mark.parametrize(("size", "k"), [(1, 1), (5, 32), (64, 32), (200, 12), (400, 6)])
def test_jacobi_davidson(size, k):
    """Also where the search space is cut back, and with repeated eigenvalues."""
    rng = np.random.default_rng(size)
    turn = np.linalg.qr(rng.standard_normal((size, size)))[0]
    values = np.sort(rng.uniform(0, 10, size))[::-1]
    if size > 3:
        values[2] = values[1]
    dense = (turn * values) @ turn.T
    dense = (dense + dense.T) / 2
    found, vectors = whitening.jacobi_davidson(lambda q: dense @ q, size, k)
    k = min(size, k)
    assert np.abs(found - values[:k]).max() < 1e-11
    assert np.abs(dense @ vectors - vectors * found).max() < 1e-11
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12


def test_minres_solves_an_indefinite_system():
    rng = np.random.default_rng(2)
    dense = np.diag([5.0, 3.0, 1.0, -2.0, -4.0])
    b = rng.standard_normal((5, 3))
    assert np.allclose(dense @ whitening._minres(lambda z: dense @ z, b, 5), b, atol=1e-9)
