"""Whitening against numpy's eigen solver, the qd solver against its singular values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from cueweave.llm import whitening as wh

DATA = "/root/testdata/sf0.001"
RNG = np.random.default_rng(1)


def _turned(values):
    n = len(values)
    a, b = (np.linalg.qr(RNG.normal(size=(n, n)))[0] for _ in "ab")
    return a @ np.diag(values) @ b


MATRICES = {
    "plain": RNG.normal(size=(64, 64)), "triangular": np.triu(RNG.normal(size=(40, 40))), "few rows": RNG.normal(size=(5, 20)), "tall": RNG.normal(size=(50, 7)),
    "diagonal": np.diag([3.0, 2, 2, 1, 0, 0]), "graded": _turned(np.logspace(0, -7, 30)), "repeated": _turned(np.repeat([5, 4, 3, 2.0], 8)),
    "nearly equal": _turned(1 + 1e-9 * RNG.normal(size=30)), "one": np.array([[3.0]]), "two": RNG.normal(size=(2, 2)), "equal columns": np.ones((6, 4)),
}


@pytest.mark.parametrize("name", MATRICES)
def test_solver(name):
    a = MATRICES[name]
    values, vectors, total = wh.singular(a, 99)
    expected = np.linalg.svd(a, compute_uv=False)
    expected = expected[expected > 1e-9 * expected[0]]
    assert len(values) == len(expected) and np.allclose(np.sqrt(values), expected, rtol=1e-8)
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-11)
    assert np.allclose(a.T @ (a @ vectors), vectors * values, atol=1e-12 * values[0] * len(a))
    assert np.isclose(total, (a**2).sum())


def test_dqds_keeps_small_values():
    """High relative accuracy on a graded bidiagonal, where squaring a matrix loses the small values."""
    d, u = np.logspace(0, -12, 20), 0.3 * np.logspace(-1, -13, 19)
    exact = np.linalg.svd(np.diag(d) + np.diag(u, 1), compute_uv=False)
    assert np.allclose(np.sqrt(wh.dqds(d**2, u**2)), exact, rtol=1e-9)


def whiten_loop(rows, most=32):
    x = np.array([[int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v] for _, v in rows], object)
    n, s = len(x), x.sum(axis=0)
    deviation = ((x * n - s) ** 2).sum(axis=1)
    centred = np.array(x - np.array([int(v) for v in s], object) / n, float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    keep = [k for k in np.argsort(-values)[:most] if values[k] > 1e-12 * max(values.max(), 1e-300)]
    return n, deviation, centred @ vectors[:, keep] / np.sqrt(values[keep]), values[keep] / values.sum()


def compared(rows, found, tolerance=1e-7):
    n, deviation, white, explained = whiten_loop(rows)
    got = {}
    for r in found:
        got.setdefault(r.vec_id, {})[r.component] = r
    assert set(got) == {i for i, _ in rows}
    for k in range(white.shape[1]):
        mine = np.array([got[i][k + 1].whitened for i, _ in rows])
        sign = np.sign(mine @ white[:, k])
        assert np.allclose(sign * mine, white[:, k], atol=tolerance)
    for at, (i, _) in enumerate(rows):
        assert sorted(got[i]) == list(range(1, white.shape[1] + 1))
        for r in got[i].values():
            assert r.n == n and r.deviation == deviation[at] and r.identity_error < 1e-4 and np.isclose(r.explained, explained[r.component - 1], rtol=1e-6)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit("x")).withColumn("component", F.lit("y")).repartition(5)


def test_whiten(spark):
    rows = [(k, [float(v) for v in RNG.normal(size=6) * [3, 2.5, 2, 1.5, 1, 0.5]]) for k in range(300)]
    bad = [(1000, None), (1001, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1002, [float("nan")] * 6), (1003, [float("inf")] * 6), (1004, []), (1005, [1.0, 2.0])]
    compared(rows, wh.whiten(table(spark, rows + bad)).collect())


def test_constant_and_equal_dimensions(spark):
    rows = [(k, [1.5, a := float(RNG.normal() * 4), a, float(RNG.normal()) * 2]) for k in range(80)]
    found = wh.whiten(table(spark, rows)).collect()
    compared(rows, found)
    assert max(r.component for r in found) == 2


def test_few_and_none(spark):
    assert wh.whiten(table(spark, [])).count() == 0
    assert wh.whiten(table(spark, [(1, [1.0, 2.0])])).count() == 0
    same = [(1, [1.0, 2.0])] * 3 + [(None, [2.0, 3.0])]
    assert wh.whiten(table(spark, same)).count() == 4
    huge = wh.whiten(table(spark, [(1, [1e300, 0.0]), (2, [0.0, 0.0]), (3, [5.0, 1.0])])).collect()
    # The small direction is below the rank's share of the large one.
    assert len(huge) == 3 and all(r.deviation is None or r.deviation >= 0 for r in huge)


def test_fold(spark, monkeypatch):
    """Factors and moments of many tasks meet a few at a time."""
    monkeypatch.setattr(wh, "FOLD", 2)
    rows = [(k, [float(v) for v in RNG.normal(size=5) * [3, 2.5, 2, 1.5, 1]]) for k in range(200)]
    compared(rows, wh.whiten(table(spark, rows)).collect())


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    compared(rows, queries()["op13_whitening"](spark, DATA).collect())
