import math

import numpy as np
import pytest

from estimara.llm import whitening


def plain(vectors, k=8):
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors], np.int64)
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
    deviation = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x]
    return n, deviation, centred @ turn / np.sqrt(values), values / (centred**2).sum() * n


@pytest.mark.parametrize("d", [3, 40])
def test_against_numpy(spark, d):
    random = np.random.default_rng(d)
    vectors = (random.standard_normal((300, d)) * np.linspace(2, 0.5, d) + random.standard_normal(d)).astype(np.float32)
    bad = [(1000, None), (1001, [None] + [0.0] * (d - 1)), (1002, [float("nan")] * d), (1003, [float("inf")] + [1.0] * (d - 1)), (1004, [1.0] * (d + 1)), (1005, []), (1006, [1e30] * d)]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(vectors)] + bad
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, embedding array<float>, n int, WHITENED string").repartition(5)
    got = sorted(whitening.whiten(df).collect(), key=lambda r: (r["vec_id"], r["component"]))
    k = min(8, d)
    n, deviation, whitened, shares = plain(vectors)
    assert len(got) == n * k and {r["n"] for r in got} == {n}
    assert [r["deviation"] for r in got[::k]] == deviation
    own = np.array([r["whitened"] for r in got]).reshape(n, k)
    sign = np.sign((own * whitened).sum(axis=0))
    assert np.abs(own * sign - whitened).max() < 1e-9
    assert [r["explained"] for r in got[:k]] == pytest.approx(list(shares), rel=1e-9)
    assert {r["component"] for r in got} == set(range(1, k + 1)) and got[0]["identity_error"] < 1e-9


def test_close_eigenvalues_are_certified():
    random = np.random.default_rng(1)
    turn = np.linalg.qr(random.standard_normal((200, 200)))[0]
    values = np.concatenate([[5.0, 5.0, 1.02, 1.01, 1.01, 1.005, 1.001, 1.0005], np.linspace(1, 0.9, 192)])
    v = turn * values @ turn.T
    passes = []
    found, vectors, residual = whitening.leading(lambda q: passes.append(1) or v @ q, 200, 8)
    assert np.abs(found - values[:8]).max() < 1e-12 and residual < 1e-12 and len(passes) < 600
    assert np.linalg.norm(v @ vectors - vectors * found) < 1e-11
    assert whitening.lower_bound(lambda q: v @ q, 200, 12) <= 0.9 + 1e-12


def test_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], schema)).collect() == []
    line = whitening.whiten(spark.createDataFrame([(i if i else None, [float(i), 2.0]) for i in range(5)] * 2, schema)).collect()
    assert len(line) == 10 and {r["component"] for r in line} == {1} and line[0]["explained"] == pytest.approx(1)
    assert sorted(round(abs(r["whitened"]), 6) for r in line) == pytest.approx([0, 0] + [0.707107] * 4 + [1.414214] * 4, abs=1e-5)


def test_deviations_beyond_64_bits():
    x = np.array([[0, 1], [1 << 31, 1]], np.int64)
    fitted = whitening.Whitening(2, x.sum(axis=0), np.zeros((2, 0)), np.zeros(0), 0.0, 0, 0.0)
    assert fitted.deviations(x) == [1 << 62, 1 << 62]
    x[1, 0] = 1 << 33
    fitted = whitening.Whitening(2, x.sum(axis=0), np.zeros((2, 0)), np.zeros(0), 0.0, 0, 0.0)
    assert fitted.deviations(x) == [None, None]
