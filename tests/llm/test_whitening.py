import math
from fractions import Fraction

import numpy as np
import pytest

from hirelens.llm import whitening
from hirelens.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute(vectors):
    """Fit list, S, covariance in exact fractions."""
    fit = sorted({tuple(math.floor(64 * c) + 1_000_000 for c in v) for v in vectors})
    n, d = len(fit), len(fit[0])
    s = [sum(x[i] for x in fit) for i in range(d)]
    y = np.array([[n * x[i] - s[i] for i in range(d)] for x in fit], object)
    v = [[Fraction(int(t), n ** 3) for t in row] for row in y.T @ y]
    return fit, n, s, v


def check(rows, vectors):
    fit, n, s, v = brute([c for _, c in vectors])
    cov = np.array([[float(t) for t in r] for r in v])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    trace = float(sum(v[i][i] for i in range(len(s))))
    by_id = {}
    for r in rows:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    assert set(by_id) == {i for i, _ in vectors}
    sign = {}
    for i, c in vectors:
        x = [math.floor(64 * t) + 1_000_000 for t in c]
        for k, r in by_id[i].items():
            assert r.n == n and r.deviation == sum((n * a - b) ** 2 for a, b in zip(x, s))
            want = float(sum((a - Fraction(b, n)) * Fraction(float(u[j, k - 1])) for j, (a, b) in enumerate(zip(x, s)))) / math.sqrt(e[k - 1])
            if abs(want) > 1e-3:
                sign.setdefault(k, math.copysign(1, want * r.whitened))
            assert r.whitened * sign.get(k, 1) == pytest.approx(want, rel=1e-7, abs=1e-7)
            assert r.explained == pytest.approx(e[k - 1] / trace, rel=1e-6) and r.identity_error < 1e-6
    return by_id


def test_whole_table_against_fractions(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    by_id = check(QUERIES["op13_whitening"](spark, SF).collect(), vectors)
    assert all(sorted(c) == list(range(1, 17)) for c in by_id.values())


def test_scatter_is_exact_at_any_width():
    rng = np.random.default_rng(1)
    for high in (1, 2, 1000, 1 << 20, 1 << 50):
        x = rng.integers(-high, high, (130, 5))
        total, cross = whitening.scatter(x)
        y = x.astype(object)
        assert total.tolist() == y.sum(axis=0).tolist()
        want = y.T @ y
        assert all(cross[i, j] == want[i, j] for i in range(5) for j in range(i, 5))


def test_unfit_repeated_and_clashing_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, -0.25, 3.0]), (2, [0.1, 0.0, -1.0]), (3, [0.5, -0.25, 3.0]), (None, [9.0, 2.0, 0.0]), (5, [-0.0, 1e5, 0.3]), (5, [-0.0, 1e5, 0.3])]
    bad = [(6, None), (7, [nan, 0.0, 0.0]), (8, [0.0, inf, 0.0]), (9, [0.0, None, 0.0]), (10, []), (11, [1.0, 2.0])]
    rows = [(i, v, 7, "x") for i, v in good + bad]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, x string").withColumnRenamed("x", "component")
    got = whitening.whiten(df).collect()
    assert len(got) == len(good) * 3
    check(got, good)


def test_nothing_to_whiten(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        got = whitening.whiten(spark.createDataFrame(rows, schema))
        assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.count() == 0


def test_constant_dimensions_have_no_component(spark):
    df = spark.createDataFrame([(i, [float(i % 3), 4.0, float(i // 3)]) for i in range(9)], "vec_id long, embedding array<float>")
    assert {r.component for r in whitening.whiten(df).collect()} == {1, 2}
