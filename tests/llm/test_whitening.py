import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm.whitening import Whitening, fit_whitening, identity_error, leading_eigenvalues, op11, principal_axes, sturm_count, tridiagonal, whiten


def spectrum(values, seed=0):
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    v = (q * np.array(values)) @ q.T
    return (v + v.T) / 2


@pytest.mark.parametrize(
    "values",
    [[9, 7, 5, 3, 1, 0.5], [5, 5, 5, 1, 1, 0], [4, 4 - 1e-9, 4 - 2e-9, 2, 1, 1], [1e9, 1e3, 1, 1e-3, 0, 0], [0] * 6, [3, 3, 3, 3, 3, 3], [2] + [1] * 40],
)
def test_axes_of_a_spectrum(values):
    v = spectrum(values)
    for k in (1, 4, len(values)):
        got, axes = principal_axes(v, k)
        top = max(values) or 1.0
        assert np.allclose(got, sorted(values, reverse=True)[:k], atol=1e-13 * top * len(values), rtol=0)
        assert np.allclose(axes.T @ axes, np.eye(k), atol=1e-11)
        assert np.abs(v @ axes - axes * got).max() <= 1e-12 * top * len(values)


def test_steps():
    v = spectrum([6, 5, 4, 3, 2, 1], 3)
    diagonal, off, q = tridiagonal(v)
    t = np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1)
    assert np.allclose(q @ t @ q.T, v) and np.allclose(q.T @ q, np.eye(6))
    assert sturm_count(diagonal, off, np.array([0.5, 2.5, 7.0])).tolist() == [0, 2, 6]
    assert np.allclose(leading_eigenvalues(diagonal, off, 2), [6, 5])
    assert np.allclose(principal_axes(np.array([[4.0]]), 8)[0], [4.0])
    assert np.allclose(principal_axes(np.diag([1.0, 3.0]), 8)[0], [3.0, 1.0])


def check(rows, got, k):
    x = np.floor(1024 * np.array([r[1] for r in rows], dtype=float)).astype(int) + 100_000
    n, sums = len(x), [int(s) for s in x.sum(axis=0)]
    v = np.cov(x.T, bias=True)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    want = (x - x.mean(axis=0)) @ axes / np.sqrt(values)
    mine = np.array([r.whitened for r in got])
    signs = np.sign((mine * want).sum(axis=0))
    assert np.allclose(mine * signs, want, atol=1e-8)
    assert [r.deviation for r in got] == [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]


def test_whitening_matches_numpy(spark):
    rng = np.random.default_rng(5)
    mixed = rng.standard_normal((300, 12)) @ rng.standard_normal((12, 12))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(mixed)] + [(3, [float(c) for c in mixed[3]])] * 40
    odd = [(900, None), (901, [1.0] * 11 + [None]), (902, [math.inf] + [0.0] * 11), (903, [math.nan] * 12), (904, []), (905, [1.0, 2.0]), (906, [1e30] * 12)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("WHITENED", F.lit(1)).withColumn("n", F.lit("x")).repartition(5)
    fit = fit_whitening(df, k=8)
    got = sorted(whiten(df, fit).collect(), key=lambda r: r.vec_id)
    rows.sort(key=lambda r: r[0])
    assert [r.vec_id for r in got] == [r[0] for r in rows] and got[0].n == "x"
    check(rows, got, 8)
    assert identity_error(whiten(df, fit), 8) < 1e-9
    assert abs(fit.explained.sum() - fit.values.sum() / np.trace(np.cov((np.floor(1024 * np.array([r[1] for r in rows]))).T, bias=True))) < 1e-12


def test_tables_without_variance_or_rows(spark):
    alike = spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25]), (None, [0.5, 0.25])], "vec_id long, embedding array<float>")
    fit = fit_whitening(alike)
    assert [r.whitened for r in whiten(alike, fit).collect()] == [[0.0, 0.0]] * 3 and identity_error(whiten(alike, fit), 2) == 0.0
    assert fit_whitening(alike.limit(0)) is None and whiten(alike.limit(0), None).count() == 0
    lone = fit_whitening(alike.limit(1))
    assert lone.n == 1 and whiten(alike.limit(1), lone).first().deviation == 0


def test_large_deviations_are_exact_or_null():
    fit = Whitening(3, [0, 0], np.ones(2), np.eye(2), np.ones(2))
    assert fit.deviations(np.array([[1 << 29, 1], [1 << 30, 1 << 30], [1 << 31, 0]])) == [9 * (1 << 58) + 9, None, None]


def test_query(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.standard_normal((200, 10)))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op11(spark, str(tmp_path)).collect()
    assert len(got) == 1600 and {r.component for r in got} == set(range(1, 9)) and {r.n for r in got} == {200} and got[0].identity_error < 1e-9
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    assert op11(spark, str(tmp_path)).count() == 0
