"""Fit measures, tests and local fits against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrid.operators import regress


def test_losses_and_thresholds(spark):
    y, p = [1, 0, 1, 1, 0], [0.9, 0.2, 0.4, 1.0, 0.7]
    df = spark.createDataFrame(list(zip(y, p)), "y int, p double")
    e = regress.errors(df, "y", "p").first()
    assert (e["mae"], e["mse"]) == pytest.approx((np.mean(np.abs(np.array(y) - p)), np.mean((np.array(y) - p) ** 2)))
    q = np.clip(p, 1e-7, 1 - 1e-7)
    want = -np.mean([(2 if a else 3) * a * math.log(b) + (1 - a) * math.log(1 - b) for a, b in zip(y, q)])
    assert regress.weighted_cross_entropy(df, "y", "p", 3, 2).first()["loss"] == pytest.approx(want)
    got = {r["threshold"]: r["objective"] for r in regress.threshold_objective(df, "y", "p", [0.0, 0.5, 2.0]).collect()}
    assert got == pytest.approx({0.0: -1.0, 0.5: -(2 / 3 + 1 / 2), 2.0: -1.0})
    assert regress.threshold_objective(df.filter("y = 1"), "y", "p", [0.5]).first()["objective"] == pytest.approx(-2 / 3)


def test_wald_intervals_and_fisher(spark):
    df = spark.createDataFrame([(1.0, 0.5, 0.6, 30), (0.0, 0.0, 0.0, 3), (2.0, 0.0, -0.3, 50)], "b double, s double, r double, n int")
    lo, hi = regress.correlation_interval(F.col("r"), F.col("n"))
    got = df.select(regress.wald(F.col("b"), F.col("s")).alias("p"), lo.alias("lo"), hi.alias("hi")).collect()
    assert [r["p"] for r in got] == pytest.approx([math.erfc(2 / math.sqrt(2)), 1.0, 0.0], abs=1e-6)
    z = math.atanh(0.6)
    assert (got[0]["lo"], got[0]["hi"]) == pytest.approx((math.tanh(z - 1.96 / math.sqrt(27)), math.tanh(z + 1.96 / math.sqrt(27))), abs=1e-4) and got[1]["lo"] is None
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 2))
    v = x[:, 0] * 2 + rng.normal(size=40)
    d = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, v)], "a double, b double, y double")
    assert regress.fisher_inverse(d, ["a", "b"], "y") == pytest.approx(np.linalg.inv(x.T @ x / v.var()))
    assert regress.corrected_aic_likelihood(-10.0, 2.0, 20) == pytest.approx(20 + 4 + 12 / 17) and regress.corrected_aic_likelihood(-1.0, 5.0, 6) == math.inf


def test_chi_square_tail():
    for df, x, want in ((1, 3.841459, 0.05), (2, 5.991465, 0.05), (3, 7.814728, 0.05), (4, 9.487729, 0.05), (7, 14.06714, 0.05), (3, 0.0, 1.0), (0, 5.0, 1.0)):
        assert regress.chi_square_tail(x, df) == pytest.approx(want, abs=1e-6)


def test_models_of_several_covariates(spark):
    rng = np.random.default_rng(4)
    n = 120
    a, b = rng.integers(0, 3, n), rng.integers(0, 2, n)
    y = rng.poisson(np.exp(0.3 + 0.8 * a))
    flat = rng.poisson(2.0, n)
    rows = [(i, f, float(v)) for f, vs in ((1, y), (2, flat)) for i, v in enumerate(vs.tolist()) if v]
    x = spark.createDataFrame(rows, "obs long, feature long, value double")
    cov = spark.createDataFrame([(i, int(a[i]), int(b[i])) for i in range(n)], "obs long, a int, b int")
    got = {r["feature"]: r for r in regress.model_comparison(x, cov, ["a", "b"], family="poisson").collect()}
    assert got[1]["p"] < 1e-10 and got[1]["df"] == 2 and got[2]["p"] > 1e-3
    # against a fit over every observation
    m = np.column_stack([np.ones(n), a, b]).astype(float)
    ll = []
    for d in (m, m[:, :1]):
        beta = np.zeros(d.shape[1])
        beta[0] = math.log(y.mean())
        for _ in range(50):
            mu = np.exp(d @ beta)
            beta = beta + np.linalg.solve((d * mu[:, None]).T @ d, d.T @ (y - mu))
        mu = np.exp(d @ beta)
        ll.append((y * np.log(mu) - mu).sum())
    assert got[1]["lr"] == pytest.approx(2 * (ll[0] - ll[1]), rel=1e-5)
    some = {r["feature"]: r for r in regress.model_comparison(x, cov, ["a", "b"], ["a"], family="poisson").collect()}
    assert some[1]["df"] == 1 and some[1]["lr"] < got[1]["lr"]
    with pytest.raises(ValueError):
        regress.model_comparison(x, cov, ["a"], ["b"])


def test_local_fits_and_their_bandwidth(spark):
    rng = np.random.default_rng(2)
    n = 60
    at, z = rng.uniform(0, 10, (n, 2)), rng.normal(size=n)
    y = 1 + z * (1 + 0.3 * at[:, 0]) + 0.05 * rng.normal(size=n)
    points = spark.createDataFrame([(i, float(p), float(q)) for i, (p, q) in enumerate(at)], "id long, x double, y double")
    samples = spark.createDataFrame([(i, float(z[i]), float(y[i])) for i in range(n)], "obs long, z double, v double")
    got = {r["src"]: r for r in regress.local_fits(points, samples, ["z"], "v", 4.0).collect()}
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(axis=2))
    x = np.column_stack([np.ones(n), z])
    for i in range(n):
        w = np.where(d[i] <= 4.0, (1 - (d[i] / 4.0) ** 2) ** 2, 0.0)
        inv = np.linalg.pinv((x * w[:, None]).T @ x)
        assert got[i]["residual"] == pytest.approx(y[i] - x[i] @ inv @ (x.T @ (w * y)), abs=1e-6) and got[i]["hat"] == pytest.approx(x[i] @ inv @ x[i], abs=1e-6)
    best = regress.best_bandwidth(points, samples, ["z"], "v", 2.0, 12.0, 1.5)
    ends = [regress.local_aicc(points, samples, ["z"], "v", b) for b in (best, 2.0, 12.0)]
    assert ends[0] <= min(ends[1:]) + 1e-6
