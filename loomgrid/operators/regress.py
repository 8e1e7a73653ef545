"""Fit measures, tests of coefficients, generalised linear models on several covariates, and the bandwidth of local fits."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.mathx import kernel, safe_divide, two_sided_p
from ..functions.session import checkpointed
from .differential import corrected_aic, iwls, moments
from .graph import within
from .iterate import golden_section


def errors(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: mean absolute and mean squared error."""
    d = F.col(truth) - F.col(predicted)
    return df.agg(F.avg(F.abs(d)).alias("mae"), F.avg(d * d).alias("mse"))


def weighted_cross_entropy(df: DataFrame, truth: str, predicted: str, weight_0: float = 1.0, weight_1: float = 1.0) -> DataFrame:
    """One row: the mean loss of probabilities, kept 1e-7 off 0 and 1. The class weight stands on the positive term, as it does in the model fitted with it."""
    p = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), F.col(predicted)))
    y = F.col(truth).cast("double")
    w = y * weight_1 + (1 - y) * weight_0
    return df.agg((-F.avg(w * y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("loss"))


def threshold_objective(df: DataFrame, truth: str, predicted: str, thresholds: list[float], weight_0: float = 1.0, weight_1: float = 1.0) -> DataFrame:
    """threshold, objective: minus the weighted sum of recall and specificity, all thresholds in one pass."""
    rows = df.select(F.col(truth).alias("y"), F.col(predicted).alias("p"), F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold"))
    hit = F.col("p") >= F.col("threshold")
    recall = safe_divide(F.count_if(hit & (F.col("y") == 1)), F.count_if(F.col("y") == 1), 0.0)
    specificity = safe_divide(F.count_if(~hit & (F.col("y") == 0)), F.count_if(F.col("y") == 0), 0.0)
    return rows.groupBy("threshold").agg((-(recall * weight_1 + specificity * weight_0)).alias("objective"))


def wald(estimate: Column, deviation: Column, against: float = 0.0) -> Column:
    """Two-sided p of an estimate; one without deviation is certain: 0, or 1 if it equals what it is held against."""
    d = F.abs(estimate - against)
    return F.when(deviation > 0, two_sided_p(F.try_divide(d, deviation))).otherwise(F.when(d > 0, 0.0).otherwise(1.0))


def correlation_interval(r: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of a correlation of n pairs by Fisher's transformation; null for fewer than 4 pairs."""
    t, se = F.atanh(r), F.when(n > 3, 1 / F.sqrt(F.when(n > 3, n - 3)))
    return F.tanh(t - z * se), F.tanh(t + z * se)


def fisher_inverse(df: DataFrame, xs: list[str], y: str) -> np.ndarray:
    """Inverse of X'X over the variance of y, from sums; its size is the number of predictors squared."""
    a, _, _ = moments(df, xs, y)
    var = df.agg(F.var_pop(y)).first()[0] or 0.0
    return np.linalg.pinv(a / var) if var > 0 else np.zeros((len(xs), len(xs)))


def corrected_aic_likelihood(log_likelihood: float, trace: float, n: int) -> float:
    """Corrected AIC of a generalised linear fit; infinite where the sample is too small for its trace."""
    return -2 * log_likelihood + 2 * trace + 2 * trace * (trace + 1) / (n - trace - 1) if n - trace - 1 > 0 else math.inf


def _log_likelihood(y: np.ndarray, mu: np.ndarray, c: np.ndarray, family: str) -> float:
    if family == "poisson":
        return float((c * (y * np.log(mu) - mu)).sum())
    if family == "nb":
        return float((c * (y * np.log(mu) - (y + 1) * np.log1p(mu))).sum())
    if family == "binomial":
        return float((c * (y * np.log(mu) + (1 - y) * np.log1p(-mu))).sum())
    n, rss = c.sum(), float((c * (y - mu) ** 2).sum())
    return -0.5 * n * math.log(max(rss / n, 1e-300))


def model_comparison(x: DataFrame, covariates: DataFrame, full: list[str], reduced: list[str] | None = None, family: str = "nb") -> DataFrame:
    """feature, lr, df, p of a full against a reduced generalised linear model of counts; absent counts are 0.

    covariates: (obs, columns). An intercept is always there; reduced is a part of full, none by default. A feature's rows are
    its stored counts and one row of zeros for each distinct combination of covariates, so continuous covariates make as
    many rows as observations; each feature is fitted by one task.
    """
    reduced = reduced or []
    if set(reduced) - set(full):
        raise ValueError("the reduced model must be part of the full one")
    t = F.array(*[F.col(c).cast("double") for c in full])
    own = covariates.select("obs", t.alias("t"))
    n_t = own.groupBy("t").agg(F.count("*").alias("n"))
    stored = x.join(own, "obs").groupBy("feature", "t", "value").agg(F.count("*").alias("c"))
    have = stored.groupBy("feature", "t").agg(F.sum("c").alias("h"))
    zeros = x.select("feature").distinct().join(n_t).join(have, ["feature", "t"], "left").select("feature", "t", F.lit(0.0).alias("value"), (F.col("n") - F.coalesce("h", F.lit(0))).alias("c")).filter("c > 0")

    def test(p: pd.DataFrame) -> pd.DataFrame:
        c, y = p["c"].to_numpy(float), p["value"].to_numpy(float)
        v = np.array(p["t"].tolist(), float).reshape(len(y), len(full))
        mean = (c[:, None] * v).sum(axis=0) / c.sum()
        sd = np.sqrt((c[:, None] * (v - mean) ** 2).sum(axis=0) / c.sum())
        v = (v - mean) / np.where(sd > 0, sd, 1.0)
        ll, rank = [], []
        for names in (full, reduced):
            m = np.column_stack([np.ones(len(y)), v[:, [full.index(k) for k in names]]])
            eta = m @ iwls(m, y, family, c)
            mu = eta if family == "gaussian" else 1 / (1 + np.exp(-np.clip(eta, -30, 30))) if family == "binomial" else np.exp(np.clip(eta, -30, 30))
            ll.append(_log_likelihood(y, mu, c, family))
            rank.append(int(np.linalg.matrix_rank(m)))
        lr, df = max(0.0, 2 * (ll[0] - ll[1])), rank[0] - rank[1]
        return pd.DataFrame({"feature": [p["feature"].iloc[0]], "lr": [lr], "df": [df], "p": [chi_square_tail(lr, df)]})

    return stored.unionByName(zeros).groupBy("feature").applyInPandas(test, f"feature {x.schema['feature'].dataType.simpleString()}, lr double, df int, p double")


def chi_square_tail(x: float, df: int) -> float:
    """Upper tail of a chi-square with whole degrees of freedom: erfc or exp, then the recurrence over two degrees."""
    if df <= 0:
        return 1.0
    if x <= 0:
        return 1.0
    h = x / 2
    if df % 2:
        out, term, k = math.erfc(math.sqrt(h)), math.sqrt(h) * math.exp(-h) / math.gamma(1.5), 1
    else:
        out, term, k = math.exp(-h), h * math.exp(-h), 2
    while k < df:
        out += term
        k += 2
        term *= h / (k / 2)
    return min(1.0, out)


def local_fits(points: DataFrame, samples: DataFrame, xs: list[str], y: str, bandwidth: float, axes=("x", "y")) -> DataFrame:
    """(src, residual, hat): at each location a gaussian fit weighted by a bisquare kernel over the places within the bandwidth.

    Samples in one place have one fit and are summed before places meet, so only weighted sums of sums are aggregated; hat
    is the weight that a sample has in its own fit.
    """
    axes, cols = list(axes), ["one_", *xs]
    k = len(cols)
    s = samples.withColumn("one_", F.lit(1.0)).select(F.col("obs").alias("id"), *[F.col(c).cast("double").alias(f"v{i}_") for i, c in enumerate([*cols, y])])
    have = checkpointed(points.select("id", *axes).join(s, "id"))
    half = [(i, j) for i in range(k) for j in range(i, k + 1)]  # the column after the last is y
    sums = [f"m{i}_{j}_" for i, j in half]
    at = checkpointed(have.groupBy(*axes).agg(F.min("id").alias("place"), *[F.sum(F.col(f"v{i}_") * F.col(f"v{j}_")).alias(m) for (i, j), m in zip(half, sums, strict=True)]))
    near = within(at.select("place", *axes), bandwidth, axes, "place", at, sums).withColumn("w", kernel("bisquare", F.col("dist"), F.lit(float(bandwidth)))).filter("w > 0 OR src = dst")
    fits = near.groupBy("src").agg(*[F.sum(F.col("w") * F.col(m)).alias(m) for m in sums])

    def solve(batches):
        for p in batches:
            full = {ij: p[m].to_numpy(float) for ij, m in zip(half, sums, strict=True)}
            a = np.stack([full[min(i, j), max(i, j)] for i in range(k) for j in range(k)], axis=1).reshape(len(p), k, k)
            b = np.stack([full[i, k] for i in range(k)], axis=1)
            inverse = np.linalg.pinv(a, hermitian=True)
            beta = np.einsum("nij,nj->ni", inverse, b)
            yield pd.DataFrame({"place": p["src"], "beta": list(beta), "inverse": list(inverse.reshape(len(p), k * k))})

    kind = points.schema["id"].dataType.simpleString()
    solved = fits.mapInPandas(solve, f"place {kind}, beta array<double>, inverse array<double>").join(at.select("place", *axes), "place").drop("place")
    fitted = sum((F.col("beta")[i] * F.col(f"v{i}_") for i in range(1, k)), F.col("beta")[0] * F.col("v0_"))
    hat = sum((F.col(f"v{i}_") * F.col("inverse")[i * k + j] * F.col(f"v{j}_") for i in range(k) for j in range(k)), F.lit(0.0))
    return have.join(solved, axes).select(F.col("id").alias("src"), (F.col(f"v{k}_") - fitted).alias("residual"), hat.alias("hat"))


def local_aicc(points: DataFrame, samples: DataFrame, xs: list[str], y: str, bandwidth: float, axes=("x", "y")) -> float:
    """Corrected AIC of the local fits of one bandwidth; infinite where they have no degrees of freedom left."""
    r = local_fits(points, samples, xs, y, bandwidth, axes).agg(F.sum(F.col("residual") ** 2).alias("rss"), F.sum("hat").alias("trace"), F.count("*").alias("n")).first()
    if not r["n"] or r["n"] - 2.0 - r["trace"] <= 0:
        return math.inf
    return float(corrected_aic(max(r["rss"], 1e-300), r["trace"], r["n"]))


def best_bandwidth(points: DataFrame, samples: DataFrame, xs: list[str], y: str, low: float, high: float, tolerance: float = 0.05, axes=("x", "y")) -> float:
    """The bandwidth of least corrected AIC by golden section; each evaluation is one job, none is made twice."""
    known: dict[float, float] = {}

    def at(bandwidth: float) -> float:
        key = round(bandwidth, 6)
        if key not in known:
            known[key] = min(local_aicc(points, samples, xs, y, key, axes), 1e300)
        return known[key]

    return golden_section(at, low, high, tolerance)
