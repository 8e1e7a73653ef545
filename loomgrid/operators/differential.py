"""Differences between groups of observations, corrected p-values, regression."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mathx import safe_divide, two_sided_p
from .windows import numbered


def group_sizes(groups: DataFrame) -> DataFrame:
    return groups.groupBy("group").agg(F.count("*").cast("double").alias("n1"))


def group_stats(x: DataFrame, groups: DataFrame) -> DataFrame:
    """For each feature and group against all others: fractions expressing, means, log2 fold change."""
    n = F.broadcast(group_sizes(groups))
    all_n = F.broadcast(groups.agg(F.count("*").cast("double").alias("n")))
    own = x.join(groups, "obs").groupBy("feature", "group").agg(F.sum("value").alias("s1"), F.count_if(F.col("value") > 0).alias("k1"))
    every = x.select("feature").distinct().join(n)
    total = own.groupBy("feature").agg(F.sum("s1").alias("s"), F.sum("k1").alias("k"))
    j = every.join(own, ["feature", "group"], "left").join(total, "feature").join(all_n).na.fill(0, ["s1", "k1"])
    m1, m2 = F.col("s1") / F.col("n1"), safe_divide(F.col("s") - F.col("s1"), F.col("n") - F.col("n1"), 0.0)
    return j.select("feature", "group", (F.col("k1") / F.col("n1")).alias("fraction"), safe_divide(F.col("k") - F.col("k1"), F.col("n") - F.col("n1"), 0.0).alias("other_fraction"), m1.alias("mean"), m2.alias("other_mean"), F.log2((m1 + 1e-9) / (m2 + 1e-9) + 1e-4).alias("log2fc"))


def mann_whitney(x: DataFrame, groups: DataFrame) -> DataFrame:
    """feature, group, u, z, p of each group against all others, ties and absent zeros included.

    Values are counted per (feature, value) first; a window over these counts, not over rows, gives average ranks. The
    zeros are one block of ties below all positive values, so they never become rows. Values must not be negative.
    """
    n_g, all_n = group_sizes(groups), groups.agg(F.count("*").cast("double").alias("n"))
    cells = x.filter("value > 0").join(groups, "obs").groupBy("feature", "group", "value").agg(F.count("*").cast("double").alias("c1"))
    steps = cells.groupBy("feature", "value").agg(F.sum("c1").alias("c"))
    w = Window.partitionBy("feature").orderBy("value")
    steps = steps.join(F.broadcast(all_n)).withColumn("pos", F.sum("c").over(Window.partitionBy("feature"))).withColumn("below", F.sum("c").over(w) - F.col("c")).withColumn("rank", F.col("n") - F.col("pos") + F.col("below") + (F.col("c") + 1) / 2)
    ties = steps.groupBy("feature").agg(F.sum(F.col("c") ** 3 - F.col("c")).alias("t"), F.first("pos").alias("pos"))
    own = cells.join(steps.select("feature", "value", "rank"), ["feature", "value"]).groupBy("feature", "group").agg(F.sum(F.col("c1") * F.col("rank")).alias("r"), F.sum("c1").alias("k1"))
    j = ties.join(F.broadcast(n_g)).join(own, ["feature", "group"], "left").join(F.broadcast(all_n)).na.fill(0.0, ["r", "k1"])
    zeros = F.col("n") - F.col("pos")
    rank_sum = F.col("r") + (F.col("n1") - F.col("k1")) * (zeros + 1) / 2
    n1, n2, n = F.col("n1"), F.col("n") - F.col("n1"), F.col("n")
    u = rank_sum - n1 * (n1 + 1) / 2
    tie = F.col("t") + zeros**3 - zeros
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - tie / F.when(n > 1, n * (n - 1))))
    mid = n1 * n2 / 2
    z = F.when(sd > 0, F.signum(u - mid) * F.greatest(F.abs(u - mid) - 0.5, F.lit(0.0)) / sd).otherwise(0.0)
    return j.select("feature", "group", u.alias("u"), F.coalesce(z, F.lit(0.0)).alias("z")).withColumn("p", two_sided_p(F.col("z")))


def benjamini_hochberg(df: DataFrame, p: str = "p", by: list[str] | None = None, key: list[str] | None = None, out: str = "q") -> DataFrame:
    """q-values; null or NaN p-values get none and don't count. Without ``by``, ``key`` must tell rows of equal p apart."""
    ok = F.col(p).isNotNull() & ~F.isnan(p)
    if not by:
        return _global_q(df, p, ok, key or [], out)
    g = [*[F.col(c) for c in by or []], ok]
    order = [F.col(p), *[F.col(c) for c in key or []]]
    part = Window.partitionBy(*g)
    raw = F.col(p) * F.count("*").over(part) / F.row_number().over(part.orderBy(*order))
    ranked = df.withColumn("raw_", raw)
    back = part.orderBy(*[c.desc() for c in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn(out, F.when(ok, F.least(F.min("raw_").over(back), F.lit(1.0)))).drop("raw_")


def _global_q(df: DataFrame, p: str, ok: Column, key: list[str], out: str) -> DataFrame:
    """Over all rows: numbered in parts; a part needs the least later value of the parts behind it only."""
    rows = numbered(df.filter(ok), [p, *key], "n_").join(F.broadcast(df.agg(F.count_if(ok).alias("m_"))))
    rows = rows.withColumn("raw_", F.col(p) * F.col("m_") / F.col("n_"))
    behind = Window.orderBy(F.desc("part_")).rowsBetween(Window.unboundedPreceding, -1)
    least = rows.groupBy("part_").agg(F.min("raw_").alias("l_")).select("part_", F.min("l_").over(behind).alias("later_"))
    back = Window.partitionBy("part_").orderBy(F.desc("n_"))
    q = F.least(F.min("raw_").over(back), F.col("later_"), F.lit(1.0))
    rest = df.filter(~F.coalesce(ok, F.lit(False))).withColumn(out, F.lit(None).cast("double"))
    return rows.join(least, "part_").withColumn(out, q).select(*rest.columns).unionByName(rest)


def bonferroni_holm(df: DataFrame, p: str = "p", key: list[str] | None = None, out: str = "q") -> DataFrame:
    """Holm's step-down with Sidak's correction; key must tell rows of equal p apart."""
    rows = numbered(df, [p, *(key or [])], "n_").join(F.broadcast(df.agg(F.count("*").alias("m_"))))
    rows = rows.withColumn("raw_", 1 - F.pow(1 - F.col(p), F.col("m_") - F.col("n_") + 1))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    most = rows.groupBy("part_").agg(F.max("raw_").alias("l_")).select("part_", F.max("l_").over(before).alias("earlier_"))
    up = Window.partitionBy("part_").orderBy("n_")
    q = F.least(F.greatest(F.max("raw_").over(up), F.col("earlier_")), F.lit(1.0))
    return rows.join(most, "part_").withColumn(out, q).select(*df.columns, out)


def markers(x: DataFrame, groups: DataFrame, top: int | None = None) -> DataFrame:
    """Marker features of every group in one plan: fractions, fold change, specificity, test, q over the group's features."""
    j = group_stats(x, groups).join(mann_whitney(x, groups), ["feature", "group"])
    q = benjamini_hochberg(j, "p", ["group"], ["feature"])
    w = Window.partitionBy("feature")
    share = safe_divide(F.col("fraction"), F.sum("fraction").over(w), 0.0)
    q = q.withColumn("specificity", share)
    return q if top is None else top_n(q, "log2fc", top)


def top_n(stats: DataFrame, by: str, n: int, group: str = "group", key: str = "feature") -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc(by), key)
    return stats.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def nearby_groups(edges: DataFrame, groups: DataFrame, test_group, ratio: float = 0.5) -> DataFrame:
    """Groups more than a ratio of whose members are neighbours of the test group."""
    near = edges.join(groups.filter(F.col("group") == F.lit(test_group)).select(F.col("obs").alias("src")), "src", "left_semi").select(F.col("dst").alias("obs")).distinct()
    c = groups.join(near, "obs").groupBy("group").agg(F.count("*").alias("c")).join(F.broadcast(group_sizes(groups)), "group")
    return c.filter((F.col("group") != F.lit(test_group)) & (F.col("c") / F.col("n1") > ratio)).select("group", (F.col("c") / F.col("n1")).alias("ratio"))


def variance_parts(x: DataFrame, types: DataFrame) -> DataFrame:
    """feature, within, between, total sums of squares over the observations' types, absent values being 0."""
    n = F.broadcast(types.groupBy("type").agg(F.count("*").cast("double").alias("n")))
    all_n = F.broadcast(types.agg(F.count("*").cast("double").alias("all_n")))
    s = x.join(types, "obs").groupBy("feature", "type").agg(F.sum("value").alias("s"), F.sum(F.col("value") ** 2).alias("q")).join(n, "type").join(all_n)
    parts = s.groupBy("feature", "all_n").agg(F.sum("s").alias("ts"), F.sum("q").alias("tq"), F.sum(F.col("s") ** 2 / F.col("n")).alias("b"))
    return parts.select("feature", (F.col("tq") - F.col("b")).alias("within"), (F.col("b") - F.col("ts") ** 2 / F.col("all_n")).alias("between"), (F.col("tq") - F.col("ts") ** 2 / F.col("all_n")).alias("total"))


def moments(df: DataFrame, xs: list[str], y: str, weight: str | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """X'WX, X'Wy, y'Wy in one pass; the result's size is the number of columns squared."""
    w = F.col(weight) if weight else F.lit(1.0)
    cols = [*xs, y]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = df.agg(*[F.sum(w * F.col(cols[i]) * F.col(cols[j])).alias(f"m{i}_{j}") for i, j in pairs]).first()
    m = np.zeros((len(cols), len(cols)))
    for i, j in pairs:
        m[i, j] = m[j, i] = row[f"m{i}_{j}"] or 0.0
    return m[:-1, :-1], m[:-1, -1], float(m[-1, -1])


def least_squares(df: DataFrame, xs: list[str], y: str, ridge: float = 0.0, clip: float | None = None, weight: str | None = None) -> np.ndarray:
    """(Weighted, ridge) least squares from sums; an intercept is a column of ones."""
    a, b, _ = moments(df, xs, y, weight)
    beta = np.linalg.pinv(a + ridge * np.eye(len(xs))) @ b
    return beta if clip is None else np.clip(beta, -clip, clip)


def variance_inflation(df: DataFrame, xs: list[str], limit: float = 5.0) -> list[str]:
    """Predictors left after dropping the one of the largest inflation while it is above the limit."""
    kept = list(xs)
    one = df.withColumn("one_", F.lit(1.0))
    a, _, _ = moments(one, [*xs, "one_"], "one_")
    n = a[-1, -1]
    cov = a[:-1, :-1] / n - np.outer(a[-1, :-1], a[-1, :-1]) / n**2
    while len(kept) > 1:
        at = [xs.index(c) for c in kept]
        sd = np.sqrt(np.maximum(np.diag(cov)[at], 1e-300))
        vif = np.diag(np.linalg.inv(cov[np.ix_(at, at)] / np.outer(sd, sd) + 1e-9 * np.eye(len(at))))
        worst = int(vif.argmax())
        if vif[worst] <= limit:
            break
        kept.pop(worst)
    return kept


def iwls(x: np.ndarray, y: np.ndarray, family: str = "gaussian", weights: np.ndarray | None = None, ridge: float = 0.0, clip: float | None = None, steps: int = 200, tol: float = 1e-8) -> np.ndarray:
    """Iteratively reweighted least squares for one group in memory: gaussian, poisson, nb (dispersion 1) or binomial."""
    w0 = np.ones(len(y)) if weights is None else weights
    beta = np.zeros(x.shape[1])
    if family == "gaussian":
        beta = np.linalg.pinv((x * w0[:, None]).T @ x + ridge * np.eye(x.shape[1])) @ (x.T @ (w0 * y))
        return beta if clip is None else np.clip(beta, -clip, clip)
    eta = np.log(np.maximum(y, 0.1)) if family != "binomial" else np.log((y + 0.5) / (1.5 - y))
    for _ in range(steps):
        mu = np.exp(np.clip(eta, -30, 30)) if family != "binomial" else 1 / (1 + np.exp(-np.clip(eta, -30, 30)))
        if family == "binomial":
            w, z = mu * (1 - mu), eta + (y - mu) / np.maximum(mu * (1 - mu), 1e-10)
        else:
            w, z = (mu if family == "poisson" else mu / (1 + mu)), eta + (y - mu) / np.maximum(mu, 1e-10)
        ww = w * w0
        new = np.linalg.pinv((x * ww[:, None]).T @ x + ridge * np.eye(x.shape[1])) @ (x.T @ (ww * z))
        new = new if clip is None else np.clip(new, -clip, clip)
        done = np.abs(new - beta).max() < tol
        beta, eta = new, x @ new
        if done:
            break
    return beta


def local_regression(edges: DataFrame, samples: DataFrame, xs: list[str], y: str, family: str = "gaussian", w: str = "w") -> DataFrame:
    """(src, betas, fitted): for each location a regression weighted by the kernel over its neighbours.

    A gaussian fit needs only weighted sums, which are aggregated map-side; other families gather a location's neighbours,
    whose number the kernel bounds.
    """
    cols = ["one_", *xs]
    s = samples.withColumn("one_", F.lit(1.0)).select(F.col("obs").alias("dst"), *[F.col(c).cast("double").alias(c) for c in [*cols, y]])
    joined = edges.select("src", "dst", F.col(w).alias("w_")).join(s, "dst")
    own = samples.select(F.col("obs").alias("src"), F.array(F.lit(1.0), *[F.col(c).cast("double") for c in xs]).alias("own_"))
    k = len(cols)
    if family == "gaussian":
        sums = joined.groupBy("src").agg(
            F.array(*[F.sum(F.col("w_") * F.col(cols[i]) * F.col(cols[j])) for i in range(k) for j in range(k)]).alias("a"), F.array(*[F.sum(F.col("w_") * F.col(c) * F.col(y)) for c in cols]).alias("b")
        ).join(own, "src")

        def solve(batches):
            for p in batches:
                a = np.array(p["a"].tolist(), dtype=float).reshape(len(p), k, k)
                b = np.array(p["b"].tolist(), dtype=float).reshape(len(p), k)
                beta = np.einsum("nij,nj->ni", np.linalg.pinv(a), b)
                yield pd.DataFrame({"src": p["src"], "betas": list(beta), "fitted": (beta * np.array(p["own_"].tolist(), dtype=float)).sum(axis=1)})

        return sums.mapInPandas(solve, f"src {samples.schema['obs'].dataType.simpleString()}, betas array<double>, fitted double")

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        beta = iwls(p[cols].to_numpy(float), p[y].to_numpy(float), family, p["w_"].to_numpy(float))
        eta = float(beta @ np.array(p["own_"].iloc[0], float))
        return pd.DataFrame({"src": [p["src"].iloc[0]], "betas": [beta], "fitted": [1 / (1 + np.exp(-eta)) if family == "binomial" else np.exp(eta)]})

    return joined.join(own, "src").groupBy("src").applyInPandas(fit, f"src {samples.schema['obs'].dataType.simpleString()}, betas array<double>, fitted double")


def corrected_aic(rss: float, trace: float, n: int) -> float:
    return n * np.log(rss / n) + n * np.log(2 * np.pi) + n * (n + trace) / (n - 2.0 - trace)


def likelihood_ratio(x: DataFrame, covariate: DataFrame, family: str = "poisson") -> DataFrame:
    """feature, lr, p of counts on one covariate (obs, t) against the constant model; absent counts are 0.

    A feature's rows are its stored counts and one row for its zeros at each distinct covariate value, so a group's size is
    bounded by the stored rows and the number of covariate values.
    """
    n_t = covariate.groupBy("t").agg(F.count("*").alias("n"))
    stored = x.join(covariate, "obs").groupBy("feature", "t", "value").agg(F.count("*").alias("c"))
    have = stored.groupBy("feature", "t").agg(F.sum("c").alias("h"))
    zeros = x.select("feature").distinct().join(n_t).join(have, ["feature", "t"], "left").select("feature", "t", F.lit(0.0).alias("value"), (F.col("n") - F.coalesce("h", F.lit(0))).alias("c")).filter("c > 0")

    def test(p: pd.DataFrame) -> pd.DataFrame:
        c, y, t = (p[k].to_numpy(float) for k in ("c", "value", "t"))
        full = np.column_stack([np.ones(len(y)), (t - t.mean()) / (t.std() or 1.0)])
        ll = []
        for m in (full, full[:, :1]):
            mu = np.exp(np.clip(m @ iwls(m, y, family, c), -30, 30))
            ll.append(float((c * (y * np.log(mu) - (mu if family == "poisson" else (y + 1) * np.log1p(mu)))).sum()))
        lr = max(0.0, 2 * (ll[0] - ll[1]))
        import math

        return pd.DataFrame({"feature": [p["feature"].iloc[0]], "lr": [lr], "p": [math.erfc(math.sqrt(lr / 2))]})

    return stored.unionByName(zeros).groupBy("feature").applyInPandas(test, f"feature {x.schema['feature'].dataType.simpleString()}, lr double, p double")
