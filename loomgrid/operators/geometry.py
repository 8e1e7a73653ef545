"""Coordinates: hulls, rigid and affine maps, point clouds, triangle meshes, vector-field calculus."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def points_props(points: DataFrame, label: str = "label", x: str = "x", y: str = "y") -> DataFrame:
    """Per label: count, half-open box, convex hull area and centre. Only hull candidates reach Python.

    Of each label and x, only the lowest and highest point can be on the hull; the aggregation before the shuffle keeps
    these two.
    """
    ends = points.groupBy(F.col(label).alias("label"), F.col(x).cast("double").alias("x")).agg(F.min(F.col(y).cast("double")).alias("lo"), F.max(F.col(y).cast("double")).alias("hi"), F.count("*").alias("n"))

    def hull(p: pd.DataFrame) -> pd.DataFrame:
        pts = sorted({(a, b) for c in ("lo", "hi") for a, b in zip(p["x"], p[c], strict=True)})
        ring = convex_hull(pts)
        area, cx, cy = polygon_moments(ring)
        return pd.DataFrame({"label": [p["label"].iloc[0]], "n": [int(p["n"].sum())], "area": [area], "min_x": [p["x"].min()], "max_x": [p["x"].max() + 1], "min_y": [p["lo"].min()], "max_y": [p["hi"].max() + 1], "centre_x": [cx], "centre_y": [cy], "hull": [[list(q) for q in ring]]})

    kind = points.schema[label].dataType.simpleString()
    return ends.groupBy("label").applyInPandas(hull, f"label {kind}, n long, area double, min_x double, max_x double, min_y double, max_y double, centre_x double, centre_y double, hull array<array<double>>")


def convex_hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Counter-clockwise hull of sorted distinct points."""
    if len(points) < 3:
        return list(points)

    def half(seq):
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(points[::-1])


def polygon_moments(ring: list[tuple[float, float]]) -> tuple[float, float, float]:
    """Area and centroid; of a point or line, its mean."""
    n = len(ring)
    cross = [(ring[i][0] * ring[(i + 1) % n][1] - ring[(i + 1) % n][0] * ring[i][1]) for i in range(n)]
    area = sum(cross) / 2
    if abs(area) < 1e-12:
        return 0.0, sum(p[0] for p in ring) / n, sum(p[1] for p in ring) / n
    cx = sum((ring[i][0] + ring[(i + 1) % n][0]) * cross[i] for i in range(n)) / (6 * area)
    cy = sum((ring[i][1] + ring[(i + 1) % n][1]) * cross[i] for i in range(n)) / (6 * area)
    return abs(area), cx, cy


def inside_polygon(x: Column, y: Column, ring) -> Column:
    """Even-odd rule against a literal polygon."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if y1 != y2:
            spans = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            crossings = crossings + spans.cast("int")
    return crossings % 2 == 1


def inside_convex(x: Column, y: Column, ring) -> Column:
    """On or within a counter-clockwise convex polygon: one half plane for each edge."""
    out = F.lit(True)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        out = out & ((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) >= 0)
    return out


def moments_of(pairs: DataFrame, a: list[str], b: list[str], w: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """Weighted means, cross-covariance sums and the source's spread: one row reaches the driver."""
    wt = F.col(w) if w else F.lit(1.0)
    aggs = [F.sum(wt).alias("w"), *[F.sum(wt * F.col(c)).alias(f"s_{i}") for i, c in enumerate([*a, *b])]]
    aggs += [F.sum(wt * F.col(p) * F.col(q)).alias(f"c_{i}_{j}") for i, p in enumerate(a) for j, q in enumerate(b)]
    aggs += [F.sum(wt * F.col(p) * F.col(p)).alias(f"q_{i}") for i, p in enumerate(a)]
    r = pairs.agg(*aggs).first()
    n, d = r["w"], len(a)
    ma, mb = np.array([r[f"s_{i}"] for i in range(d)]) / n, np.array([r[f"s_{i + d}"] for i in range(d)]) / n
    cov = np.array([[r[f"c_{i}_{j}"] for j in range(d)] for i in range(d)]) - n * np.outer(ma, mb)
    return ma, mb, cov, sum(r[f"q_{i}"] for i in range(d)) - n * float(ma @ ma), n


def kabsch(pairs: DataFrame, a: list[str], b: list[str], w: str | None = None, scale: bool = False, reflect: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """Rotation, translation and scale that take points a nearest to points b."""
    ma, mb, cov, spread, _ = moments_of(pairs, a, b, w)
    u, s, vt = np.linalg.svd(cov)
    sign = np.ones(len(a))
    if not reflect and np.linalg.det(vt.T @ u.T) < 0:
        sign[-1] = -1
    r = vt.T @ np.diag(sign) @ u.T
    k = float((s * sign).sum() / spread) if scale and spread > 0 else 1.0
    return r, mb - k * r @ ma, k


def affine(df: DataFrame, axes: list[str], matrix, shift, names: list[str] | None = None) -> DataFrame:
    """A x + b as one projection."""
    out = [sum((F.lit(float(matrix[i][j])) * F.col(c) for j, c in enumerate(axes)), F.lit(float(shift[i]))).alias((names or axes)[i]) for i in range(len(axes))]
    drop = set(names or axes)
    return df.select(*[c for c in df.columns if c not in drop], *out)


def rotation(degrees: float) -> list[list[float]]:
    t = math.radians(degrees)
    return [[math.cos(t), -math.sin(t)], [math.sin(t), math.cos(t)]]


def euler(angles) -> np.ndarray:
    """Rotation about x, then y, then z, in degrees."""
    out = np.eye(3)
    for k, t in enumerate(map(math.radians, angles)):
        i, j = [(1, 2), (2, 0), (0, 1)][k]
        m = np.eye(3)
        m[i, i] = m[j, j] = math.cos(t)
        m[i, j], m[j, i] = -math.sin(t), math.sin(t)
        out = m @ out
    return out


def about(df: DataFrame, axes: list[str], matrix, centre=None) -> DataFrame:
    """A linear map about a centre, by default the mean."""
    c = np.array(centre if centre is not None else list(df.agg(*[F.avg(a) for a in axes]).first()), float)
    m = np.array(matrix, float)
    return affine(df, axes, m, c - m @ c)


def pca_align(points: DataFrame, axes: list[str]) -> DataFrame:
    """Centred points rotated onto their principal axes; each axis' largest loading is positive."""
    means, _, cov, _, _ = moments_of(points, axes, axes)
    values, vectors = np.linalg.eigh(cov)
    m = vectors[:, np.argsort(-values)].T
    m = m * np.sign(m[np.arange(len(m)), np.abs(m).argmax(axis=1)])[:, None]
    return affine(points, axes, m, -m @ means)


def normalized(points: DataFrame, axes: list[str], by: list[str] | None = None) -> DataFrame:
    """Coordinates less their mean over the root mean square radius, for each slice or all together."""
    w = Window.partitionBy(*(by or []))
    out = points
    for a in axes:
        out = out.withColumn(a, F.col(a) - F.avg(a).over(w))
    r = F.sqrt(F.avg(sum((F.col(a) ** 2 for a in axes), F.lit(0.0))).over(w))
    out = out.withColumn("r_", r)
    for a in axes:
        out = out.withColumn(a, F.col(a) / F.when(F.col("r_") > 0, F.col("r_")).otherwise(1.0))
    return out.drop("r_")


def voxelize(points: DataFrame, axes: list[str], size: float, values: list[str] | None = None) -> DataFrame:
    """Occupied voxels with their count and mean values."""
    return points.groupBy(*[F.floor(F.col(a) / size).cast("long").alias(f"v{a}") for a in axes]).agg(F.count("*").alias("n"), *[F.avg(v).alias(v) for v in values or []])


def mesh_measures(triangles: DataFrame) -> DataFrame:
    """Surface area and enclosed volume of triangles (ax, ay, az, bx, ..., cz)."""
    c = {k: F.col(k) for k in (f"{p}{a}" for p in "abc" for a in "xyz")}
    u, v = ({a: c[f"{p}{a}"] - c[f"a{a}"] for a in "xyz"} for p in "bc")
    n = (u["y"] * v["z"] - u["z"] * v["y"], u["z"] * v["x"] - u["x"] * v["z"], u["x"] * v["y"] - u["y"] * v["x"])
    area = F.sqrt(n[0] ** 2 + n[1] ** 2 + n[2] ** 2) / 2
    vol = (c["ax"] * (c["by"] * c["cz"] - c["bz"] * c["cy"]) - c["ay"] * (c["bx"] * c["cz"] - c["bz"] * c["cx"]) + c["az"] * (c["bx"] * c["cy"] - c["by"] * c["cx"])) / 6
    return triangles.agg(F.sum(area).alias("area"), F.abs(F.sum(vol)).alias("volume"))


def divergence(j: list[list[Column]]) -> Column:
    return sum((j[i][i] for i in range(1, len(j))), j[0][0])


def curl(j: list[list[Column]]) -> Column | list[Column]:
    """A scalar in the plane, three components in space, from the Jacobian's columns."""
    return j[1][0] - j[0][1] if len(j) == 2 else [j[2][1] - j[1][2], j[0][2] - j[2][0], j[1][0] - j[0][1]]


def acceleration(v: list[Column], j: list[list[Column]]) -> list[Column]:
    return [sum((j[i][k] * v[k] for k in range(1, len(v))), j[i][0] * v[0]) for i in range(len(v))]


def norm(v: list[Column]) -> Column:
    return F.sqrt(sum((x * x for x in v[1:]), v[0] * v[0]))


def curvature(v: list[Column], j: list[list[Column]]) -> Column:
    """Norm of (a (v.v) - v (v.a)) / |v|^4."""
    a = acceleration(v, j)
    vv, va = sum((x * x for x in v[1:]), v[0] * v[0]), sum((x * y for x, y in zip(v[1:], a[1:], strict=True)), v[0] * a[0])
    return norm([x * vv - y * va for x, y in zip(a, v, strict=True)]) / F.when(vv > 0, vv * vv)


def torsion(v: list[Column], j: list[list[Column]]) -> Column:
    """(v x a) . (J a) over |v x a|^2, in space."""
    a = acceleration(v, j)
    b = acceleration(a, j)
    n = [v[1] * a[2] - v[2] * a[1], v[2] * a[0] - v[0] * a[2], v[0] * a[1] - v[1] * a[0]]
    nn = n[0] ** 2 + n[1] ** 2 + n[2] ** 2
    return (n[0] * b[0] + n[1] * b[1] + n[2] * b[2]) / F.when(nn > 0, nn)


def best_matches(pi: DataFrame) -> DataFrame:
    """The most probable partner of each a in (a, b, p); ties go to the smaller b."""
    return pi.groupBy("a").agg(F.min_by(F.struct("b", "p"), F.struct(-F.col("p"), "b")).alias("m")).select("a", "m.b", "m.p")


def assignment(pairs: DataFrame, outlier: float = 0.0) -> DataFrame:
    """E-step: (a, b, weight) normalised over all a of each b, with an outlier term."""
    s = F.sum("weight").over(Window.partitionBy("b"))
    return pairs.select("a", "b", (F.col("weight") / (s + F.lit(outlier))).alias("p"))


def shepard(sources: DataFrame, near: DataFrame, power: float = 2.0) -> DataFrame:
    """Inverse-distance means of (dst's value) for each src of (src, dst, dist); a distance of 0 gives the value itself."""
    j = near.join(sources.select(F.col("id").alias("dst"), "value"), "dst")
    exact = F.avg(F.when(F.col("dist") == 0, F.col("value")))
    w = 1 / F.pow(F.when(F.col("dist") > 0, F.col("dist")), power)
    return j.groupBy("src").agg(F.coalesce(exact, F.sum(w * F.col("value")) / F.sum(w)).alias("value"))
