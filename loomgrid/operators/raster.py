"""Rasters as sparse pixel tables (x, y, v): a neighbourhood is a join on shifted coordinates with a few offsets."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def disk(k: int) -> list[tuple[int, int]]:
    """Offsets of a k-wide circle (k odd)."""
    r = k // 2
    return [(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1) if a * a + b * b <= r * r + (r if r > 1 else 0)]


def square(k: int) -> list[tuple[int, int]]:
    r = k // 2
    return [(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1)]


def spread(px: DataFrame, offsets, value: str = "v", weights=None) -> DataFrame:
    """Sum of (weighted) values that reach each place: each pixel is sent to its neighbours and summed, map-side first."""
    ws = weights or [1.0] * len(offsets)
    moves = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(float(w)).alias("w")) for (a, b), w in zip(offsets, ws, strict=True)]))
    return px.select("x", "y", F.col(value).alias("v_"), moves.alias("m")).groupBy((F.col("x") - F.col("m.a")).alias("x"), (F.col("y") - F.col("m.b")).alias("y")).agg(F.sum(F.col("v_") * F.col("m.w")).alias(value), F.count("*").alias("reached"))


def mirrored(px: DataFrame, width: int, height: int, r: int) -> DataFrame:
    """The raster with a border of r pixels, mirrored with the edge repeated."""
    def along(df: DataFrame, c: str, n: int) -> DataFrame:
        own = F.array(F.col(c), F.when(F.col(c) < r, -1 - F.col(c)), F.when(F.col(c) >= n - r, 2 * n - 1 - F.col(c)))
        return df.withColumn(c, F.explode(F.filter(own, lambda e: e.isNotNull())))

    return along(along(px, "x", width), "y", height)


def convolve(px: DataFrame, width: int, height: int, k: int, shape: str = "square") -> DataFrame:
    """Sums over a square or circle, or a gaussian mean, with mirrored borders; every pixel must have a row."""
    r = k // 2
    offsets = disk(k) if shape == "circle" else square(k)
    weights = None
    if shape == "gauss":
        s = 0.3 * ((k - 1) * 0.5 - 1) + 0.8
        g = [math.exp(-(a * a + b * b) / (2 * s * s)) for a, b in offsets]
        weights = [x / sum(g) for x in g]
    out = spread(mirrored(px.select("x", "y", "v"), width, height, r), offsets, "v", weights)
    return out.filter(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)).select("x", "y", "v")


def dilate(mask: DataFrame, offsets) -> DataFrame:
    """Places within reach of a mask (x, y)."""
    return spread(mask.select("x", "y", F.lit(1.0).alias("v")), offsets).select("x", "y")


def erode(mask: DataFrame, offsets) -> DataFrame:
    """Places of a mask whose whole neighbourhood is in it."""
    return spread(mask.select("x", "y", F.lit(1.0).alias("v")), offsets).filter(F.col("reached") == len(offsets)).select("x", "y")


def close_open(mask: DataFrame, k: int, offsets=None) -> DataFrame:
    o = offsets or disk(k)
    return dilate(erode(erode(dilate(mask, o), o), o), o)


def ecdf(values: DataFrame, column: str) -> DataFrame:
    """value, share of rows not above it."""
    c = values.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return c.select("value", (F.sum("n").over(Window.orderBy("value")) / F.sum("n").over(Window.partitionBy())).alias("share"))


def knee(values: DataFrame, column: str) -> DataFrame:
    """One row: the value whose point of the distribution function lies farthest above the line between its ends."""
    e = ecdf(values, column)
    b = e.agg(F.min("value").alias("x0"), F.max("value").alias("x1"), F.min("share").alias("y0"))
    d = (F.col("share") - F.col("y0")) / F.when(F.col("y0") < 1, 1 - F.col("y0")) - (F.col("value") - F.col("x0")) / F.when(F.col("x1") > F.col("x0"), F.col("x1") - F.col("x0"))
    return e.join(F.broadcast(b)).withColumn("d", F.coalesce(d, F.lit(0.0))).agg(F.max_by("value", F.struct("d", -F.col("value"))).alias("knee"))


def otsu(values: DataFrame, column: str) -> DataFrame:
    """One row: the cut that separates the two classes' means most, from the histogram of distinct values."""
    h = values.groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").cast("double").alias("n"))
    up, every = Window.orderBy("v"), Window.partitionBy()
    h = h.withColumn("n0", F.sum("n").over(up)).withColumn("s0", F.sum(F.col("n") * F.col("v")).over(up)).withColumn("nt", F.sum("n").over(every)).withColumn("st", F.sum(F.col("n") * F.col("v")).over(every)).filter("n0 < nt")
    d = F.col("s0") / F.col("n0") - (F.col("st") - F.col("s0")) / (F.col("nt") - F.col("n0"))
    return h.agg(F.max_by("v", F.struct(F.col("n0") * (F.col("nt") - F.col("n0")) * d * d, -F.col("v"))).alias("cut"))


def raster_moran(px: DataFrame, width: int, height: int, k: int) -> DataFrame:
    """Local Moran's I of a full raster: z times the neighbourhood's mean z (self left out) over the mean square."""
    s = F.broadcast(px.agg(F.avg("v").alias("m_"), F.var_pop("v").alias("m2_")))
    z = px.join(s).select("x", "y", (F.col("v") - F.col("m_")).alias("v"), "m2_")
    offsets = [o for o in square(k) if o != (0, 0)]
    lag = spread(mirrored(z.select("x", "y", "v"), width, height, k // 2), offsets).withColumnRenamed("v", "lag_")
    return z.join(lag, ["x", "y"]).select("x", "y", F.when(F.col("m2_") > 0, F.col("v") * F.col("lag_") / len(offsets) / F.col("m2_")).otherwise(0.0).alias("score"))


def grid_bucket(df: DataFrame, column: str, parts: int, low: float = 1.0, high: float = 100.0) -> DataFrame:
    """Number of the (lo, hi] interval that a potential lies in; the first includes its lower edge.

    Offsets in steps count as rounded to nine places, so that a value computed for an edge lies on it.
    """
    step = (high - low) / parts
    off = F.round((F.col(column) - low) / step, 9)
    at = F.ceil(off)
    return df.withColumn("bucket", F.when(off == 0, 1).when((at >= 1) & (at <= parts), at).cast("int"))
