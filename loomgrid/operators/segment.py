"""Segmentation of sparse rasters: labels are tables (x, y, label) without background, values tables (x, y, v) of every pixel.

Loops hand one front or one round of neighbours to the next and cut their lineage, so a round costs a join on shifted
coordinates. Labels of components are 64-bit places (x times 2^32 plus y of their first pixel), never negative.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.session import checkpointed
from .iterate import connected_components, race_sample
from .raster import close_open, convolve, disk, otsu, raster_moran, square

FOUR = ((1, 0), (-1, 0), (0, 1), (0, -1))


def _moves(offsets):
    return F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in offsets]))


def _sent(px: DataFrame, offsets, *columns: str) -> DataFrame:
    """Each pixel's columns at the places it is a neighbour of."""
    return px.select("x", "y", *columns, _moves(offsets).alias("m")).select((F.col("x") - F.col("m.a")).alias("x"), (F.col("y") - F.col("m.b")).alias("y"), *columns)


def _inside(df: DataFrame, width: int, height: int) -> DataFrame:
    return df.filter(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))


def median_blur(px: DataFrame, width: int, height: int, k: int) -> DataFrame:
    """Median over a k-wide square (k odd) of values as bytes, the edge repeated beyond the border."""
    r = k // 2
    out = px.select("x", "y", F.pmod(F.floor("v").cast("long"), F.lit(256)).cast("double").alias("v"))
    for c, n in (("x", width), ("y", height)):
        edge = lambda at, steps: F.when(F.col(c) == at, F.array(*[F.lit(s) for s in steps])).otherwise(F.array().cast("array<int>"))  # noqa: B023, E731
        own = F.concat(F.array(F.lit(0)), edge(0, range(-r, 0)), edge(n - 1, range(1, r + 1)))
        out = out.withColumn("s_", F.explode(own)).withColumn(c, F.col(c) + F.col("s_")).drop("s_")
    return _inside(_sent(out, square(k), "v"), width, height).groupBy("x", "y").agg(F.median("v").alias("v"))


def apply_threshold(px: DataFrame, k: int, threshold: float) -> DataFrame:
    """Mask (x, y) of values at or above the threshold, closed and opened by a k-wide circle."""
    return close_open(px.filter(F.col("v") >= threshold).select("x", "y"), k)


def mask_components(mask: DataFrame, diagonal: bool = True) -> DataFrame:
    """(x, y, label) of the pixels of a mask that hang together, through corners too if diagonal."""
    place = ((F.col("x").cast("long") * (1 << 32)) + F.col("y")).alias("id")
    ids = mask.select("x", "y", place)
    half = ((1, 0), (0, 1), (1, 1), (1, -1)) if diagonal else ((1, 0), (0, 1))
    near = _sent(ids.withColumnRenamed("id", "dst"), half, "dst")
    edges = near.join(ids, ["x", "y"]).select(F.col("id").alias("src"), "dst")
    return ids.join(connected_components(edges, ids), "id").select("x", "y", F.col("component").alias("label"))


def eroded(mask: DataFrame, offsets, width: int, height: int) -> DataFrame:
    """Pixels of a mask all of whose neighbours within the raster are in it."""
    offsets = list(offsets)
    # each offset counts where it stays inside; beyond the border nothing erodes
    beyond = sum((((F.col("x") + a < 0) | (F.col("x") + a >= width) | (F.col("y") + b < 0) | (F.col("y") + b >= height)).cast("int") for a, b in offsets), F.lit(0))
    got = _inside(_sent(mask, offsets), width, height).groupBy("x", "y").agg(F.count("*").alias("c"))
    return got.filter(F.col("c") + beyond == len(offsets)).select("x", "y")


def safe_erode(mask: DataFrame, width: int, height: int, k: int, as_square: bool = False, min_area: int = 1, n_iter: int = -1) -> DataFrame:
    """A mask eroded again and again, whose parts are kept once they have min_area pixels or fewer.

    Ends when no part is larger, or after n_iter rounds. A part that one erosion removes whole is lost.
    """
    offsets = square(k) if as_square else disk(k)
    left, saved, i = checkpointed(mask.select("x", "y").distinct()), None, 0
    while True:
        parts = mask_components(left)
        area = F.count("*").over(Window.partitionBy("label"))
        parts = checkpointed(parts.withColumn("area", area))
        small = parts.filter(F.col("area") <= min_area).select("x", "y")
        saved = small if saved is None else saved.unionByName(small)
        left, i = checkpointed(eroded(left, offsets, width, height)), i + 1
        if i == n_iter or not parts.filter(F.col("area") > min_area).limit(1).count():
            return left.unionByName(saved).distinct()


def markers_by_erosion(mask: DataFrame, width: int, height: int, k: int = 3, as_square: bool = False, min_area: int = 80, n_iter: int = -1) -> DataFrame:
    """(x, y, label): what safe erosion leaves, labelled by what hangs together."""
    return mask_components(safe_erode(mask, width, height, k, as_square, min_area, n_iter))


def boundaries(labels: DataFrame, width: int, height: int, thickness: int = 1) -> DataFrame:
    """(x, y) of labelled pixels with a neighbour of another label or of none, and so on inwards."""
    left, out = labels.select("x", "y", "label"), None
    for _ in range(thickness):
        near = _sent(left.withColumnRenamed("label", "near"), FOUR, "near")
        seen = left.join(near, ["x", "y"], "left").groupBy("x", "y", "label").agg(F.count_if(F.col("near") == F.col("label")).alias("same"))
        own = sum((((F.col("x") + a).between(0, width - 1)) & (F.col("y") + b).between(0, height - 1)).cast("int") for a, b in FOUR)
        ring = seen.filter(F.col("same") < own).select("x", "y")
        out = ring if out is None else out.unionByName(ring)
        left = left.join(ring, ["x", "y"], "left_anti")
    return out


def replace_labels(labels: DataFrame, mapping: DataFrame) -> DataFrame:
    """Labels replaced by a table (label, to); 0 is the background and goes, labels not in the table stay."""
    to = mapping.select("label", F.col("to").alias("to_"))
    out = labels.join(to, "label", "left").select("x", "y", F.coalesce("to_", "label").alias("label"))
    return out.filter("label <> 0")


def expand_labels(labels: DataFrame, width: int, height: int, distance: int = 5, max_area: int = 400, mask: DataFrame | None = None) -> DataFrame:
    """Labels grown by distance rounds: a free pixel takes the one label among its four neighbours, if only one is there
    and that label had fewer than max_area pixels before the round."""
    now = checkpointed(labels.select("x", "y", "label"))
    for _ in range(distance):
        near = _inside(_sent(now, FOUR, "label"), width, height).groupBy("x", "y").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").select("x", "y", "label")
        free = near.join(now.select("x", "y"), ["x", "y"], "left_anti")
        if mask is not None:
            free = free.join(mask.select("x", "y"), ["x", "y"], "left_semi")
        full = now.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") >= max_area)
        now = checkpointed(now.unionByName(free.join(full, "label", "left_anti").select("x", "y", "label")))
    return now


def augment_labels(source: DataFrame, target: DataFrame) -> DataFrame:
    """Target labels that overlap any source label, then source labels that overlap no target, numbered from 1 in that order."""
    s, t = source.select("x", "y", F.col("label").alias("s")), target.select("x", "y", F.col("label").alias("t"))
    both = s.join(t, ["x", "y"]).select("s", "t").distinct()
    kept = t.join(both.select("t").distinct(), "t", "left_semi").select("x", "y", F.lit(0).alias("second"), F.col("t").alias("label"))
    added = s.join(both.select("s").distinct(), "s", "left_anti").select("x", "y", F.lit(1).alias("second"), F.col("s").alias("label"))
    rows = kept.unionByName(added)
    order = rows.select("second", "label").distinct().withColumn("number", F.row_number().over(Window.orderBy("second", "label")))
    return rows.join(order, ["second", "label"]).select("x", "y", F.col("number").alias("label"))


def _window_max(px: DataFrame, reach: int) -> DataFrame:
    """The largest value within reach along both axes, one axis after the other."""
    for along in ([(a, 0) for a in range(-reach, reach + 1)], [(0, b) for b in range(-reach, reach + 1)]):
        px = _sent(px, along, "v").groupBy("x", "y").agg(F.max("v").alias("v"))
    return px


def local_peaks(px: DataFrame, width: int, height: int, min_distance: int) -> DataFrame:
    """(x, y, label): pixels that none within min_distance along both axes exceeds and that exceed the least value, min_distance
    or more off the border; the highest has label 1. Of equal ones at most min_distance apart, one with an earlier equal one goes."""
    d = min_distance
    top = _window_max(px.select("x", "y", "v"), d).withColumnRenamed("v", "top")
    peaks = px.join(top, ["x", "y"]).join(px.agg(F.min("v").alias("least"))).filter((F.col("v") == F.col("top")) & (F.col("v") > F.col("least")))
    peaks = checkpointed(peaks.filter(F.col("x").between(d, width - 1 - d) & F.col("y").between(d, height - 1 - d)).select("x", "y", "v"))
    earlier = [(a, b) for a in range(-d, d + 1) for b in range(-d, d + 1) if (a, b) > (0, 0) and a * a + b * b <= d * d]
    if earlier:
        near = _sent(peaks.withColumnRenamed("v", "w"), [(-a, -b) for a, b in earlier], "w")
        peaks = peaks.join(near, (peaks["x"] == near["x"]) & (peaks["y"] == near["y"]) & (peaks["v"] == near["w"]), "left_anti")
    return peaks.select("x", "y", F.row_number().over(Window.orderBy(F.desc("v"), "x", "y")).alias("label"))


def find_peaks(px: DataFrame, width: int, height: int, k: int, min_distance: int, mask: DataFrame | None = None) -> DataFrame:
    """Peaks of the values blurred by a k-wide gaussian, within the mask if there is one; their labels count those outside too."""
    found = local_peaks(convolve(px, width, height, k, "gauss").withColumn("v", F.round("v", 9)), width, height, min_distance)
    return found if mask is None else found.join(mask.select("x", "y"), ["x", "y"], "left_semi")


def watershed(px: DataFrame, markers: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """(x, y, label): each pixel of the mask that a marker reaches gets the marker with the lowest pass to it.

    The pass is the largest value on the way; equal ones go to the shorter way, then to the smaller label. Fronts of pixels
    that found a better way are extended through their four neighbours until there is none.
    """
    area = px if mask is None else px.join(mask.select("x", "y").unionByName(markers.select("x", "y")).distinct(), ["x", "y"], "left_semi")
    area = checkpointed(area.select("x", "y", F.col("v").cast("double").alias("v")))
    start = markers.select("x", "y", F.struct(F.lit(-math.inf).alias("level"), F.lit(0).alias("steps"), F.col("label").cast("long").alias("label")).alias("way"))
    best = front = checkpointed(start)
    seeds = best.select("x", "y")
    while True:
        step = _sent(front, FOUR, "way").join(area, ["x", "y"]).join(seeds, ["x", "y"], "left_anti")
        way = F.struct(F.greatest("way.level", "v").alias("level"), (F.col("way.steps") + 1).alias("steps"), F.col("way.label").alias("label"))
        found = step.groupBy("x", "y").agg(F.min(way).alias("new"))
        front = checkpointed(found.join(best, ["x", "y"], "left").filter(F.col("way").isNull() | (F.col("new") < F.col("way"))).select("x", "y", F.col("new").alias("way")))
        if not front.limit(1).count():
            return best.select("x", "y", F.col("way.label").alias("label"))
        best = checkpointed(best.join(front, ["x", "y"], "left_anti").unionByName(front))


def score_pixels(px: DataFrame, width: int, height: int, k: int, method: str = "gauss") -> DataFrame:
    """Scores from 0 to 1: a gaussian mean scaled from least to most, or local Moran's I over its largest value."""
    if method == "gauss":
        own = convolve(px, width, height, k, "gauss")
        ends = own.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
        return own.join(ends).select("x", "y", F.when(F.col("hi") > F.col("lo"), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0).alias("v"))
    if method == "moran":
        own = raster_moran(px, width, height, k)
        return own.join(own.agg(F.max("score").alias("hi"))).select("x", "y", F.when(F.col("hi") > 0, F.col("score") / F.col("hi")).otherwise(0.0).alias("v"))
    raise ValueError(f"unknown method {method!r}")


def mask_pixels(scores: DataFrame, k: int, threshold: float | None = None, certain: DataFrame | None = None) -> DataFrame:
    """Mask of scores at or above a threshold, Otsu's cut without one, closed and opened; certain pixels (x, y) count as 1."""
    if certain is not None:
        sure = certain.select("x", "y", F.lit(1.0).alias("sure"))
        scores = scores.join(sure, ["x", "y"], "left").select("x", "y", F.coalesce("sure", "v").alias("v"))
    if threshold is None:
        cut = otsu(scores, "v").first()
        above = scores.filter(F.col("v") > cut["cut"]) if cut and cut["cut"] is not None else scores.filter("false")
        return close_open(above.select("x", "y"), max(k - 2, 3))
    return apply_threshold(scores, max(k - 2, 3), threshold)


def remove_background(px: DataFrame, threshold: float | None = None) -> DataFrame:
    """Values below the threshold become 0; without one, values up to Otsu's cut."""
    if threshold is not None:
        return px.withColumn("v", F.when(F.col("v") < threshold, 0.0).otherwise(F.col("v")))
    return px.join(otsu(px, "v")).withColumn("v", F.when(F.col("v") <= F.col("cut"), 0.0).otherwise(F.col("v"))).drop("cut")


def select_regions(px: DataFrame, size: int, n: int, seed: int = 0, weight=None) -> DataFrame:
    """n tiles (x, y, total) of size by size, drawn without replacement in proportion to weight(total), ln(1 + total) without one."""
    tile = [(F.floor(F.col(c) / size) * size).cast("long").alias(c) for c in ("x", "y")]
    tiles = px.groupBy(*tile).agg(F.sum("v").alias("total"))
    tiles = tiles.withColumn("weight", (weight or F.log1p)(F.col("total"))).withColumn("tile", F.concat_ws(",", "x", "y"))
    return race_sample(tiles, n, F.col("weight"), "tile", seed).select("x", "y", "total")
