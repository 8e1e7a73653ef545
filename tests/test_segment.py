"""Segmentation against hand-checked rasters and plain loops."""

import heapq
import random
from collections import defaultdict

import numpy as np

from loomgrid.operators import segment
from loomgrid.plans import catalogue

D = "/root/testdata/sf0.001"


def mask(spark, places):
    return spark.createDataFrame([(int(a), int(b)) for a, b in places], "x long, y long")


def raster(spark, a):
    return spark.createDataFrame([(i, j, float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])], "x long, y long, v double")


def places(df):
    return {(r["x"], r["y"]) for r in df.collect()}


def test_safe_erosion_keeps_small_parts(spark):
    block = [(i, j) for i in range(3, 7) for j in range(3, 7)]
    assert places(segment.safe_erode(mask(spark, block), 10, 10, 3, True, 4)) == {(i, j) for i in (4, 5) for j in (4, 5)}
    assert places(segment.safe_erode(mask(spark, [*block, (0, 0)]), 10, 10, 3, True, 4)) == {(i, j) for i in (4, 5) for j in (4, 5)} | {(0, 0)}
    # beyond the border nothing erodes
    assert places(segment.eroded(mask(spark, [(i, j) for i in range(4) for j in range(4)]), segment.square(3), 10, 10)) == {(i, j) for i in range(3) for j in range(3)}
    got = {(r["x"], r["y"]): r["label"] for r in segment.mask_components(mask(spark, [(0, 0), (1, 1), (5, 5)])).collect()}
    assert got[(0, 0)] == got[(1, 1)] != got[(5, 5)]
    assert len({r["label"] for r in segment.mask_components(mask(spark, [(0, 0), (1, 1), (5, 5)]), False).collect()}) == 3
    assert segment.safe_erode(mask(spark, block).filter("false"), 10, 10, 3).collect() == []


def test_watershed_fills_two_blobs(spark):
    a = np.full((10, 10), 9.0)
    blobs = [(i, j) for o in (0, 7) for i in range(o, o + 3) for j in range(o, o + 3)]
    for i, j in blobs:
        a[i, j] = 1.0
    markers = spark.createDataFrame([(1, 1, 1), (8, 8, 2)], "x long, y long, label long")
    got = {(r["x"], r["y"]): r["label"] for r in segment.watershed(raster(spark, a), markers, mask(spark, blobs)).collect()}
    assert got == {(i, j): 1 if i < 5 else 2 for i, j in blobs}


def test_watershed_against_a_queue(spark):
    rng = random.Random(3)
    a = np.array([[rng.randrange(6) for _ in range(9)] for _ in range(9)], float)
    seeds = {(1, 1): 1, (7, 2): 2, (4, 7): 3}
    best = {p: (-np.inf, 0, k) for p, k in seeds.items()}
    queue = [(w, p) for p, w in best.items()]
    heapq.heapify(queue)
    while queue:
        w, p = heapq.heappop(queue)
        if best[p] != w:
            continue
        for dx, dy in segment.FOUR:
            q = (p[0] + dx, p[1] + dy)
            if 0 <= q[0] < 9 and 0 <= q[1] < 9 and q not in seeds:
                new = (max(w[0], a[q]), w[1] + 1, w[2])
                if q not in best or new < best[q]:
                    best[q] = new
                    heapq.heappush(queue, (new, q))
    markers = spark.createDataFrame([(*p, k) for p, k in seeds.items()], "x long, y long, label long")
    got = {(r["x"], r["y"]): r["label"] for r in segment.watershed(raster(spark, a), markers).collect()}
    assert got == {p: w[2] for p, w in best.items()}


def test_scores_masks_and_regions(spark):
    a = np.zeros((12, 12))
    a[4:9, 4:9] = 10
    scores = segment.score_pixels(raster(spark, a), 12, 12, 3)
    v = {(r["x"], r["y"]): r["v"] for r in scores.collect()}
    assert v[(6, 6)] == 1.0 and v[(0, 0)] == 0.0
    got = places(segment.mask_pixels(scores, 5))
    assert (6, 6) in got and (0, 0) not in got and 12 <= len(got) <= 45
    assert (6, 6) in places(segment.mask_pixels(segment.score_pixels(raster(spark, a), 12, 12, 3, "moran"), 5, 0.5))
    assert places(segment.apply_threshold(raster(spark, a), 3, 5.0)) <= {(i, j) for i in range(4, 9) for j in range(4, 9)}
    tiles = segment.select_regions(raster(spark, a), 4, 2, seed=1).collect()
    assert len(tiles) == 2 and all(r["total"] > 0 for r in tiles)
    flat = segment.score_pixels(raster(spark, np.ones((4, 4))), 4, 4, 3).collect()
    assert {r["v"] for r in flat} == {0.0}
    removed = {(r["x"], r["y"]): r["v"] for r in segment.remove_background(raster(spark, a)).collect()}
    assert removed[(6, 6)] == 10 and removed[(0, 0)] == 0


def test_registered_erosion_and_watershed(spark):
    """The queries' whole rasters against plain loops."""
    own = {(r["x"], r["y"]) for r in catalogue.block_labels(spark, D, True).collect()}
    offsets = segment.disk(3)
    left, saved = set(own), set()
    while True:
        todo, parts = set(left), []
        while todo:
            part, front = set(), [todo.pop()]
            while front:
                p = front.pop()
                part.add(p)
                near = {(p[0] + i, p[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & todo
                todo -= near
                front += near
            parts.append(part)
        saved |= {p for part in parts if len(part) <= 4 for p in part}
        left = {p for p in left if all(q in left or not (0 <= q[0] < 20 and 0 <= q[1] < 15) for q in ((p[0] + i, p[1] + j) for i, j in offsets))}
        if not any(len(part) > 4 for part in parts):
            break
    assert places(catalogue.queries()["safely_eroded"](spark, D)) == left | saved
    by = defaultdict(set)
    for r in catalogue.queries()["watershed_labels"](spark, D).collect():
        by[r["label"]].add((r["x"], r["y"]))
    assert sum(map(len, by.values())) == 300 and all(by.values())
