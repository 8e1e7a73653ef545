"""Operators against values worked out by hand or by numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrid.functions import mathx
from loomgrid.operators import differential, geometry, graph, iterate, labels, learn, matrix, raster, spatial


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


X = "obs long, feature string, value double"


def test_counts_sum_duplicates_and_absent_rows_are_zero(spark):
    reads = frame(spark, [(1, "a", 2.0), (1, "a", 3.0), (2, "b", 1.0), (3, "a", 1.0)], "o long, f string, v double")
    x = matrix.from_reads(reads, "o", "f", "v")
    s = {r["feature"]: r for r in matrix.feature_stats(x).collect()}
    assert s["a"]["mean"] == 2.0 and s["a"]["var"] == pytest.approx(np.var([5, 0, 1], ddof=1)) and s["b"]["positive_ratio"] == pytest.approx(1 / 3)


def test_filters(spark):
    x = frame(spark, [(1, "a", 1.0), (1, "b", 1.0), (2, "a", 0.0)], X)
    flags = {r["obs"]: (r["n_features"], r["passes"]) for r in matrix.filter_obs(x, 1, 2, keep_flag=True, obs=frame(spark, [(1,), (2,), (9,)], "obs long")).collect()}
    assert flags == {1: (2, True), 2: (0, False), 9: (0, False)}
    assert matrix.parse_instruction("x is less than or equal to 3 and not (xy at least 2)", {"x": "c0"}) == "c0 <= 3 and not (xy >= 2)"


def test_normalisation(spark):
    x = frame(spark, [(1, "a", 3.0), (1, "b", 1.0), (2, "a", 0.0)], X)
    got = {(r["obs"], r["feature"]): r["value"] for r in matrix.normalize_total(x, 8).collect()}
    assert got == {(1, "a"): 6.0, (1, "b"): 2.0, (2, "a"): 0.0}
    z = {(r["obs"], r["feature"]): r["value"] for r in matrix.scale(x).collect()}
    assert z[(1, "a")] == pytest.approx(1 / math.sqrt(2)) and z[(2, "b")] == pytest.approx(-1 / math.sqrt(2)) and len(z) == 4


def test_shuffled_rows_keep_their_counts(spark):
    x = frame(spark, [(i, "a", float(i)) for i in range(1, 30)], X)
    assert sorted(r["value"] for r in matrix.shuffle_rows(x, 3).collect()) == [float(i) for i in range(1, 30)]


@pytest.mark.parametrize("seed", [1, 2])
def test_knn_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    p = np.concatenate([rng.normal(0, 1, (60, 2)), rng.normal(0, 0.01, (40, 2)) + 50, np.repeat([[7.0, 7.0]], 5, axis=0)])
    df = frame(spark, [(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "id long, x double, y double")
    got = {(r["src"], r["rank"]): r["dst"] for r in graph.knn(df, 4).collect()}
    for i in range(len(p)):
        d = np.sqrt(((p - p[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        assert [got[(i, k + 1)] for k in range(4)] == np.lexsort((np.arange(len(p)), d))[:4].tolist()
    v = df.select("id", F.array("x", "y").alias("v"))
    assert {(r["src"], r["rank"]): r["dst"] for r in graph.knn_vectors(v, 4, block=30).collect()} == got


def test_knn_of_few_points(spark):
    df = frame(spark, [(1, 0.0, 0.0), (2, 1.0, 0.0)], "id long, x double, y double")
    assert sorted((r["src"], r["dst"]) for r in graph.knn(df, 5).collect()) == [(1, 2), (2, 1)]
    assert graph.knn(df.filter("id = 1"), 3).count() == 0


def test_votes_and_kernels(spark):
    e = frame(spark, [(1, 2, 1.0, 1), (1, 3, 2.0, 2), (1, 4, 3.0, 3), (1, 5, 4.0, 4)], "src long, dst long, dist double, rank int")
    lab = frame(spark, [(1, "p"), (2, "q"), (3, "r"), (4, "r"), (5, "q")], "obs long, label string")
    assert [tuple(r) for r in graph.majority_label(e, lab).collect()] == [(1, "q")]
    w = {r["dst"]: r["w"] for r in graph.kernel_weights(e, "triangular", k=2).collect()}
    assert set(w) == {2} and w[2] == pytest.approx(0.5, abs=1e-6)


def test_moran_of_a_checkerboard_and_its_permutations(spark):
    cells = frame(spark, [(f"{a}_{b}", a, b) for a in range(4) for b in range(4)], "id string, gx long, gy long")
    x = cells.filter((F.col("gx") + F.col("gy")) % 2 == 1).select(F.col("id").alias("obs"), F.lit("f").alias("feature"), F.lit(1.0).alias("value"))
    e = spatial.lattice_edges(cells)
    m = spatial.moran_i(e, x, cells)
    assert m.first()["moran"] == pytest.approx(-1.0)
    assert spatial.moran_z(m, e).first()["z"] < -3
    full = cells.join(x.withColumnRenamed("obs", "id"), "id", "left").select(F.col("id").alias("obs"), F.coalesce("value", F.lit(0.0)).alias("value"))
    assert spatial.permuted_moran(e, full, 19).first()["p"] == 1.0


def ranks(v):
    s = sorted(v)
    return [(2 * s.index(a) + s.count(a) + 1) / 2 for a in v]


def test_mann_whitney_with_zeros_and_ties(spark):
    rng = np.random.default_rng(0)
    v = rng.integers(0, 4, 40).astype(float)
    g = ["a" if i < 15 else "b" for i in range(40)]
    x = frame(spark, [(i, "f", float(a)) for i, a in enumerate(v) if a > 0], X)
    groups = frame(spark, list(enumerate(g)), "obs long, group string")
    got = {r["group"]: r for r in differential.mann_whitney(x, groups).collect()}
    r = ranks(v.tolist())
    u = sum(r[:15]) - 15 * 16 / 2
    t = sum(c**3 - c for c in np.unique(v, return_counts=True)[1].tolist())
    sd = math.sqrt(15 * 25 / 12 * (41 - t / (40 * 39)))
    z = math.copysign(max(abs(u - 187.5) - 0.5, 0), u - 187.5) / sd
    assert got["a"]["u"] == u and got["a"]["z"] == pytest.approx(z) and got["a"]["p"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-6)
    assert got["b"]["u"] == 15 * 25 - u


def test_false_discovery(spark):
    df = frame(spark, [(1, 0.01), (2, 0.04), (3, 0.03), (4, None), (5, float("nan"))], "id long, p double")
    got = {r["id"]: r["q"] for r in differential.benjamini_hochberg(df, "p", None, ["id"]).collect()}
    assert got[1] == pytest.approx(0.03) and got[2] == pytest.approx(0.04) and got[3] == pytest.approx(0.04) and got[4] is None and got[5] is None


def test_regressions(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(80, 2))
    y = 1 + a @ [2.0, -1.0]
    df = frame(spark, [(1.0, float(p), float(q), float(v)) for (p, q), v in zip(a, y, strict=True)], "one double, a double, b double, y double")
    assert differential.least_squares(df, ["one", "a", "b"], "y") == pytest.approx([1, 2, -1])
    dup = df.withColumn("c", F.col("a") * 2 + F.col("b") * 1e-3)
    assert len(differential.variance_inflation(dup, ["a", "b", "c"])) == 2
    m = np.column_stack([np.ones(80), a])
    mu = np.exp(m @ [0.5, 0.3, -0.2])
    assert differential.iwls(m, mu, "poisson") == pytest.approx([0.5, 0.3, -0.2], abs=1e-6)
    e = frame(spark, [(1, i, 1.0) for i in range(80)], "src long, dst long, w double")
    s = df.withColumn("obs", F.monotonically_increasing_id()).withColumn("obs", F.row_number().over(__import__("pyspark.sql.window", fromlist=["Window"]).Window.orderBy("obs")).cast("long") - 1)
    assert list(differential.local_regression(e, s, ["a", "b"], "y").first()["betas"]) == pytest.approx([1, 2, -1])


def test_label_agreement(spark):
    df = frame(spark, [(0, 0), (0, 0), (1, 1), (1, 1), (1, 2), (2, 2)], "a int, b int")
    assert labels.adjusted_rand(df.withColumn("b", F.col("a")), "a", "b").first()["ari"] == pytest.approx(1.0)
    v = labels.v_measure(df.withColumn("b", F.col("a") * 5), "a", "b").first()
    assert v["homogeneity"] == pytest.approx(1) and v["completeness"] == pytest.approx(1)
    c = labels.classification_stats(frame(spark, [(1, 1), (1, 0), (0, 0), (0, 1)], "t int, p int"), "t", "p").first()
    assert (c["tp"], c["fp"], c["fn"], c["tn"], c["f1"]) == (1, 1, 1, 1, 0.5)


def checkerboard(spark):
    return frame(spark, [(i, j, float((i + j) % 2)) for i in range(4) for j in range(4)], "x long, y long, v double")


@pytest.mark.parametrize("shape,want", [("circle", [[2, 2, 3, 3], [2, 4, 1, 3], [3, 1, 4, 2], [3, 3, 2, 2]]), ("square", [[4, 4, 5, 5], [4, 4, 5, 5], [5, 5, 4, 4], [5, 5, 4, 4]]), ("gauss", [[0.5] * 4] * 4)])
def test_convolutions(spark, shape, want):
    got = {(r["x"], r["y"]): r["v"] for r in raster.convolve(checkerboard(spark), 4, 4, 3, shape).collect()}
    board = np.array([[(i + j) % 2 for j in range(4)] for i in range(4)], float)
    if shape == "gauss":
        assert len(got) == 16 and all(0 < v < 1 for v in got.values())
        return
    pad = np.pad(board, 1, mode="symmetric")
    offsets = raster.disk(3) if shape == "circle" else raster.square(3)
    plain = [[sum(pad[i + 1 + a, j + 1 + b] for a, b in offsets) for j in range(4)] for i in range(4)]
    assert [[got[(i, j)] for j in range(4)] for i in range(4)] == plain == want


def test_distribution_morphology_and_cuts(spark):
    v = [0] * 4 + [1] * 3 + [2, 3] + [4] * 3 + [5] * 4
    e = {r["value"]: r["share"] for r in raster.ecdf(frame(spark, [(a,) for a in v], "v int"), "v").collect()}
    assert [e[k] * 16 for k in range(6)] == [4, 7, 8, 9, 12, 16]
    mask = frame(spark, [(i, j) for i in range(3, 7) for j in range(3, 7) if (i, j) != (5, 5)] + [(0, 0)], "x long, y long")
    got = {tuple(r) for r in raster.close_open(mask, 3).select("x", "y").collect()}
    assert got == {(i, j) for i in range(3, 7) for j in range(3, 7)} - {(3, 3), (3, 6), (6, 3), (6, 6)}
    assert raster.otsu(frame(spark, [(1.0,), (1.2,), (9.0,), (9.5,)], "v double"), "v").first()["cut"] == 1.2


def test_geometry(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(30, 2))
    r = np.array(geometry.rotation(30))
    b = 2 * a @ r.T + [3, -1]
    df = frame(spark, [tuple(map(float, (*p, *q))) for p, q in zip(a, b, strict=True)], "ax double, ay double, bx double, by double")
    rot, t, k = geometry.kabsch(df, ["ax", "ay"], ["bx", "by"], scale=True)
    assert rot == pytest.approx(r) and t == pytest.approx([3, -1]) and k == pytest.approx(2)
    sq = frame(spark, [(1, float(i), float(j)) for i in range(3) for j in range(3)], "label int, x double, y double")
    h = geometry.points_props(sq).first()
    assert (h["area"], h["n"], h["centre_x"], h["max_x"]) == (4.0, 9, 1.0, 3.0)
    inside = sq.filter(geometry.inside_polygon(F.col("x"), F.col("y"), [(0.5, -1), (3, -1), (3, 1.5), (0.5, 1.5)]))
    assert inside.count() == 4
    tetra = [((0, 0, 0), (0, 1, 0), (1, 0, 0)), ((0, 0, 0), (1, 0, 0), (0, 0, 1)), ((0, 0, 0), (0, 0, 1), (0, 1, 0)), ((1, 0, 0), (0, 1, 0), (0, 0, 1))]
    m = geometry.mesh_measures(frame(spark, [tuple(float(c) for p in f for c in p) for f in tetra], ", ".join(f"{p}{c} double" for p in "abc" for c in "xyz"))).first()
    assert m["volume"] == pytest.approx(1 / 6) and m["area"] == pytest.approx(1.5 + math.sqrt(3) / 2)


def test_calculus_of_a_rotation(spark):
    one = spark.range(1).select(F.lit(0.0).alias("o"), F.lit(1.0).alias("p"), F.lit(-1.0).alias("m"))
    j = [[F.col("o"), F.col("m")], [F.col("p"), F.col("o")]]
    v = [F.lit(0.0), F.lit(2.0)]
    r = one.select(geometry.divergence(j).alias("d"), geometry.curl(j).alias("c"), geometry.curvature(v, j).alias("k")).first()
    assert (r["d"], r["c"], r["k"]) == (0.0, 2.0, 0.5)


def test_components_paths_and_fields(spark):
    e = frame(spark, [(i, i + 1, 1.0) for i in range(20)] + [(50, 51, 2.0)], "src long, dst long, dist double")
    got = {r["id"]: r["component"] for r in iterate.connected_components(e).collect()}
    assert got == {i: 0 for i in range(21)} | {50: 50, 51: 50}
    d = {r["id"]: r["dist"] for r in iterate.shortest_paths(e, frame(spark, [(18,)], "id long")).collect()}
    assert d == {18: 0.0, 19: 1.0, 20: 2.0}
    px = spark.range(5).select(F.col("id").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(0.0).alias("v"))
    f = {r["x"]: r["v"] for r in iterate.jacobi(px, px.filter("x in (0, 4)").withColumn("v", F.col("x").cast("double")), 60, 1e-9, 5).collect()}
    assert [f[k] for k in range(5)] == pytest.approx([0, 1, 2, 3, 4], abs=0.05)


def test_belief_follows_strong_neighbours(spark):
    px = frame(spark, [(i, j, 0.9, 0.1) if (i, j) != (2, 2) else (i, j, 0.45, 0.55) for i in range(5) for j in range(5)], "x long, y long, cell double, background double")
    got = {(r["x"], r["y"]): r["marginal"] for r in iterate.grid_belief(px, 10).collect()}
    assert got[(2, 2)] > 0.6 and got[(0, 0)] > 0.9


def test_searches(spark):
    assert iterate.golden_section(lambda x: (x - 2) ** 2, 0, 5) == pytest.approx(2, abs=1e-4)
    e = frame(spark, [(i, j, float(abs(i - j))) for i in range(40) for j in range(40) if i != j], "src long, dst long, dist double")
    bw = iterate.bandwidth_for(e, 40, 6, 88.0)
    assert abs(e.filter(F.col("dist") <= bw).count() / 40 - 6) <= 0.6
    got = iterate.nb_mixture(frame(spark, [(int(v),) for v in np.random.default_rng(0).negative_binomial(5, 0.3, 500)], "v int"), "v", (0.5, 0.5), (5.0, 20.0), (10.0, 60.0), 20)
    assert sum(got["w"]) == pytest.approx(1)


def test_negative_binomial_pmf(spark):
    one = spark.range(5).select(mathx.nb_pmf(F.lit(10.0), F.lit(0.5), F.col("id").cast("double")).alias("p"), F.col("id").alias("k"))
    for r in one.collect():
        k = r["k"]
        assert r["p"] == pytest.approx(math.comb(k + 9, k) * 0.5 ** (10 + k), rel=1e-9)


def test_decompositions(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 4)) * [5, 2, 1, 0.1]
    df = frame(spark, [(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<double>")
    scores, axes, share = learn.pca(df, 2)
    c = v - v.mean(axis=0)
    want = np.abs(c @ np.linalg.svd(c, full_matrices=False)[2][:2].T)
    got = np.array([r["scores"] for r in scores.orderBy("id").collect()])
    assert np.abs(got) == pytest.approx(want) and share[0] > 0.7
    plan = learn.sinkhorn(np.array([[0.0, 1.0], [1.0, 0.0]]), np.array([0.5, 0.5]), np.array([0.5, 0.5]), 0.01)
    assert plan == pytest.approx(np.eye(2) / 2, abs=1e-6)


def test_kernel_weights_of_coincident_points(spark):
    """A bandwidth of 0 weighs neighbours at distance 0 only; nothing is divided by it."""
    edges = spark.createDataFrame([(1, 2, 0.0), (1, 3, 0.0), (1, 4, 2.0), (2, 1, 1.0), (2, 3, 2.0)], "src long, dst long, dist double")
    got = {(r["src"], r["dst"]): r["w"] for r in graph.kernel_weights(edges, "bisquare", k=2, normalize=False).collect()}
    assert got[(1, 2)] == got[(1, 3)] == 1.0 and (1, 4) not in got and 0 < got[(2, 1)] < 1
    got = {(r["src"], r["dst"]): r["w"] for r in graph.kernel_weights(edges, "gaussian", k=2).collect()}
    assert got[(1, 2)] == 1.0 and (1, 4) not in got


def test_divisions_by_nothing(spark):
    flat = spark.createDataFrame([(i, 1.0, 2.0) for i in range(4)], "id long, x double, y double")
    assert {r["along"] for r in matrix.diagonal_coordinate(flat).collect()} == {0.0}
    one = spark.createDataFrame([(1, 1, 0.0), (1, 2, 3.0)], "obs long, feature long, value double")
    assert matrix.pearson_residuals(one).count() == 2 and matrix.scaled_to_unit_mean(spark.createDataFrame([(1, 0.0)], "obs long, factor double")).collect()[0]["factor"] is None
