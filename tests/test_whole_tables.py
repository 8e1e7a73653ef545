"""Queries without SQL that take every row, against brute force over the smallest tables."""

import heapq
import math
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from loomgrid.operators import iterate, learn
from loomgrid.plans import catalogue

D = "/root/testdata/sf0.001"


def rows(sql):
    return duckdb.sql(sql.format(D=D)).fetchall()


def got(spark, name, d=D):
    return [tuple(r) for r in catalogue.queries()[name](spark, d).collect()]


def test_jaccard_pairs_of_all_users(spark):
    has = defaultdict(set)
    # the smallest table has no user from 60 on
    for e, u in rows("SELECT event_id, user_id FROM '/root/testdata/sf0.01/events.parquet'"):
        has[u].add(e % 40)
    want = {(a, b): len(has[a] & has[b]) / len(has[a] | has[b]) for a in has for b in has if a < b}
    want = {p: j for p, j in want.items() if j >= 0.6}
    out = {(a, b): j for a, b, j in got(spark, "jaccard_pairs", "/root/testdata/sf0.01")}
    assert out == pytest.approx(want, abs=1e-6) and max(a for a, _ in out) >= 60


def test_silhouette_of_all_vectors(spark):
    e = rows("SELECT vec_id, embedding, label FROM '{D}/embeddings.parquet'")
    v, lab = np.array([x[1] for x in e], float), np.array([x[2] for x in e])
    s = []
    for i in range(len(e)):
        d = np.sqrt(((v - v[i]) ** 2).sum(axis=1))
        mean = {k: d[(lab == k) & (np.arange(len(e)) != i)].mean() for k in set(lab.tolist()) if ((lab == k) & (np.arange(len(e)) != i)).any()}
        a, b = mean.get(lab[i]), min(x for k, x in mean.items() if k != lab[i])
        s.append(0.0 if a is None or max(a, b) == 0 else (b - a) / max(a, b))
    assert len(e) > 200 and got(spark, "silhouette")[0][0] == pytest.approx(np.mean(s), abs=1e-6)


def test_silhouette_in_several_blocks(spark):
    from loomgrid.operators import labels

    v = catalogue.vectors(spark, D)
    one, many = (labels.silhouette_vectors(v, block=b).first()[0] for b in (10**6, 90))
    assert one == pytest.approx(many, abs=1e-12)


def test_arc_length_of_all_parts(spark):
    d = "/root/testdata/sf0.01"
    p = sorted(rows(f"SELECT p_partkey, CAST(p_size AS DOUBLE), p_retailprice / 100 FROM '{d}/part.parquet'"))
    arc, want = 0.0, {}
    for k, (i, x, y) in enumerate(p):
        arc += math.hypot(x - p[k - 1][1], y - p[k - 1][2]) if k else 0.0
        want[i] = arc
    out = dict(got(spark, "arc_length", d))
    assert len(out) == len(p) > 300 and out == pytest.approx(want, abs=1e-3)


def test_scores_of_all_ligands(spark):
    value, size = defaultdict(float), defaultdict(int)
    group = dict(rows("SELECT o_orderkey, o_orderpriority FROM '{D}/orders.parquet'"))
    for g in group.values():
        size[g] += 1
    for o, s, q in rows("SELECT l_orderkey, l_suppkey, CAST(l_quantity AS DOUBLE) FROM '{D}/lineitem.parquet'"):
        if o in group:
            value[group[o], s] += q
    keys = [k for (k,) in rows("SELECT s_suppkey FROM '{D}/supplier.parquet'")]
    want = {(a, b, k, k + 7): (value[a, k] / size[a] + value[b, k + 7] / size[b]) / 2 for a in size for b in size if a < b for k in keys}
    assert {r[:4]: r[4] for r in got(spark, "group_pair_scores")} == pytest.approx(want, abs=1e-6)


def test_transport_over_all_parts(spark):
    p = sorted(rows("SELECT p_partkey, CAST(p_size AS DOUBLE), p_retailprice / 20 FROM '{D}/part.parquet'"))
    at, c = {r[0]: i for i, r in enumerate(p)}, np.array([r[1:] for r in p], float)
    weight = defaultdict(lambda: np.zeros(len(p)))
    for o, s, q in rows("SELECT l_partkey, l_suppkey % 10, CAST(l_quantity AS DOUBLE) FROM '{D}/lineitem.parquet'"):
        if o in at:
            weight[s][at[o]] += q
    out = dict(got(spark, "transport_distances"))
    assert len(p) > 120 and set(out) == set(weight)
    for s, a in weight.items():
        used = np.flatnonzero(a)
        cost = np.sqrt(((c[used][:, None] - c[None]) ** 2).sum(axis=2))
        plan = learn.sinkhorn(cost, a[used] / a.sum(), np.full(len(p), 1 / len(p)), 0.05, 200)
        assert out[s] == pytest.approx(float((plan * cost).sum()), rel=1e-6)


def test_shortest_paths_reach_every_node(spark):
    d, edges = "/root/testdata/sf0.01", defaultdict(dict)
    for r in catalogue.graph.symmetric(catalogue.graph.knn(catalogue.points(spark, d), 4)).collect():
        edges[r["src"]][r["dst"]] = r["dist"]
    sources = [i for i in edges if i % 997 == 1]
    want, longest = {}, 0
    for s in sources:
        best, hops, heap = {}, {}, [(0.0, 0, s)]
        while heap:
            far, n, i = heapq.heappop(heap)
            if i not in best:
                best[i], hops[i] = far, n
                for j, w in edges[i].items():
                    heapq.heappush(heap, (far + w, n + 1, j))
        want |= {(s, i): d for i, d in best.items()}
        longest = max(longest, *hops.values())
    assert longest > 6
    assert {(a, b): far for a, b, far in got(spark, "shortest_paths", d)} == pytest.approx(want, abs=1e-9)


def test_communities_are_stable(spark):
    for edges in (catalogue.part_edges(spark, D).select("src", "dst", "w"), spark.createDataFrame([(i, j, 1.0) for i in range(4) for j in range(4, 9)], "src long, dst long, w double")):
        label = dict(tuple(r) for r in iterate.label_propagation(edges, None).collect())
        votes = defaultdict(lambda: defaultdict(float))
        for a, b, w in edges.collect():
            votes[a][label[b]] += w
            votes[b][label[a]] += w
        for i, v in votes.items():
            v[label[i]] += 0.5
            assert label[i] == min(v, key=lambda c: (-v[c], c))


def test_communities_of_the_query_are_stable(spark):
    now = dict(got(spark, "communities"))
    assert now == dict(tuple(r) for r in iterate.label_propagation(catalogue.part_edges(spark, D), None).collect())


def test_mixture_uses_every_component(spark, tmp_path):
    rng = np.random.default_rng(1)
    v = rng.normal(0, 1, (300, 64))
    v[:, 6:] += 6 * rng.normal(0, 1, (4, 58))[np.arange(300) % 4]
    spark.createDataFrame([(i, x, i % 2) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    out = got(spark, "mixture_clusters", str(tmp_path))
    assert len(out) == 300 and len({c for _, c in out}) > 1
    together = Counter((i % 4, c) for i, c in out)
    most = {g: max((n, c) for (h, c), n in together.items() if h == g) for g in range(4)}
    assert len({c for _, c in most.values()}) == 4 and sum(n for n, _ in most.values()) >= 0.95 * 300


def test_buckets_of_all_parts(spark):
    from loomgrid.operators import raster

    want = {i: -(-s // 5) for i, s in rows("SELECT p_partkey, p_size FROM '{D}/part.parquet'")}
    assert dict(got(spark, "grid_bucket")) == want
    for parts, low, high in ((10, 1.0, 100.0), (7, 0.0, 0.7), (3, -0.1, 0.2), (10, 0.1, 1.1), (6, 0.1, 0.7), (9, 0.3, 1.2), (10, 0.1, 0.4)):
        edges = [(k, low + k * (high - low) / parts) for k in range(parts + 1)]
        out = raster.grid_bucket(spark.createDataFrame(edges, "k int, v double"), "v", parts, low, high).collect()
        assert {r["k"]: r["bucket"] for r in out} == {k: max(k, 1) for k in range(parts + 1)}
