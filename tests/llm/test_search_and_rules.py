import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrid.llm import metric_topk, queries, urlrules
from loomgrid.llm.queries import URL_RULES


def plain_top(rows, k):
    out = set()
    for i, q in rows:
        if i % 50:
            continue
        scored = sorted((-sum(int(a) * int(b) for a, b in zip(q, v)), j) for j, v in rows if j != i and len(v) == len(q))
        out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("n,spread", [(1, 5), (4, 5), (700, 2), (1500, 300)])
def test_top_k_equals_brute_force(spark, n, spread, monkeypatch):
    monkeypatch.setattr(metric_topk, "SHARD", 400)
    rng = np.random.default_rng(n)
    rows = [(int(i), [float(x) for x in rng.integers(-spread, spread + 1, 6)]) for i in range(-100, n - 100)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = {tuple(r) for r in metric_topk.top_k(df, df.filter("vec_id % 50 = 0")).collect()}
    assert got == plain_top(rows, 5)


def test_tree_skips_work_and_stays_exact():
    rng = np.random.default_rng(0)
    centres = rng.integers(-200, 200, (20, 8))
    v = (centres[rng.integers(0, 20, 6000)] + rng.integers(-3, 4, (6000, 8))).astype(float)
    tree = metric_topk.MTree(np.arange(6000), v)
    for q in range(0, 6000, 600):
        got = tree.best(q, v[q], 5)
        s = (v @ v[q]).astype(int)
        s[q] = -(10**9)
        order = np.lexsort((np.arange(6000), -s))[:5]
        assert got == [(int(s[j]), int(j)) for j in order]
    assert tree.computed < 0.7 * 10 * 6000


def test_repeated_query_rows_take_no_places(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-9, 10, 4)]) for i in range(1, 200)] + [(0, [40.0, 40.0, 40.0, 40.0])] * 12 + [(50, [30.0, -30.0, 30.0, -30.0])] * 7
    rows = [r for r in rows if r[0] != 50 or r[1][0] == 30.0]
    tree = metric_topk.MTree(np.array([i for i, _ in rows]), np.array([v for _, v in rows]))
    assert tree.root.children is None
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = {tuple(r) for r in metric_topk.top_k(df, df.filter("vec_id in (0, 50)")).collect()}
    for q, v in ((0, [40.0] * 4), (50, [30.0, -30.0] * 2)):
        scored = sorted((-int(np.dot(v, w)), j) for j, w in rows if j != q)[:5]
        want = [(-s, j) for s, j in scored]
        assert tree.best(q, np.array(v), 5) == want
        assert {r for r in got if r[0] == q} == {(q, n + 1, j, s) for n, (s, j) in enumerate(want)}


def test_identical_vectors_large_values_and_odd_rows(spark):
    rows = [(i, [1.0, 2.0]) for i in range(0, 700)] + [(1000, [float(1 << 60), 3.0]), (1050, [float(1 << 60), 4.0]), (2000, [1.0]), (None, [1.0, 1.0]), (3000, [])]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = {}
    for r in metric_topk.top_k(df, df.filter("vec_id % 50 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got[0])[:2] == [(1, 1050, (1 << 60) + 8), (2, 1000, (1 << 60) + 6)] and [x[1] for x in sorted(got[0])][2:] == [1, 2, 3]
    assert sorted(got[1000])[0] == (1, 1050, (1 << 63) - 1)
    assert 2000 not in got
    empty = df.filter("false")
    assert metric_topk.top_k(empty, empty).collect() == []


def test_cells_rule_out_shards(spark, monkeypatch):
    """Tight clusters: queries reach few cells, the result is that of brute force, repeated vectors fill no single shard."""
    monkeypatch.setattr(metric_topk, "SHARD", 300)
    rng = np.random.default_rng(5)
    centres = rng.integers(-300, 300, (12, 16))
    v = centres[rng.integers(0, 12, 4000)] + rng.integers(-2, 3, (4000, 16))
    v[1000:2300] = v[1000]
    rows = [(i, [float(x) for x in w]) for i, w in enumerate(v.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>").selectExpr("*", "1 as shard", "2 as score", "3 as cell", "'x' as id")
    found, asked = metric_topk.searched(df, df.filter("vec_id % 50 = 0"))
    computed = found.selectExpr("sum(computed)").first()[0]
    assert computed < 0.6 * 80 * 4000
    got = {tuple(r) for r in metric_topk.top_k(df, df.filter("vec_id % 50 = 0")).collect()}
    scores = v @ v.T
    want = set()
    for q in range(0, 4000, 50):
        s = scores[q].copy()
        order = [j for j in np.lexsort((np.arange(4000), -s)) if j != q][:5]
        want |= {(q, n + 1, int(j), int(s[j])) for n, j in enumerate(order)}
    assert got == want


def test_registered_query_on_odd_vectors(spark, tmp_path):
    rng = np.random.default_rng(9)
    e = rng.normal(size=(300, 5)).astype(np.float32)
    rows = [(i, [float(x) for x in w], 1, "s") for i, w in enumerate(e)]
    rows[7], rows[100] = (7, None, 1, "s"), (100, [1.0, None, 0.0, 0.0, 0.0], 1, "s")
    rows[9] = (9, [float("nan")] * 5, 1, "s")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, shard int, score string").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {tuple(r) for r in queries.op2_mtree_topk(spark, str(tmp_path)).collect()}
    whole = [(i, [float(np.floor(256 * np.float64(np.float32(x)))) for x in w]) for i, w, _, _ in rows if i not in (7, 9, 100)]
    assert got == plain_top(whole, 5)


def test_usable(spark):
    rows = [(1, [1.0]), (2, None), (3, [None]), (4, [float("nan")]), (5, [float("-inf")]), (6, [])]
    df = spark.createDataFrame(rows, "i long, e array<float>").filter(metric_topk.usable(F.col("e")))
    assert sorted(r["i"] for r in df.collect()) == [1, 6]


URLS = [
    "https://www.Example.com/en/712", "http://a.b.com/en/x?y#z", "http://com/en/", "http://com/en", "http://xcom/en/1", "https://de.net/de/8", "http://example.net/de/8", "http://sub.example.net/de/81#t", "http://myexample.net/de/8",
    "no scheme", None, "", "://", "a://HOST?x://y", "http://ads-track.example.org/fr/1", "http://x.org/es/#q", "http://x.org/es", "http://x.org:80/es/", "http://example.com/EN/7", "ftp://example.com/en/7/../9", "http://ex.com/en/casino/", "http://ÉX.com/en/\n",
]


def plain_judge(u):
    if u is None or "://" not in u:
        return "", "", None
    rest = u.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for r in URL_RULES:
        h, _, p = r.text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r.text) > len(best.text)):
            best = r
    return host, path, best


def test_url_rules(spark):
    df = spark.createDataFrame(list(enumerate(URLS)) + [(99, URLS[0])], "page_id long, url string").withColumn("host", F.lit(1)).withColumn("verdict", F.lit("x"))
    got = {r["page_id"]: r for r in urlrules.judge(df, URL_RULES).collect()}
    for k, u in enumerate(URLS):
        host, path, best = plain_judge(u)
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, best and best.text), u
        if best:
            assert got[k]["verdict"] == best.verdict
    assert got[14]["verdict"] == "block" and got[14]["rule"] is None and got[10]["verdict"] == "allow"
    assert got[99][1:] == got[0][1:]
    assert urlrules.judge(df.filter("false"), URL_RULES).count() == 0


def test_only_candidates_run(spark):
    rules = [urlrules.Rule("block", f"host{k}.test/a/") for k in range(500)]
    df = spark.createDataFrame([(k, f"http://host{k}.test/a/b") for k in range(500)], "page_id long, url string")
    got = urlrules.judge(df, rules, ()).collect()
    assert all(r["rule"] == f"host{r['page_id']}.test/a/" and r["n_candidates"] == 1 for r in got)
