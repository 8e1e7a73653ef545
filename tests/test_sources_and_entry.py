"""Readers of small files written here, the stream against the batch, and the registered queries against their SQL."""

import gzip

import pytest

from loomgrid.plans import catalogue
from loomgrid.sources import readers
from loomgrid.streaming import bins

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_reads_with_comments_and_aliases(spark, tmp_path):
    with gzip.open(tmp_path / "r.tsv.gz", "wt") as f:
        f.write("#made by hand\ngeneID\tx\ty\tMIDCounts\tEXONIC\tINTRONIC\nA\t1\t2\t3\t2\t1\nB\t4\t5\t6\t6\t0\n")
    got = [tuple(r) for r in readers.reads_tsv(spark, str(tmp_path / "r.tsv.gz")).orderBy("gene").collect()]
    assert got == [("A", 1, 2, 3, 2, 1), ("B", 4, 5, 6, 6, 0)]
    (tmp_path / "twice.tsv").write_text("geneID\tx\ty\tMIDCount\tUMICount\nA\t1\t2\t3\t4\n")
    with pytest.raises(ValueError, match="total"):
        readers.reads_tsv(spark, str(tmp_path / "twice.tsv"))


def test_matrix_market_with_dictionaries(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n% note\n2 2 3\n1 1 5\n2 1 1\n2 2 7\n")
    (tmp_path / "f.tsv").write_text("n1\tg1\nn2\tg2\n")
    (tmp_path / "b.tsv").write_text("c1\nc2\n")
    m = readers.matrix_market(spark, str(tmp_path / "m.mtx"))
    x = readers.counts_from_market(m, readers.numbered_lines(spark, str(tmp_path / "f.tsv"), ["gene_name", "gene_id"]), readers.numbered_lines(spark, str(tmp_path / "b.tsv"), ["barcode"]))
    assert sorted(tuple(r) for r in x.collect()) == [("c1", "g1", 5.0), ("c1", "g2", 1.0), ("c2", "g2", 7.0)]
    with pytest.raises(ValueError, match="c2"):
        readers.with_positions(x, spark.createDataFrame([("c1", 1.0)], "barcode string, x double"))


def test_wide_tables_and_positions(spark, tmp_path):
    (tmp_path / "w.tsv").write_text("gene\tc1\tc.2\nA\t0\t2\nB\t3\t0\n")
    assert sorted(tuple(r) for r in readers.wide_counts(spark, str(tmp_path / "w.tsv")).collect()) == [("c.2", "A", 2.0), ("c1", "B", 3.0)]
    (tmp_path / "beads.csv").write_text("barcode,x,y\nb1,1.5,2\nb2,3,4\n")
    assert sorted(tuple(r) for r in readers.bead_positions(spark, str(tmp_path / "beads.csv")).collect()) == [("b1", 1.5, 2.0), ("b2", 3.0, 4.0)]
    (tmp_path / "pos.txt").write_text("b1 1  2 30 40\n")
    assert tuple(readers.whitespace_positions(spark, str(tmp_path / "pos.txt")).first()) == ("b1", 1, 2, 30, 40)
    cells = spark.createDataFrame([(1, 1, 1.5, 2.0), (2, 1, 1.0, 1.0)], "fov int, cell_id int, x double, y double")
    offsets = spark.createDataFrame([(1, 10.0, 0.0), (2, 5.0, 1.0)], "fov int, x_offset double, y_offset double")
    assert sorted((r["fov"], r["x"], r["y"]) for r in readers.frames_of_view(cells, offsets, accumulate=True).collect()) == [(1, 11, 2), (2, 16, 2)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, g string")
    for kind in ("parquet", "csv", "json"):
        readers.write_table(df, str(tmp_path / kind), kind, ["g"])
        assert spark.read.format(kind).option("header", True).load(str(tmp_path / kind)).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    stream = bins.event_stream(spark, d, "events.parquet")
    got = bins.run_once(bins.windowed_counts(stream), "daily", str(tmp_path / "c"))
    want = bins.windowed_counts(spark.read.parquet(f"{d}/events.parquet"))
    key = lambda df: sorted((r["start"], r["event_type"], r["n"], round(r["total"], 4)) for r in df.collect())
    assert key(got) == key(want)


def shown(v):
    return repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", ["marker_features", "knn_graph", "moran_i", "normalize_total", "close_open", "adjusted_rand", "best_matches"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    df = catalogue.queries()[name](spark, d)
    r = con.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(shown(row[names.index(c)]) for c in sorted(names)) for row in r.fetchall())
    assert sorted(tuple(shown(row[c]) for c in sorted(names)) for row in df.collect()) == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 70


def test_filters_reach_the_scan(spark):
    plan = catalogue.queries()["pricing_summary"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThanOrEqual(l_shipdate" in plan and "l_comment" not in plan
