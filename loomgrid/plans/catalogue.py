"""The registered queries over the test tables, with the SQL that gives the same rows.

The tables have no cells or genes; order lines stand for counts (order x supplier), parts for points in the plane, events
for a small dense matrix (user x type), embeddings for vectors. Rounded doubles are compared to six places.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import differential, geometry, graph, iterate, labels, learn, matrix, raster, regress, segment, spatial, windows
from ..functions.session import shared_folder
from ..sources import readers
from ..streaming import bins as stream_bins

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rd(c: Column | str, places: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, places) + F.lit(0.0)


def shown(df: DataFrame, *names: str) -> DataFrame:
    """Doubles rounded for comparison."""
    kinds = dict(df.dtypes)
    return df.select(*[(rd(c).alias(c) if kinds[c] in ("double", "float") else F.col(f"`{c}`")) for c in names or df.columns])


# Adapters: the test tables as the engine's inputs, and the same as SQL.


def counts(spark: SparkSession, d: str) -> DataFrame:
    return matrix.from_reads(t(spark, d, "lineitem"), "l_orderkey", "l_suppkey", "l_quantity")


def groups(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("obs"), F.col("o_orderpriority").alias("group"))


def points(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 20).alias("y"))


def small(spark: SparkSession, d: str) -> DataFrame:
    return matrix.from_reads(t(spark, d, "events"), "user_id", "event_type")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("ligand"))
    return s.withColumn("receptor", F.col("ligand") + 7)


def square_grid(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "part").groupBy((F.col("p_size") % 20).cast("long").alias("x"), (F.col("p_partkey") % 15).alias("y")).agg(F.count("*").cast("double").alias("v"))
    full = spark.range(20).select(F.col("id").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(14).cast("long"))).alias("y"))
    return full.join(c, ["x", "y"], "left").select("x", "y", F.coalesce("v", F.lit(0.0)).alias("v"))


def part_edges(spark: SparkSession, d: str, k: int = 5) -> DataFrame:
    return graph.knn(points(spark, d), k).withColumn("w", F.lit(1.0))


X = "x AS (SELECT l_orderkey AS obs, l_suppkey AS feature, SUM(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"
N = "n AS (SELECT CAST(COUNT(DISTINCT obs) AS DOUBLE) AS n FROM x)"
G = 'g AS (SELECT o_orderkey AS obs, o_orderpriority AS "group" FROM orders)'
E = "x AS (SELECT user_id AS obs, event_type AS feature, CAST(COUNT(*) AS DOUBLE) AS value FROM events GROUP BY 1, 2)"
FULL = "d AS (SELECT o.obs, f.feature, COALESCE(x.value, 0.0) AS value FROM (SELECT DISTINCT obs FROM x) o CROSS JOIN (SELECT DISTINCT feature FROM x) f LEFT JOIN x USING (obs, feature))"
P = "p AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, p_retailprice / 20 AS y FROM part)"
ALL_D = "a AS (SELECT s.id AS src, t.id AS dst, SQRT((s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y)) AS dist FROM p s JOIN p t ON s.id <> t.id)"


def knn_sql(k: int) -> str:
    return f"{P}, {ALL_D}, e AS (SELECT src, dst, dist, CAST(r AS INTEGER) AS rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY src ORDER BY dist, dst) AS r FROM a) WHERE r <= {k})"


FS = f"{X}, {N}, fs AS (SELECT feature, COUNT(*) FILTER (value > 0) AS k, SUM(value) AS s, SUM(value * value) AS q, ANY_VALUE(n) AS n FROM x, n GROUP BY 1), st AS (SELECT feature, k, s, s / n AS mean, (q / n - (s / n) * (s / n)) * n / (n - 1) AS var, n FROM fs)"
C = "+ 0.0"


# Matrix


@query("SELECT FLOOR(p_size / 5.0)::BIGINT AS bx, FLOOR(p_retailprice / 100.0)::BIGINT AS by, CAST(SUM(p_size) AS BIGINT) AS total FROM part GROUP BY 1, 2")
def bin_aggregate(spark, d):
    p = t(spark, d, "part")
    return p.groupBy(matrix.bin_index(F.col("p_size"), 0, 5).alias("bx"), matrix.bin_index(F.col("p_retailprice"), 0, 100).alias("by")).agg(F.sum("p_size").alias("total"))


@query("SELECT FLOOR(l_suppkey / 10.0)::BIGINT AS bx, FLOOR(l_linenumber / 2.0)::BIGINT AS by, SUM(l_quantity) AS total, SUM(CASE WHEN l_returnflag IN ('A', 'R') THEN l_quantity ELSE 0 END) AS listed FROM lineitem GROUP BY 1, 2")
def bin_listed_features(spark, d):
    li = t(spark, d, "lineitem").withColumns({"sx": F.col("l_suppkey") * 2, "sy": F.col("l_linenumber") * 10})
    return matrix.bin_reads(li, "sx", "sy", "l_quantity", 20, "l_returnflag", ["A", "R"])


@query("SELECT DISTINCT b AS bx, c AS by, CAST(25 AS BIGINT) AS area, b * 5 AS min_x, (b + 1) * 5 AS max_x, c * 5 AS min_y, (c + 1) * 5 AS max_y, b * 5 + 2.5 AS centre_x, c * 5 + 2.5 AS centre_y FROM (SELECT FLOOR(p_size / 5.0)::BIGINT AS b, FLOOR(p_retailprice / 20 / 5)::BIGINT AS c FROM part)")
def bin_properties(spark, d):
    p = points(spark, d)
    return matrix.bin_properties(p.select(matrix.bin_index(F.col("x"), 0, 5).alias("bx"), matrix.bin_index(F.col("y"), 0, 5).alias("by")), size=5)


@query("SELECT l_orderkey AS obs, l_suppkey AS feature, SUM(l_quantity) AS value FROM lineitem GROUP BY 1, 2")
def coo_from_reads(spark, d):
    return counts(spark, d)


@query(f"WITH {X} SELECT FLOOR(obs / 100.0)::BIGINT AS i, FLOOR(feature / 10.0)::BIGINT AS j, SUM(value) AS v FROM x GROUP BY 1, 2")
def bin_matrix(spark, d):
    return matrix.bin_matrix(counts(spark, d).select((F.col("obs") / 10).alias("i"), F.col("feature").alias("j"), F.col("value").alias("v")), 10)


@query("SELECT user_id, event_type AS obs, COUNT(*) AS value FROM events WHERE event_type IN ('click', 'error', 'view') GROUP BY 1, 2")
def melt_drop_zero(spark, d):
    kinds = ["click", "error", "view"]
    wide = t(spark, d, "events").groupBy("user_id").pivot("event_type", kinds).count().na.fill(0)
    return matrix.melt(wide, ["user_id"], kinds)


@query(f"WITH {X}, c AS (SELECT obs, COUNT(*) FILTER (value > 0) AS n_features FROM x GROUP BY 1) SELECT obs, n_features FROM c WHERE n_features BETWEEN 3 AND 6")
def filter_obs(spark, d):
    return matrix.filter_obs(counts(spark, d), 3, 6)


@query(f"WITH {FS} SELECT feature, k AS n_expressed, s AS total, ROUND(mean, 6) AS mean FROM st WHERE k >= 550 AND mean <= 1.1")
def filter_features(spark, d):
    return shown(matrix.filter_features(counts(spark, d), 550, max_mean=1.1), "feature", "n_expressed", "total", "mean")


@query(f"WITH {P} SELECT id FROM p WHERE x >= 10 AND x <= 30 AND NOT (y > 80) AND y <> 50")
def filter_instructions(spark, d):
    return matrix.filter_by_instructions(matrix.in_range(points(spark, d), (10, 30), (0, 1e9)), ["not (height greater than 80)", "height is not equal to 50"], {"height": "y"}).select("id")


@query(f"WITH {FS} SELECT feature, ROUND(k / n, 6) AS positive_ratio FROM st WHERE k / n > 0.038")
def positive_ratio(spark, d):
    return shown(matrix.feature_stats(counts(spark, d)).filter("positive_ratio > 0.038"), "feature", "positive_ratio")


@query(f"WITH {X}, s AS (SELECT obs, SUM(value) AS s FROM x GROUP BY 1), m AS (SELECT POWER(10.0, CEIL(LOG10(AVG(s)))) AS goal FROM s) SELECT obs, feature, ROUND(value * goal / s, 6) {C} AS value FROM x JOIN s USING (obs), m")
def normalize_total(spark, d):
    return shown(matrix.normalize_total(counts(spark, d)))


@query(f"WITH {E}, s0 AS (SELECT obs, SUM(value) AS s FROM x GROUP BY 1), hi AS (SELECT DISTINCT feature FROM x JOIN s0 USING (obs) WHERE value > s * 0.55), s AS (SELECT o.obs, COALESCE(SUM(x.value), 0.0) AS s FROM s0 o LEFT JOIN (SELECT * FROM x WHERE feature NOT IN (SELECT feature FROM hi)) x USING (obs) GROUP BY 1) SELECT obs, feature, ROUND(value * 100 / CASE WHEN s = 0 THEN 1.0 ELSE s END, 6) {C} AS value FROM x JOIN s USING (obs)")
def normalize_excluding_high(spark, d):
    return shown(matrix.normalize_total(small(spark, d), 100, 0.55))


@query(f"WITH {X} SELECT obs, feature, ROUND(LN(1 + value) / LN(2.0), 6) AS value FROM x")
def log1p_base2(spark, d):
    return shown(matrix.log1p(counts(spark, d), 2))


@query(f"WITH {FS} SELECT obs, feature, ROUND(LEAST(value / CASE WHEN var > 0 THEN SQRT(var) ELSE 1.0 END, 6.0), 6) {C} AS value FROM x JOIN st USING (feature)")
def scale_sparse(spark, d):
    return shown(matrix.scale(counts(spark, d), centre=False, most=6))


@query(f"WITH {E}, {FULL}, s AS (SELECT feature, AVG(value) AS m, STDDEV_SAMP(value) AS sd FROM d GROUP BY 1) SELECT obs, feature, ROUND((value - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 6) {C} AS value FROM d JOIN s USING (feature)")
def scale_dense(spark, d):
    return shown(matrix.scale(small(spark, d)))


@query(f"WITH {E}, s AS (SELECT obs, SUM(value) AS s FROM x GROUP BY 1), m AS (SELECT MEDIAN(s) AS goal FROM s WHERE s > 0) SELECT obs, feature, ROUND(value * goal / s, 6) {C} AS value FROM x JOIN s USING (obs), m")
def scale_to_median(spark, d):
    return shown(matrix.scale_to(small(spark, d)))


@query(f"WITH {E}, {FULL}, s AS (SELECT feature, MIN(value) AS lo, MAX(value) AS hi FROM d GROUP BY 1) SELECT obs, feature, ROUND((value - lo) / (hi - lo), 6) {C} AS value FROM x JOIN s USING (feature)")
def feature_min_max(spark, d):
    return shown(matrix.feature_min_max(small(spark, d)))


@query(f"WITH {E}, {FULL}, r AS (SELECT obs, SUM(value) AS r FROM x GROUP BY 1), c AS (SELECT feature, SUM(value) AS c FROM x GROUP BY 1), tt AS (SELECT SUM(value) AS t, CAST(COUNT(DISTINCT obs) AS DOUBLE) AS n FROM x), z AS (SELECT obs, feature, n, (value - r * c / t) / SQRT(r * c / t + (r * c / t) * (r * c / t) / 100) AS z FROM d JOIN r USING (obs) JOIN c USING (feature), tt) SELECT obs, feature, ROUND(GREATEST(-SQRT(n), LEAST(SQRT(n), z)), 6) {C} AS value FROM z")
def pearson_residuals(spark, d):
    return shown(matrix.pearson_residuals(small(spark, d)))


@query(f"WITH {FS} SELECT feature, k AS n_expressed, s AS total, ROUND(mean, 6) AS mean, ROUND(var, 6) AS var FROM st")
def feature_mean_var(spark, d):
    return shown(matrix.feature_stats(counts(spark, d)), "feature", "n_expressed", "total", "mean", "var")


@query(f"WITH {X}, {G}, n AS (SELECT \"group\" AS batch, CAST(COUNT(*) AS DOUBLE) AS n FROM g GROUP BY 1), s AS (SELECT feature, \"group\" AS batch, SUM(value) AS s, SUM(value * value) AS q FROM x JOIN g USING (obs) GROUP BY 1, 2) SELECT batch, feature, n, ROUND(s / n, 6) AS mean, ROUND(q - s * s / n, 6) AS ss FROM s JOIN n USING (batch)")
def batch_statistics(spark, d):
    return shown(matrix.batch_stats(counts(spark, d), groups(spark, d).toDF("obs", "batch")), "batch", "feature", "n", "mean", "ss")


@query(
    f"WITH {X}, sc AS (SELECT obs, SUM(value) AS s FROM x GROUP BY 1), y AS (SELECT obs, feature, value * 100 / s AS value FROM x JOIN sc USING (obs)), {N.replace('FROM x', 'FROM y')}, "
    "fs AS (SELECT feature, SUM(value) AS s, SUM(value * value) AS q FROM y GROUP BY 1), st AS (SELECT feature, s / n AS mean, (q / n - (s / n) * (s / n)) * n / (n - 1) AS var FROM fs, n), "
    "b AS (SELECT feature, LN(1 + mean) AS m, LN(var / mean) AS d FROM st), c AS (SELECT *, GREATEST(CEIL((m - MIN(m) OVER ()) / (MAX(m) OVER () - MIN(m) OVER ()) * 20), 1) AS bin FROM b), "
    "z AS (SELECT feature, m, d, COALESCE(CASE WHEN STDDEV_SAMP(d) OVER (PARTITION BY bin) > 0 THEN (d - AVG(d) OVER (PARTITION BY bin)) / STDDEV_SAMP(d) OVER (PARTITION BY bin) ELSE 0 END, 0) AS z FROM c) "
    f"SELECT feature, ROUND(m, 6) AS m, ROUND(d, 6) {C} AS d, ROUND(z, 5) {C} AS z FROM z"
)
def variable_features(spark, d):
    out = matrix.variable_features(matrix.log1p(matrix.normalize_total(counts(spark, d), 100)))
    return out.select("feature", rd("m").alias("m"), rd("d").alias("d"), rd("z", 5).alias("z"))


@query(f"WITH {FS} SELECT feature, ROUND(var * (n - 1) / n / mean, 6) AS fano, ROUND(SQRT(var * (n - 1) / n) / mean, 6) AS cv FROM st")
def fano_factors(spark, d):
    return shown(matrix.fano_factors(counts(spark, d)), "feature", "fano", "cv")


@query(f"WITH {E}, {FULL} SELECT obs, ROUND(QUANTILE_CONT(value, 0.75) / SUM(value), 6) AS factor FROM d GROUP BY 1")
def size_factor_quantile(spark, d):
    return shown(matrix.factor_quantile(small(spark, d)))


@query(f"WITH {E}, {N}, gm AS (SELECT feature, EXP(AVG(LN(value))) AS gm FROM x, n GROUP BY feature, n HAVING COUNT(*) = n) SELECT obs, ROUND(MEDIAN(value / gm), 6) AS factor FROM x JOIN gm USING (feature) GROUP BY 1")
def size_factor_rle(spark, d):
    return shown(matrix.factor_rle(small(spark, d)))


@query(
    f"WITH {E}, l AS (SELECT obs, SUM(value) AS n FROM x GROUP BY 1), j AS (SELECT x.obs, x.feature, x.value AS v, l.n, r.value AS rv, (SELECT n FROM l WHERE obs = 1) AS rn FROM x JOIN l USING (obs) JOIN x r ON r.obs = 1 AND r.feature = x.feature), "
    "m AS (SELECT obs, feature, LOG2((v / n) / (rv / rn)) AS m, (LOG2(v / n) + LOG2(rv / rn)) / 2 AS a, (n - v) / n / v + (rn - rv) / rn / rv AS w FROM j), "
    "k AS (SELECT *, COUNT(*) OVER (PARTITION BY obs) AS c, ROW_NUMBER() OVER (PARTITION BY obs ORDER BY m, feature) AS rm, ROW_NUMBER() OVER (PARTITION BY obs ORDER BY a, feature) AS ra FROM m) "
    "SELECT obs, ROUND(POWER(2.0, COALESCE(SUM(m / w) / SUM(1 / w), 0)), 6) AS factor FROM k WHERE rm >= FLOOR(c * 0.3) + 1 AND ra >= FLOOR(c * 0.05) + 1 GROUP BY 1"
)
def size_factor_tmm(spark, d):
    return shown(matrix.factor_tmm(small(spark, d), 1))


@query(f"WITH {X} SELECT obs, ROUND(LN(SUM(value)), 6) AS \"offset\" FROM x GROUP BY 1")
def library_offset(spark, d):
    return shown(matrix.library_offset(counts(spark, d)))


@query(f"WITH {P}, b AS (SELECT MIN(x) AS x0, MAX(x) AS x1, MIN(y) AS y0, MAX(y) AS y1 FROM p) SELECT id, ROUND(((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / SQRT((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)), 6) AS along FROM p, b")
def diagonal_coordinate(spark, d):
    return shown(matrix.diagonal_coordinate(points(spark, d)), "id", "along")


@query(f"WITH {P}, k AS (SELECT id, ROW_NUMBER() OVER (ORDER BY y, id) AS rn, FLOOR(COUNT(*) OVER () / 7) AS k FROM p) SELECT id, CAST(FLOOR((rn - 1) / k) AS INTEGER) AS slice FROM k WHERE FLOOR((rn - 1) / k) < 7")
def split_slices(spark, d):
    return matrix.split_slices(points(spark, d), "y", 7, "id").select("id", "slice")


@query("SELECT n_nationkey, n_regionkey, CAST(COALESCE(SUM(n_regionkey) OVER (ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM nation")
def running_offset(spark, d):
    n = t(spark, d, "nation").select("n_nationkey", "n_regionkey")
    return matrix.running_offset(n, "n_nationkey", "n_regionkey").withColumn("offset", F.col("offset").cast("long"))


@query("SELECT p_partkey, CAST(FLOOR(LEAST(p_retailprice, (SELECT QUANTILE_CONT(p_retailprice, 0.997) FROM part))) AS BIGINT) AS p_retailprice FROM part")
def winsor_floor(spark, d):
    return matrix.winsor_floor(t(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice")


@query("SELECT s_suppkey AS id, s_acctbal AS a, 0.0 AS b, 's' AS batch FROM supplier UNION ALL SELECT c_custkey, 0.0, c_acctbal, 'c' FROM customer")
def integrate_batches(spark, d):
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("a"))
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("b"))
    return matrix.integrate([s, c], ["s", "c"])


# Groups

GS = (
    f"{X}, {G}, gn AS (SELECT \"group\", CAST(COUNT(*) AS DOUBLE) AS n1 FROM g GROUP BY 1), an AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n FROM g), own AS (SELECT feature, \"group\", SUM(value) AS s1, COUNT(*) FILTER (value > 0) AS k1 FROM x JOIN g USING (obs) GROUP BY 1, 2), "
    "tot AS (SELECT feature, SUM(s1) AS s, SUM(k1) AS k FROM own GROUP BY 1), gs AS (SELECT feature, \"group\", k1 / n1 AS fraction, (k - k1) / (n - n1) AS other_fraction, s1 / n1 AS mean, (s - s1) / (n - n1) AS other_mean, LOG2((s1 / n1 + 1e-9) / ((s - s1) / (n - n1) + 1e-9) + 1e-4) AS log2fc FROM own JOIN gn USING (\"group\") JOIN tot USING (feature), an)"
)
MW = (
    "pv AS (SELECT feature, \"group\", value FROM x JOIN g USING (obs) WHERE value > 0), rk AS (SELECT feature, \"group\", value, n - COUNT(*) OVER (PARTITION BY feature) + RANK() OVER (PARTITION BY feature ORDER BY value) - 1 + (COUNT(*) OVER (PARTITION BY feature, value) + 1) / 2.0 AS r, COUNT(*) OVER (PARTITION BY feature, value) AS c FROM pv, an), "
    "ti AS (SELECT feature, SUM(CAST(c AS DOUBLE) * c - 1) AS t, COUNT(*) AS pos FROM rk GROUP BY 1), rs AS (SELECT feature, \"group\", SUM(r) AS r, COUNT(*) AS k1 FROM rk GROUP BY 1, 2), "
    "u AS (SELECT feature, \"group\", r + (n1 - k1) * (n - pos + 1) / 2 - n1 * (n1 + 1) / 2 AS u, n1, n - n1 AS n2, n, t + (n - pos) * (n - pos) * (n - pos) - (n - pos) AS tie FROM rs JOIN ti USING (feature) JOIN gn USING (\"group\"), an), "
    "mw AS (SELECT feature, \"group\", u, SIGN(u - n1 * n2 / 2) * GREATEST(ABS(u - n1 * n2 / 2) - 0.5, 0) / SQRT(n1 * n2 / 12 * (n + 1 - tie / (n * (n - 1)))) AS z FROM u)"
)
PV = "(0.254829592 * t + -0.284496736 * t * t + 1.421413741 * t * t * t + -1.453152027 * t * t * t * t + 1.061405429 * t * t * t * t * t) * EXP(-z * z / 2)"
MWP = f"mp AS (SELECT feature, \"group\", u, z, {PV} AS p FROM (SELECT *, 1 / (1 + 0.3275911 * ABS(z) / SQRT(2.0)) AS t FROM mw))"


@query(f"WITH {GS} SELECT feature, \"group\", ROUND(fraction, 6) AS fraction, ROUND(other_fraction, 6) AS other_fraction, ROUND(mean, 6) AS mean, ROUND(other_mean, 6) AS other_mean, ROUND(log2fc, 6) {C} AS log2fc FROM gs")
def group_statistics(spark, d):
    return shown(differential.group_stats(counts(spark, d), groups(spark, d)))


@query(f"WITH {GS}, {MW}, {MWP} SELECT feature, \"group\", ROUND(u, 3) AS u, ROUND(z, 6) {C} AS z, ROUND(p, 5) AS p FROM mp")
def mann_whitney(spark, d):
    m = differential.mann_whitney(counts(spark, d), groups(spark, d))
    return m.select("feature", "group", rd("u", 3).alias("u"), rd("z").alias("z"), rd("p", 5).alias("p"))


@query(f"WITH {GS}, {MW}, k AS (SELECT feature, \"group\", fraction, log2fc, fraction / SUM(fraction) OVER (PARTITION BY feature) AS sp FROM gs), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY \"group\" ORDER BY log2fc DESC, feature) AS rank FROM k) SELECT feature, \"group\", ROUND(fraction, 6) AS fraction, ROUND(log2fc, 6) {C} AS log2fc, ROUND(sp, 6) AS specificity, ROUND(z, 6) {C} AS z, CAST(rank AS INTEGER) AS rank FROM r JOIN mw USING (feature, \"group\") WHERE rank <= 10")
def marker_features(spark, d):
    return shown(differential.markers(counts(spark, d), groups(spark, d), 10), "feature", "group", "fraction", "log2fc", "specificity", "z", "rank")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marker_features(spark, sf_dir)


@query("WITH v AS (SELECT p_partkey AS id, p_size / 60.0 AS p FROM part), r AS (SELECT *, p * COUNT(*) OVER () / ROW_NUMBER() OVER (ORDER BY p, id) AS raw FROM v) SELECT id, ROUND(LEAST(MIN(raw) OVER (ORDER BY p DESC, id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1.0), 6) AS q FROM r")
def false_discovery(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 60.0).alias("p"))
    return shown(differential.benjamini_hochberg(p, "p", None, ["id"]), "id", "q")


@query(
    f"WITH {X}, ty AS (SELECT o_orderkey AS obs, o_orderstatus AS type FROM orders), n AS (SELECT type, CAST(COUNT(*) AS DOUBLE) AS n FROM ty GROUP BY 1), s AS (SELECT feature, type, SUM(value) AS s, SUM(value * value) AS q FROM x JOIN ty USING (obs) GROUP BY 1, 2), k AS (SELECT feature, SUM(s) AS ts, SUM(q) AS tq, SUM(s * s / n) AS b FROM s JOIN n USING (type) GROUP BY 1) "
    'SELECT feature, ROUND(tq - b, 4) AS within, ROUND(b - ts * ts / (SELECT COUNT(*) FROM ty), 4) AS "between", ROUND(tq - ts * ts / (SELECT COUNT(*) FROM ty), 4) AS total FROM k'
)
def variance_parts(spark, d):
    types = t(spark, d, "orders").select(F.col("o_orderkey").alias("obs"), F.col("o_orderstatus").alias("type"))
    v = differential.variance_parts(counts(spark, d), types)
    return v.select("feature", *[rd(c, 4).alias(c) for c in ("within", "between", "total")])


# Graphs


@query(f"WITH {knn_sql(5)} SELECT src, dst, ROUND(dist, 6) AS dist, rank FROM e")
def knn_graph(spark, d):
    return shown(graph.knn(points(spark, d), 5))


@query("WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), a AS (SELECT s.id AS src, t.id AS dst, LIST_DISTANCE(s.v, t.v) AS dist FROM v s JOIN v t ON s.id <> t.id) SELECT src, dst, ROUND(dist, 5) AS dist FROM a QUALIFY ROW_NUMBER() OVER (PARTITION BY src ORDER BY dist, dst) <= 10")
def knn_vectors(spark, d):
    return graph.knn_vectors(vectors(spark, d), 10, block=512).select("src", "dst", rd("dist", 5).alias("dist"))


@query(f"WITH {P}, {ALL_D} SELECT src, COUNT(*) AS n, ROUND(SUM(dist), 5) AS total FROM a WHERE dist <= 2.5 GROUP BY 1")
def radius_join(spark, d):
    return graph.neighbour_sums(points(spark, d), 2.5).select("src", "n", rd("total", 5).alias("total"))


@query(f"WITH {knn_sql(4)} SELECT src, dst, ROUND(MAX(dist), 6) AS dist FROM (SELECT src, dst, dist FROM e UNION ALL SELECT dst, src, dist FROM e) GROUP BY 1, 2")
def knn_symmetric(spark, d):
    return shown(graph.symmetric(graph.knn(points(spark, d), 4)))


KW = "k AS (SELECT src, dst, dist, MAX(CASE WHEN r <= 4 THEN dist END) OVER (PARTITION BY src) * 1.0000001 AS bw FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY src ORDER BY dist, dst) AS r FROM e))"


@query(f"WITH {knn_sql(8)}, {KW} SELECT src, dst, ROUND(w / COUNT(*) OVER (PARTITION BY src), 6) AS w FROM (SELECT src, dst, CASE WHEN bw = 0 THEN CAST(dist = 0 AS INTEGER) WHEN dist / bw <= 1 THEN (1 - (dist / bw) * (dist / bw)) * (1 - (dist / bw) * (dist / bw)) ELSE 0 END AS w FROM k) WHERE w >= 1e-5")
def kernel_weights(spark, d):
    return shown(graph.kernel_weights(graph.knn(points(spark, d), 8), "bisquare", k=4, normalize=True), "src", "dst", "w")


@query(f"WITH {knn_sql(6)}, s AS (SELECT src, MAX(dist) AS s FROM e GROUP BY 1) SELECT e.src, e.dst, ROUND(EXP(-(e.dist * e.dist) / (a.s * b.s)), 6) AS w FROM e JOIN s a ON a.src = e.src JOIN s b ON b.src = e.dst WHERE a.s * b.s <> 0")
def affinity(spark, d):
    return shown(graph.affinity(graph.knn(points(spark, d), 6), 6))


@query(f"WITH {knn_sql(10)} SELECT ROUND(MAX(m + 3 * SQRT(GREATEST(q - m * m, 0))), 6) AS threshold FROM (SELECT SUM(dist) / 11 AS m, SUM(dist * dist) / 11 AS q FROM e GROUP BY src)")
def threshold_distance(spark, d):
    return shown(graph.threshold_distance(graph.knn(points(spark, d), 10)))


@query(f"WITH x AS (SELECT user_id AS obs, event_id % 40 AS feature FROM events GROUP BY 1, 2), c AS (SELECT obs, COUNT(*) AS n FROM x GROUP BY 1) SELECT a, b, ROUND(k / (ca.n + cb.n - k), 6) AS jaccard FROM (SELECT l.obs AS a, r.obs AS b, COUNT(*) AS k FROM x l JOIN x r ON l.feature = r.feature AND l.obs < r.obs GROUP BY 1, 2) JOIN c ca ON ca.obs = a JOIN c cb ON cb.obs = b WHERE k / (ca.n + cb.n - k) >= 0.6")
def jaccard_pairs(spark, d):
    x = t(spark, d, "events").select(F.col("user_id").alias("obs"), (F.col("event_id") % 40).alias("feature")).distinct().withColumn("value", F.lit(1.0))
    return shown(graph.jaccard_runs(x, 0.6)).select("a", F.explode("bs").alias("b"), "jaccard")  # rounded by run, not by pair


@query(f"WITH {knn_sql(4)}, y AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), dg AS (SELECT src, COUNT(*) AS d FROM y GROUP BY 1) SELECT y.src, y.dst, ROUND(1 / SQRT(a.d * b.d), 6) AS w FROM y JOIN dg a ON a.src = y.src JOIN dg b ON b.src = y.dst")
def normalized_adjacency(spark, d):
    return shown(graph.normalized_adjacency(graph.symmetric(graph.knn(points(spark, d), 4))))


PX = "q AS (SELECT l_partkey AS obs, l_suppkey % 10 AS feature, SUM(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"


def part_counts(spark: SparkSession, d: str) -> DataFrame:
    return matrix.from_reads(t(spark, d, "lineitem").withColumn("f", F.col("l_suppkey") % 10), "l_partkey", "f", "l_quantity")


@query(f"WITH {knn_sql(5)}, {PX} SELECT e.src AS obs, feature, ROUND(SUM(value) / 5, 6) AS value FROM e JOIN q ON q.obs = e.dst GROUP BY 1, 2")
def smooth_graph(spark, d):
    return shown(graph.smooth(part_edges(spark, d), part_counts(spark, d)))


LB = "l AS (SELECT p_partkey AS obs, p_brand AS label FROM part)"


def brands(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select(F.col("p_partkey").alias("obs"), F.col("p_brand").alias("label"))


@query(f"WITH {knn_sql(9)}, {LB}, v AS (SELECT src, label, COUNT(*) AS n, MIN(rank) AS f FROM e JOIN l ON l.obs = e.dst GROUP BY 1, 2) SELECT src AS obs, label FROM v QUALIFY ROW_NUMBER() OVER (PARTITION BY src ORDER BY n DESC, f) = 1")
def label_vote(spark, d):
    return graph.majority_label(graph.knn(points(spark, d), 9), brands(spark, d))


@query(f"WITH {knn_sql(5)}, {LB}, n AS (SELECT label, COUNT(*) AS n FROM l GROUP BY 1) SELECT la, lb, ROUND(s / (a.n * b.n), 8) AS value FROM (SELECT x1.label AS la, x2.label AS lb, COUNT(*) * 1.0 AS s FROM e JOIN l x1 ON x1.obs = src JOIN l x2 ON x2.obs = dst GROUP BY 1, 2) JOIN n a ON a.label = la JOIN n b ON b.label = lb")
def label_connections(spark, d):
    return graph.label_connections(part_edges(spark, d), brands(spark, d)).withColumn("value", F.round("value", 8))


@query(f"WITH RECURSIVE {P}, {ALL_D}, e AS (SELECT src, dst FROM a WHERE dist <= 0.8), r(id, c) AS (SELECT id, id FROM p UNION SELECT e.dst, r.c FROM r JOIN e ON e.src = r.id WHERE r.c < e.dst) SELECT id, MIN(c) AS component FROM r GROUP BY 1")
def connected_components(spark, d):
    return iterate.components_within(points(spark, d), 0.8)


# Spatial statistics

MO = f"{knn_sql(5)}, {PX}, n AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n FROM p), c AS (SELECT feature, SUM(value) / ANY_VALUE(n) AS m, SUM(value * value) - SUM(value) * SUM(value) / ANY_VALUE(n) AS m2 FROM q, n GROUP BY 1), fl AS (SELECT id, f.feature, COALESCE(q.value, 0) - m AS z, m2 FROM p CROSS JOIN c f LEFT JOIN q ON q.obs = p.id AND q.feature = f.feature), mi AS (SELECT a.feature, ANY_VALUE(n) * SUM(a.z * b.z) / (COUNT(*) * ANY_VALUE(a.m2)) AS moran FROM e JOIN fl a ON a.id = e.src JOIN fl b ON b.id = e.dst AND b.feature = a.feature, n GROUP BY 1)"


@query(f"WITH {MO} SELECT feature, ROUND(moran, 6) {C} AS moran FROM mi")
def moran_i(spark, d):
    return shown(spatial.moran_i(part_edges(spark, d), part_counts(spark, d), points(spark, d)), "feature", "moran")


@query(
    f"WITH {MO}, s1 AS (SELECT SUM(w * w) / 2 AS s1 FROM (SELECT src, dst, COUNT(*) AS w FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) GROUP BY 1, 2)), s2 AS (SELECT SUM(t * t) AS s2 FROM (SELECT COUNT(*) AS t FROM (SELECT src AS o FROM e UNION ALL SELECT dst FROM e) GROUP BY o)), s0 AS (SELECT CAST(COUNT(*) AS DOUBLE) AS s0 FROM e), "
    f"v AS (SELECT (n * n * s1 - n * s2 + 3 * s0 * s0) / ((n * n - 1) * s0 * s0) - 1 / ((n - 1) * (n - 1)) AS var, -1 / (n - 1) AS ex FROM n, s0, s1, s2) SELECT feature, ROUND((moran - ex) / SQRT(var), 5) {C} AS z FROM mi, v"
)
def moran_z(spark, d):
    e = part_edges(spark, d)
    return spatial.moran_z(spatial.moran_i(e, part_counts(spark, d), points(spark, d)), e).select("feature", rd("z", 5).alias("z"))


PVAL = "pv AS (SELECT p_partkey AS obs, p_retailprice AS value FROM part), zz AS (SELECT obs, (value - (SELECT AVG(value) FROM pv)) / (SELECT STDDEV_SAMP(value) FROM pv) AS z FROM pv)"


def prices(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select(F.col("p_partkey").alias("obs"), F.col("p_retailprice").alias("value"))


def sizes(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select(F.col("p_partkey").alias("obs"), F.col("p_size").cast("double").alias("value"))


@query(f"WITH {knn_sql(5)}, {PVAL}, l AS (SELECT src AS obs, AVG(z) AS lag FROM e JOIN zz ON zz.obs = e.dst GROUP BY 1) SELECT obs, ROUND(z, 6) {C} AS z, ROUND(lag, 6) {C} AS lag, ROUND(z * lag, 6) {C} AS moran, CASE WHEN z > 0 AND lag > 0 THEN 1 WHEN z <= 0 AND lag > 0 THEN 2 WHEN z <= 0 AND lag <= 0 THEN 3 ELSE 4 END AS quadrant FROM zz JOIN l USING (obs)")
def local_moran(spark, d):
    return shown(spatial.local_moran(part_edges(spark, d), prices(spark, d)))


@query(f"WITH {knn_sql(5)}, za AS (SELECT p_partkey AS obs, (p_retailprice - (SELECT AVG(p_retailprice) FROM part)) / (SELECT STDDEV_POP(p_retailprice) FROM part) AS z FROM part), zb AS (SELECT p_partkey AS obs, (p_size - (SELECT AVG(p_size) FROM part)) / (SELECT STDDEV_POP(p_size) FROM part) AS z FROM part) SELECT ROUND((SELECT SUM(za.z * zb.z / 5) FROM e JOIN za ON za.obs = e.src JOIN zb ON zb.obs = e.dst) / (SELECT SUM(z * z) FROM za), 6) {C} AS moran")
def bivariate_moran(spark, d):
    return shown(spatial.bivariate_moran(part_edges(spark, d), prices(spark, d), sizes(spark, d)))


@query(
    f"WITH {P}, c AS (SELECT b.p_brand AS feature, FLOOR(p.x / 10)::BIGINT AS gx, FLOOR(p.y / 10)::BIGINT AS gy, COUNT(*) AS v FROM p JOIN part b ON b.p_partkey = p.id GROUP BY 1, 2, 3), bx AS (SELECT MIN(gx) AS x0, MAX(gx) AS x1, MIN(gy) AS y0, MAX(gy) AS y1 FROM c), xs AS (SELECT UNNEST(RANGE(x0, x1 + 1)) AS gx FROM bx), ys AS (SELECT UNNEST(RANGE(y0, y1 + 1)) AS gy FROM bx), f AS (SELECT DISTINCT feature FROM c), "
    f"fl AS (SELECT feature, gx, gy, COALESCE(v, 0) - AVG(COALESCE(v, 0)) OVER (PARTITION BY feature) AS z, COUNT(*) OVER (PARTITION BY feature) AS n FROM f CROSS JOIN xs CROSS JOIN ys LEFT JOIN c USING (feature, gx, gy)), m2 AS (SELECT feature, SUM(z * z) AS m2, ANY_VALUE(n) AS n FROM fl GROUP BY 1) SELECT a.feature, ROUND(ANY_VALUE(m2.n) * SUM(a.z * b.z) / (COUNT(*) * ANY_VALUE(m2)), 6) {C} AS moran FROM fl a JOIN fl b ON a.feature = b.feature AND ABS(a.gx - b.gx) + ABS(a.gy - b.gy) = 1 JOIN m2 ON m2.feature = a.feature GROUP BY 1"
)
def lattice_moran(spark, d):
    p = points(spark, d).join(brands(spark, d).withColumnRenamed("obs", "id"), "id")
    return shown(spatial.lattice_moran(p, "label", 10), "feature", "moran")


LR = "lr AS (SELECT s_suppkey AS ligand, s_suppkey + 7 AS receptor FROM supplier)"


@query(f"WITH {X}, {G}, {LR}, n AS (SELECT \"group\", COUNT(*) AS n FROM g GROUP BY 1), m AS (SELECT \"group\", feature, SUM(value) / ANY_VALUE(n) AS m FROM x JOIN g USING (obs) JOIN n USING (\"group\") GROUP BY 1, 2), gp AS (SELECT a.\"group\" AS sender, b.\"group\" AS receiver FROM n a CROSS JOIN n b WHERE a.\"group\" < b.\"group\") SELECT sender, receiver, ligand, receptor, ROUND((COALESCE(l.m, 0) + COALESCE(r.m, 0)) / 2, 6) AS score FROM gp CROSS JOIN lr LEFT JOIN m l ON l.\"group\" = sender AND l.feature = ligand LEFT JOIN m r ON r.\"group\" = receiver AND r.feature = receptor")
def group_pair_scores(spark, d):
    g = groups(spark, d)
    names = g.select("group").distinct()
    gp = names.toDF("sender").join(names.toDF("receiver"), F.col("sender") < F.col("receiver"))
    return shown(spatial.group_pair_scores(counts(spark, d), g, pairs(spark, d), gp), "sender", "receiver", "ligand", "receptor", "score")


PLR = "lr AS (SELECT * FROM (VALUES (0, 7), (3, 4), (5, 1)) v(ligand, receptor))"


def part_pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, 7), (3, 4), (5, 1)], "ligand long, receptor long")


@query(f"WITH {knn_sql(5)}, {PX}, {PLR}, s AS (SELECT src AS obs, feature, SUM(value) AS v FROM e JOIN q ON q.obs = e.dst GROUP BY 1, 2) SELECT l.obs, CAST(ligand AS BIGINT) AS ligand, CAST(receptor AS BIGINT) AS receptor, ROUND(l.v * r.v, 4) AS score FROM lr JOIN s l ON l.feature = ligand JOIN s r ON r.feature = receptor AND r.obs = l.obs")
def niche_scores(spark, d):
    return spatial.niche_scores(part_edges(spark, d), part_counts(spark, d), part_pairs(spark), "n2n").select("obs", "ligand", "receptor", rd("score", 4).alias("score"))


@query(f"WITH {knn_sql(5)}, {PX}, {PLR} SELECT CAST(ligand AS BIGINT) AS ligand, CAST(receptor AS BIGINT) AS receptor, ROUND(SUM(l.value * r.value) / (SELECT COUNT(*) FROM e), 4) AS mean_product, COUNT(*) AS n_both, ROUND(COUNT(*) / (SELECT COUNT(*) FROM e), 6) AS ratio FROM lr JOIN q l ON l.feature = ligand JOIN e ON e.src = l.obs JOIN q r ON r.feature = receptor AND r.obs = e.dst GROUP BY 1, 2")
def coexpression(spark, d):
    return spatial.coexpression(part_edges(spark, d), part_counts(spark, d), part_pairs(spark)).select("ligand", "receptor", rd("mean_product", 4).alias("mean_product"), "n_both", rd("ratio").alias("ratio"))


@query()
def pair_permutation(spark, d):
    return spatial.pair_permutation_p(part_edges(spark, d), part_counts(spark, d), part_pairs(spark), 20)


@query("WITH w AS (SELECT l_suppkey % 20 AS ligand, l_partkey % 50 AS target, SUM(l_quantity) AS weight FROM lineitem GROUP BY 1, 2), v AS (SELECT p_partkey % 50 AS target, AVG(p_retailprice) AS value FROM part GROUP BY 1) SELECT ligand, ROUND(CORR(weight, value), 6) + 0.0 AS r, COUNT(*) AS n FROM w JOIN v USING (target) GROUP BY 1")
def ligand_activity(spark, d):
    w = t(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("ligand"), (F.col("l_partkey") % 50).alias("target")).agg(F.sum("l_quantity").alias("weight"))
    v = t(spark, d, "part").groupBy((F.col("p_partkey") % 50).alias("target")).agg(F.avg("p_retailprice").alias("value"))
    return shown(spatial.ligand_activity(w, v))


@query()
def permuted_moran(spark, d):
    return spatial.permuted_moran(part_edges(spark, d), prices(spark, d), 49)


# Labels

ROWS = "k AS (SELECT p_size % 6 AS a, CASE WHEN p_partkey % 4 = 0 THEN (p_size + 1) % 6 ELSE p_size % 6 END AS b FROM part)"


def two_labels(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part")
    return p.select((F.col("p_size") % 6).alias("la"), F.when(F.col("p_partkey") % 4 == 0, (F.col("p_size") + 1) % 6).otherwise(F.col("p_size") % 6).alias("lb"))


@query(f"WITH {ROWS}, c AS (SELECT a, b, COUNT(*) AS n FROM k GROUP BY 1, 2) SELECT a, b, ROUND(n / (SUM(n) OVER (PARTITION BY a) + SUM(n) OVER (PARTITION BY b) - n), 6) AS iou FROM c")
def label_iou(spark, d):
    return shown(labels.iou(two_labels(spark, d), "la", "lb"))


@query(f"WITH {ROWS}, c AS (SELECT a, b, COUNT(*) AS n FROM k GROUP BY 1, 2), i AS (SELECT a, b, n / (SUM(n) OVER (PARTITION BY a) + SUM(n) OVER (PARTITION BY b) - n) AS iou FROM c), o AS (SELECT COUNT(DISTINCT a) FILTER (a <> 0) AS na, COUNT(DISTINCT b) FILTER (b <> 0) AS nb FROM k) SELECT tau, COUNT(*) FILTER (iou > tau AND a <> 0 AND b <> 0) AS tp, ROUND(COUNT(*) FILTER (iou > tau AND a <> 0 AND b <> 0) / (ANY_VALUE(na) + ANY_VALUE(nb) - COUNT(*) FILTER (iou > tau AND a <> 0 AND b <> 0)), 6) AS ap FROM i, o, (SELECT CAST(UNNEST([0.1, 0.5, 0.9]) AS DOUBLE) AS tau) GROUP BY tau")
def average_precision(spark, d):
    return shown(labels.average_precision(two_labels(spark, d), "la", "lb", [0.1, 0.5, 0.9]))


@query("WITH k AS (SELECT quality = 1 AS q, toxic = 1 AS x FROM labels), c AS (SELECT COUNT(*) FILTER (q AND x) AS tp, COUNT(*) FILTER (NOT q AND x) AS fp, COUNT(*) FILTER (q AND NOT x) AS fn, COUNT(*) FILTER (NOT q AND NOT x) AS tn FROM k) SELECT tp, fp, fn, tn, ROUND(tp / (tp + fn), 6) AS recall, ROUND(tp / (tp + fp), 6) AS precision, ROUND((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, ROUND(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c")
def classification_stats(spark, d):
    return shown(labels.classification_stats(t(spark, d, "labels"), "quality", "toxic"))


@query(f"WITH {ROWS}, c AS (SELECT a, b, COUNT(*) * 1.0 AS n FROM k GROUP BY 1, 2), s AS (SELECT SUM(n * (n - 1) / 2) AS s, SUM(n) AS n FROM c), sa AS (SELECT SUM(m * (m - 1) / 2) AS sa FROM (SELECT SUM(n) AS m FROM c GROUP BY a)), sb AS (SELECT SUM(m * (m - 1) / 2) AS sb FROM (SELECT SUM(n) AS m FROM c GROUP BY b)) SELECT ROUND(CAST(s - sa * sb / (n * (n - 1) / 2) AS DOUBLE) / CAST((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2) AS DOUBLE), 6) AS ari FROM s, sa, sb")
def adjusted_rand(spark, d):
    return shown(labels.adjusted_rand(two_labels(spark, d), "la", "lb"))


@query(f"WITH {ROWS}, c AS (SELECT a, b, CAST(COUNT(*) AS DOUBLE) AS n FROM k GROUP BY 1, 2), w AS (SELECT n, SUM(n) OVER () AS t, SUM(n) OVER (PARTITION BY a) AS na, SUM(n) OVER (PARTITION BY b) AS nb FROM c), h AS (SELECT SUM(-n / t * LN(n / nb)) AS hab, SUM(-n / t * LN(n / na)) AS hba, SUM(-n / t * LN(na / t)) AS ha, SUM(-n / t * LN(nb / t)) AS hb FROM w), v AS (SELECT 1 - hab / ha AS h, 1 - hba / hb AS k FROM h) SELECT ROUND(h, 6) AS homogeneity, ROUND(k, 6) AS completeness, ROUND(2 * h * k / (h + k), 6) AS v FROM v")
def v_measure(spark, d):
    return shown(labels.v_measure(two_labels(spark, d), "la", "lb"))


@query("SELECT b AS label, COUNT(*) AS area, MIN(x) AS min_x, MAX(x) + 1 AS max_x, MIN(y) AS min_y, MAX(y) + 1 AS max_y, ROUND(AVG(x), 6) AS centre_x, ROUND(AVG(y), 6) AS centre_y FROM (SELECT x, y, MAX(l) AS b FROM (SELECT p_size AS x, FLOOR(p_retailprice / 50)::BIGINT AS y, p_partkey % 7 AS l FROM part) WHERE l > 0 GROUP BY 1, 2) GROUP BY 1")
def label_properties(spark, d):
    p = t(spark, d, "part").select(F.col("p_size").alias("x"), F.floor(F.col("p_retailprice") / 50).alias("y"), (F.col("p_partkey") % 7).alias("l"))
    return shown(labels.label_props(labels.label_pixels(p, "l")))


@query("WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), a AS (SELECT s.id AS src, s.label AS ls, t.label AS ld, AVG(LIST_DISTANCE(s.v, t.v)) AS d FROM v s JOIN v t ON s.id <> t.id GROUP BY 1, 2, 3), b AS (SELECT src, MAX(CASE WHEN ls = ld THEN d END) AS a, MIN(CASE WHEN ls <> ld THEN d END) AS b FROM a GROUP BY 1) SELECT ROUND(AVG(COALESCE((b - a) / GREATEST(a, b), 0)), 6) AS silhouette FROM b")
def silhouette(spark, d):
    return shown(labels.silhouette_vectors(vectors(spark, d)))


# Rasters

SG = "px AS (SELECT a.x, b.y, CAST(COALESCE(v, 0) AS DOUBLE) AS v FROM (SELECT UNNEST(RANGE(0, 20)) AS x) a CROSS JOIN (SELECT UNNEST(RANGE(0, 15)) AS y) b LEFT JOIN (SELECT p_size % 20 AS x, p_partkey % 15 AS y, COUNT(*) AS v FROM part GROUP BY 1, 2) c ON c.x = a.x AND c.y = b.y), o AS (SELECT dx, dy FROM (SELECT UNNEST(RANGE(-1, 2)) AS dx) CROSS JOIN (SELECT UNNEST(RANGE(-1, 2)) AS dy)), nb AS (SELECT p.x, p.y, p.v, q.v AS w, dx, dy FROM px p CROSS JOIN o JOIN px q ON q.x = LEAST(GREATEST(p.x + dx, 0), 19) AND q.y = LEAST(GREATEST(p.y + dy, 0), 14))"


@query(f"WITH {SG} SELECT x, y, SUM(w) AS v FROM nb GROUP BY 1, 2")
def conv_square(spark, d):
    return raster.convolve(square_grid(spark, d), 20, 15, 3)


@query(f"WITH {SG}, s AS (SELECT AVG(v) AS m, VAR_POP(v) AS m2 FROM px) SELECT x, y, ROUND((ANY_VALUE(v) - ANY_VALUE(m)) * SUM(w - m) / 8 / ANY_VALUE(m2), 6) {C} AS score FROM nb, s WHERE dx <> 0 OR dy <> 0 GROUP BY 1, 2")
def raster_moran(spark, d):
    return shown(raster.raster_moran(square_grid(spark, d), 20, 15, 3))


MASK = f"{SG}, m AS (SELECT x, y FROM px WHERE v >= 6), c4 AS (SELECT dx, dy FROM o WHERE ABS(dx) + ABS(dy) <= 1)"


@query(
    f"WITH {MASK}, d1 AS (SELECT DISTINCT x + dx AS x, y + dy AS y FROM m CROSS JOIN c4), e1 AS (SELECT x + dx AS x, y + dy AS y FROM d1 CROSS JOIN c4 GROUP BY 1, 2 HAVING COUNT(*) = 5), e2 AS (SELECT x + dx AS x, y + dy AS y FROM e1 CROSS JOIN c4 GROUP BY 1, 2 HAVING COUNT(*) = 5) SELECT DISTINCT x + dx AS x, y + dy AS y FROM e2 CROSS JOIN c4"
)
def close_open(spark, d):
    return raster.close_open(square_grid(spark, d).filter("v >= 6").select("x", "y"), 3)


@query("SELECT value, ROUND(SUM(n) OVER (ORDER BY value) / SUM(n) OVER (), 6) AS share FROM (SELECT p_size AS value, COUNT(*) AS n FROM part GROUP BY 1)")
def distribution_function(spark, d):
    return shown(raster.ecdf(t(spark, d, "part"), "p_size"))


@query("WITH h AS (SELECT CAST(p_size AS DOUBLE) AS v, CAST(COUNT(*) AS DOUBLE) AS n FROM part GROUP BY 1), c AS (SELECT v, SUM(n) OVER (ORDER BY v) AS n0, SUM(n * v) OVER (ORDER BY v) AS s0, SUM(n) OVER () AS nt, SUM(n * v) OVER () AS st FROM h) SELECT v AS cut FROM c WHERE n0 < nt ORDER BY n0 * (nt - n0) * (s0 / n0 - (st - s0) / (nt - n0)) * (s0 / n0 - (st - s0) / (nt - n0)) DESC, v LIMIT 1")
def otsu_cut(spark, d):
    return raster.otsu(t(spark, d, "part"), "p_size")


@query("WITH k AS (SELECT p_partkey AS id, 1 + 99.0 * p_size / 50 AS v FROM part) SELECT id, CASE WHEN off = 0 THEN 1 WHEN CEIL(off) BETWEEN 1 AND 10 THEN CAST(CEIL(off) AS INTEGER) END AS bucket FROM (SELECT id, ROUND((v - 1) / 9.9, 9) AS off FROM k)")
def grid_bucket(spark, d):
    return raster.grid_bucket(potentials(spark, d), "v", 10).select("id", "bucket")


def potentials(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), (1 + 99.0 * F.col("p_size") / 50).alias("v"))


def _jacobi_sql(rounds: int) -> str:
    base = "px AS (SELECT a.x, b.y, CASE WHEN a.x = 0 THEN 1.0 WHEN a.x = 7 THEN 100.0 ELSE 0.0 END AS v FROM (SELECT UNNEST(RANGE(0, 8)) AS x) a CROSS JOIN (SELECT UNNEST(RANGE(0, 6)) AS y) b), j0 AS (SELECT x, y, CAST(v AS DOUBLE) AS v FROM px)"
    for k in range(rounds):
        base += f", j{k + 1} AS (SELECT c.x, c.y, CASE WHEN c.x IN (0, 7) THEN c.v ELSE (COALESCE(n.v, c.v) + COALESCE(s.v, c.v) + COALESCE(e.v, c.v) + COALESCE(w.v, c.v)) / 4 END AS v FROM j{k} c LEFT JOIN j{k} n ON n.x = c.x AND n.y = c.y - 1 LEFT JOIN j{k} s ON s.x = c.x AND s.y = c.y + 1 LEFT JOIN j{k} e ON e.x = c.x + 1 AND e.y = c.y LEFT JOIN j{k} w ON w.x = c.x - 1 AND w.y = c.y)"
    return f"WITH {base} SELECT x, y, ROUND(v, 6) AS v FROM j{rounds}"


@query(_jacobi_sql(6))
def jacobi_field(spark, d):
    px = spark.range(8).select(F.col("id").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("y"), F.lit(0.0).alias("v"))
    fixed = px.filter("x in (0, 7)").withColumn("v", F.when(F.col("x") == 0, 1.0).otherwise(100.0))
    return shown(iterate.jacobi(px, fixed, 6, 0.0, 3))


# Regression: prices against sizes

SP = "s AS (SELECT p_partkey AS id, p_brand AS b, CAST(p_size > 25 AS INTEGER) AS y, p_retailprice / 2000 AS p, p_retailprice / 1000 AS v, p_size / 50.0 + 0.5 AS f FROM part)"


def scored_parts(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("b"), (F.col("p_size") > 25).cast("int").alias("y"), (F.col("p_retailprice") / 2000).alias("p"), (F.col("p_retailprice") / 1000).alias("v"), (F.col("p_size") / 50.0 + 0.5).alias("f"))


@query(f"WITH {SP} SELECT ROUND(AVG(ABS(v - f)), 6) AS mae, ROUND(AVG((v - f) * (v - f)), 6) AS mse FROM s")
def fit_errors(spark, d):
    return shown(regress.errors(scored_parts(spark, d), "v", "f"))


@query(f"WITH {SP}, c AS (SELECT y, GREATEST(1e-7, LEAST(1 - 1e-7, p)) AS p FROM s) SELECT ROUND(-AVG(3 * y * LN(p) + (1 - y) * LN(1 - p)), 6) AS loss FROM c")
def cross_entropy(spark, d):
    return shown(regress.weighted_cross_entropy(scored_parts(spark, d), "y", "p", 1.0, 3.0))


@query(f"WITH {SP}, h AS (SELECT UNNEST([0.5, 0.6, 0.7, 0.8]) AS threshold) SELECT CAST(threshold AS DOUBLE) AS threshold, ROUND(-(COUNT(*) FILTER (p >= threshold AND y = 1) / COUNT(*) FILTER (y = 1) + COUNT(*) FILTER (p < threshold AND y = 0) / COUNT(*) FILTER (y = 0)), 6) AS objective FROM s CROSS JOIN h GROUP BY 1")
def threshold_objective(spark, d):
    return shown(regress.threshold_objective(scored_parts(spark, d), "y", "p", [0.5, 0.6, 0.7, 0.8]))


@query(f"WITH {SP}, g AS (SELECT b, CORR(v, f) AS r, COUNT(*) AS n FROM s GROUP BY 1 HAVING COUNT(*) > 3) SELECT b, n, ROUND((EXP(2 * (ATANH(r) - 1.959963984540054 / SQRT(n - 3))) - 1) / (EXP(2 * (ATANH(r) - 1.959963984540054 / SQRT(n - 3))) + 1), 6) AS low, ROUND((EXP(2 * (ATANH(r) + 1.959963984540054 / SQRT(n - 3))) - 1) / (EXP(2 * (ATANH(r) + 1.959963984540054 / SQRT(n - 3))) + 1), 6) AS high FROM g")
def correlation_intervals(spark, d):
    g = scored_parts(spark, d).groupBy("b").agg(F.corr("v", "f").alias("r"), F.count("*").alias("n")).filter("n > 3")
    low, high = regress.correlation_interval(F.col("r"), F.col("n"))
    return shown(g.select("b", "n", low.alias("low"), high.alias("high")))


@query()
def model_comparison(spark, d):
    """Event counts of users by two covariates against the constant model."""
    x = small(spark, d)
    cov = matrix.observations(x).withColumn("a", F.col("obs") % 3).withColumn("b", F.col("obs") % 2)
    return regress.model_comparison(x, cov, ["a", "b"])


@query()
def local_bandwidth(spark, d):
    """Corrected AIC of local fits of prices by sizes for three bandwidths."""
    p = points(spark, d)
    s = t(spark, d, "part").select(F.col("p_partkey").alias("obs"), F.col("p_size").alias("size"), (F.col("p_retailprice") / 1000).alias("price"))
    return spark.createDataFrame([(b, regress.local_aicc(p, s, ["size"], "price", b)) for b in (3.0, 4.0, 6.0)], "bandwidth double, aicc double")


# Readers: a table is written in the platform's format to the shared folder and read back


def stored(spark: SparkSession, df: DataFrame, kind: str, **options) -> str:
    path = f"{shared_folder(spark).rstrip('/')}/file-{uuid.uuid4().hex}"
    df.write.format(kind).options(**options).save(path)
    return path


@query("SELECT CAST(l_suppkey AS VARCHAR) AS gene, CAST(l_orderkey % 1000 AS INTEGER) AS x, CAST(l_partkey AS INTEGER) AS y, CAST(l_quantity AS INTEGER) AS total, CAST(FLOOR(l_quantity / 2) AS INTEGER) AS spliced, CAST(l_linenumber AS INTEGER) AS label FROM lineitem")
def read_reads(spark, d):
    whole = F.col("l_quantity").cast("int").alias("MIDCount")
    df = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("geneID"), (F.col("l_orderkey") % 1000).alias("x"), F.col("l_partkey").alias("y"), whole, F.floor(F.col("l_quantity") / 2).alias("EXONIC"), F.col("l_linenumber").alias("cell"))
    return readers.reads_tsv(spark, stored(spark, df, "csv", sep="\t", header=True), "cell").select("gene", "x", "y", "total", "spliced", "label")


@query("SELECT CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber AS label, l_returnflag AS gene, ROUND(l_extendedprice, 2) AS x, l_quantity AS y, 1 AS total FROM lineitem")
def read_transcripts(spark, d):
    df = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("fov"), F.col("l_linenumber").alias("cell_ID"), F.col("l_returnflag").alias("target"), F.round("l_extendedprice", 2).alias("x_global_px"), F.col("l_quantity").alias("y_global_px"))
    return readers.transcripts_csv(spark, stored(spark, df, "csv", header=True), ["fov", "cell_ID"]).select("label", "gene", "x", "y", "total")


@query("SELECT CAST(l_orderkey AS VARCHAR) AS obs, l_returnflag AS feature, CAST(COUNT(*) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2")
def molecule_counts(spark, d):
    df = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("cell"), F.col("l_returnflag").alias("target"), F.lit(1).alias("x_global_px"), F.lit(2).alias("y_global_px"))
    return readers.molecules_to_counts(readers.transcripts_csv(spark, stored(spark, df, "csv", header=True), ["cell"]))


@query("SELECT c_mktsegment AS obs, CAST(c_nationkey AS VARCHAR) AS feature, CAST(COUNT(*) AS DOUBLE) AS value FROM customer GROUP BY 1, 2")
def read_wide(spark, d):
    df = t(spark, d, "customer").groupBy("c_nationkey").pivot("c_mktsegment").count()
    return readers.wide_counts(spark, stored(spark, df, "csv", sep="\t", header=True), gene="c_nationkey")


@query("WITH l AS (SELECT ROW_NUMBER() OVER (ORDER BY vec_id) - 1 AS i, embedding FROM embeddings), e AS (SELECT i, UNNEST(RANGE(0, LEN(embedding))) AS j, UNNEST(embedding) AS v FROM l) SELECT i, CAST(j AS INTEGER) AS j, CAST(FLOOR(CAST(v AS DOUBLE) * 256) AS DOUBLE) AS value FROM e WHERE FLOOR(CAST(v AS DOUBLE) * 256) <> 0")
def read_headerless(spark, d):
    """Lines in the order of their files, however many files and splits there are."""
    line = F.array_join(F.transform("embedding", lambda e: F.floor(e.cast("double") * 256).cast("string")), ",")
    df = t(spark, d, "embeddings").orderBy("vec_id").select(line.alias("value"))
    return readers.headerless_counts(spark, stored(spark, df, "text"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS obs, o_orderpriority AS feature, CAST(COUNT(*) AS DOUBLE) AS value FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2")
def read_market(spark, d):
    """A coordinate file with its comment and size lines, and two dictionaries."""
    o = t(spark, d, "orders").join(t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    kinds = windows.numbered(o.select("o_orderpriority").distinct(), ["o_orderpriority"], "row")
    cells = windows.numbered(o.select("o_custkey").distinct(), ["o_custkey"], "col")
    body = o.join(kinds, "o_orderpriority").join(cells, "o_custkey").select((F.col("col") * 10 + F.col("row")).alias("at"), F.concat_ws(" ", "row", "col", "n").alias("value"))
    head = spark.createDataFrame([(-2, "%%MatrixMarket matrix coordinate integer general"), (-1, "0 0 0")], "at long, value string")
    matrix_file = stored(spark, body.unionByName(head).orderBy("at").select("value"), "text")
    features = stored(spark, kinds.orderBy("row").select(F.concat_ws("\t", F.lower("o_orderpriority"), "o_orderpriority").alias("value")), "text")
    barcodes = stored(spark, cells.orderBy("col").select(F.col("o_custkey").cast("string").alias("value")), "text")
    return readers.counts_from_market(readers.matrix_market(spark, matrix_file), readers.numbered_lines(spark, features, ["gene_name", "gene_id"]), readers.numbered_lines(spark, barcodes, ["barcode"]))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS obs, o_orderpriority AS feature, CAST(1 AS DOUBLE) AS value, 1 AS in_tissue, CAST(o_orderkey % 7 AS INTEGER) AS array_row, CAST(o_orderkey % 5 AS INTEGER) AS array_col, ROUND(o_totalprice, 2) AS y, CAST(o_custkey AS DOUBLE) AS x FROM orders")
def read_positions(spark, d):
    o = t(spark, d, "orders")
    df = o.select("o_orderkey", F.lit(1), F.col("o_orderkey") % 7, F.col("o_orderkey") % 5, F.round("o_totalprice", 2), "o_custkey")
    places = readers.tissue_positions(spark, stored(spark, df, "csv"))
    return readers.with_positions(o.select(F.col("o_orderkey").cast("string").alias("obs"), F.col("o_orderpriority").alias("feature"), F.lit(1.0).alias("value")), places)


@query("SELECT CAST(s_suppkey AS VARCHAR) AS barcode, s_acctbal AS x, CAST(s_nationkey AS DOUBLE) AS y FROM supplier")
def read_beads(spark, d):
    df = t(spark, d, "supplier").select(F.col("s_suppkey").alias("barcode"), F.col("s_acctbal").alias("x"), F.col("s_nationkey").alias("y"))
    return readers.bead_positions(spark, stored(spark, df, "csv", header=True))


@query("SELECT CAST(p_partkey AS VARCHAR) AS barcode, 1 AS lane, CAST(p_size AS BIGINT) AS tile, p_partkey % 100 AS x, CAST(FLOOR(p_retailprice) AS BIGINT) AS y FROM part")
def read_whitespace(spark, d):
    df = t(spark, d, "part").select(F.concat_ws("  ", "p_partkey", F.lit(1), "p_size", F.col("p_partkey") % 100, F.floor("p_retailprice")).alias("value"))
    return readers.whitespace_positions(spark, stored(spark, df, "text")).withColumn("lane", F.col("lane").cast("int"))


@query("WITH o AS (SELECT fov, SUM(x_offset) OVER (ORDER BY fov) AS a, SUM(y_offset) OVER (ORDER BY fov) AS b FROM (SELECT n_nationkey AS fov, n_regionkey * 100.0 AS x_offset, 7.0 AS y_offset FROM nation)) SELECT c_nationkey AS fov, c_custkey AS cell_id, CAST(TRUNC(c_acctbal + a) AS INTEGER) AS x, CAST(c_custkey + b AS INTEGER) AS y FROM customer JOIN o ON fov = c_nationkey")
def frames_of_view(spark, d):
    cells = t(spark, d, "customer").select(F.col("c_nationkey").alias("fov"), F.col("c_custkey").alias("cell_id"), F.col("c_acctbal").alias("x"), F.col("c_custkey").alias("y"))
    offsets = t(spark, d, "nation").select(F.col("n_nationkey").alias("fov"), (F.col("n_regionkey") * 100.0).alias("x_offset"), F.lit(7.0).alias("y_offset"))
    return readers.frames_of_view(cells, offsets, True)


@query(f"WITH {P}, l AS (SELECT LEAST(MIN(x), MIN(y)) AS l FROM p) SELECT id, ROUND(x - l, 6) AS x, ROUND(y - l, 6) AS y FROM p CROSS JOIN l")
def shifted_to_origin(spark, d):
    return shown(readers.shifted_to_origin(points(spark, d)))


@query("WITH px AS (SELECT p_partkey AS x, p_size AS y, CAST(p_partkey % 97 % 13 AS BIGINT) AS label FROM part), a AS (SELECT label, COUNT(*) AS a FROM px WHERE label <> 0 GROUP BY 1) SELECT x, y, label FROM px JOIN a USING (label) WHERE a > 10 AND a < 100000 AND label < (SELECT MAX(label) FROM px)")
def labels_in_range(spark, d):
    px = t(spark, d, "part").select(F.col("p_partkey").alias("x"), F.col("p_size").alias("y"), (F.col("p_partkey") % 97 % 13).alias("label"))
    return readers.labels_in_range(px, 10, 100000).select("x", "y", "label")


# Segmentation: labels on the 20 x 15 grid of part counts

#: Pixels at or above the mean count, labelled by blocks of 4 x 5 and of 5 x 3.
LABELS = "hi AS (SELECT AVG(v) AS a FROM px), la AS (SELECT x, y, (x // 4) * 3 + y // 5 + 1 AS label FROM px CROSS JOIN hi WHERE v >= a), lb AS (SELECT x, y, (x // 5) * 5 + y // 3 + 1 AS label FROM px CROSS JOIN hi WHERE v < a AND (x // 5) % 2 = 0 OR v >= a AND y < 9)"
FOURS = "(VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) f(dx, dy)"


def block_labels(spark: SparkSession, d: str, second: bool = False) -> DataFrame:
    px = square_grid(spark, d)
    px = px.join(px.agg(F.avg("v").alias("a")))
    block = lambda c, n: F.floor(F.col(c) / n)
    if second:
        chosen = px.filter("v < a AND floor(x / 5) % 2 = 0 OR v >= a AND y < 9")
        return chosen.select("x", "y", (block("x", 5) * 5 + block("y", 3) + 1).alias("label"))
    return px.filter("v >= a").select("x", "y", (block("x", 4) * 3 + block("y", 5) + 1).alias("label"))


@query(f"WITH {SG}, k AS (SELECT UNNEST(RANGE(-2, 3)) AS a) SELECT p.x, p.y, MEDIAN(q.v % 256) AS v FROM px p CROSS JOIN k i CROSS JOIN k j JOIN px q ON q.x = LEAST(GREATEST(p.x + i.a, 0), 19) AND q.y = LEAST(GREATEST(p.y + j.a, 0), 14) GROUP BY p.x, p.y")
def median_blur(spark, d):
    return segment.median_blur(square_grid(spark, d), 20, 15, 5)


@query(f"WITH {SG}, {LABELS} SELECT DISTINCT p.x, p.y FROM la p CROSS JOIN {FOURS} LEFT JOIN la q ON q.x = p.x + dx AND q.y = p.y + dy WHERE p.x + dx BETWEEN 0 AND 19 AND p.y + dy BETWEEN 0 AND 14 AND q.label IS DISTINCT FROM p.label")
def label_boundaries(spark, d):
    return segment.boundaries(block_labels(spark, d), 20, 15)


@query(f"WITH {SG}, {LABELS} SELECT x, y, CAST(CASE WHEN label % 3 = 0 THEN label + 100 ELSE label END AS BIGINT) AS label FROM la WHERE label % 4 <> 1 OR label % 3 = 0")
def replaced_labels(spark, d):
    own = block_labels(spark, d)
    to = own.select("label").distinct().filter("label % 3 = 0 OR label % 4 = 1").select("label", F.when(F.col("label") % 3 == 0, F.col("label") + 100).otherwise(0).alias("to"))
    return segment.replace_labels(own, to)


def _expand_sql(rounds: int, most: int) -> str:
    out = f"{SG}, {LABELS}, g0 AS (SELECT x, y, CAST(label AS BIGINT) AS label FROM lb)"
    for k in range(rounds):
        out += f", n{k} AS (SELECT x + dx AS x, y + dy AS y, MIN(label) AS label FROM g{k} CROSS JOIN {FOURS} GROUP BY 1, 2 HAVING COUNT(DISTINCT label) = 1), g{k + 1} AS (SELECT * FROM g{k} UNION ALL SELECT n.* FROM n{k} n WHERE n.x BETWEEN 0 AND 19 AND n.y BETWEEN 0 AND 14 AND NOT EXISTS (SELECT 1 FROM g{k} g WHERE g.x = n.x AND g.y = n.y) AND n.label NOT IN (SELECT label FROM g{k} GROUP BY 1 HAVING COUNT(*) >= {most}))"
    return f"WITH {out} SELECT x, y, label FROM g{rounds}"


@query(_expand_sql(3, 12))
def expanded_labels(spark, d):
    return segment.expand_labels(block_labels(spark, d, True), 20, 15, 3, 12)


@query(f"WITH {SG}, {LABELS}, b AS (SELECT DISTINCT la.label AS s, lb.label AS t FROM la JOIN lb USING (x, y)), u AS (SELECT x, y, 0 AS second, label FROM lb WHERE label IN (SELECT t FROM b) UNION ALL SELECT x, y, 1, label FROM la WHERE label NOT IN (SELECT s FROM b)) SELECT x, y, CAST(DENSE_RANK() OVER (ORDER BY second, label) AS INTEGER) AS label FROM u")
def augmented_labels(spark, d):
    return segment.augment_labels(block_labels(spark, d), block_labels(spark, d, True))


@query(f"WITH {SG}, w AS (SELECT p.x, p.y, p.v, MAX(q.v) AS top FROM px p JOIN px q ON ABS(p.x - q.x) <= 2 AND ABS(p.y - q.y) <= 2 GROUP BY 1, 2, 3), k AS (SELECT x, y, v FROM w WHERE v = top AND v > (SELECT MIN(v) FROM px) AND x BETWEEN 2 AND 17 AND y BETWEEN 2 AND 12), r AS (SELECT * FROM k a WHERE NOT EXISTS (SELECT 1 FROM k b WHERE b.v = a.v AND (b.x < a.x OR b.x = a.x AND b.y < a.y) AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4)) SELECT x, y, CAST(ROW_NUMBER() OVER (ORDER BY v DESC, x, y) AS INTEGER) AS label FROM r")
def grid_peaks(spark, d):
    return segment.local_peaks(square_grid(spark, d), 20, 15, 2)


@query(f"WITH {SG} SELECT x, y, CASE WHEN v < 5 THEN 0 ELSE v END AS v FROM px")
def background_removed(spark, d):
    return segment.remove_background(square_grid(spark, d), 5.0)


@query(f"WITH {SG}, t AS (SELECT x - x % 5 AS x, y - y % 5 AS y, SUM(v) AS total FROM px GROUP BY 1, 2) SELECT x, y, total FROM t WHERE total > 0")
def region_totals(spark, d):
    """All tiles are asked for, so the draw leaves none out; tests check its chances."""
    return segment.select_regions(square_grid(spark, d), 5, 12)


@query()
def watershed_labels(spark, d):
    px = square_grid(spark, d)
    return segment.watershed(px, segment.find_peaks(px, 20, 15, 3, 2))


@query()
def safely_eroded(spark, d):
    return segment.safe_erode(block_labels(spark, d, True), 20, 15, 3, False, 4)


# Geometry


@query(f"WITH {P} SELECT id, ROUND(0.6 * x - 0.8 * y + 3, 6) {C} AS x, ROUND(0.8 * x + 0.6 * y - 1, 6) {C} AS y FROM p")
def affine_map(spark, d):
    return shown(geometry.affine(points(spark, d), ["x", "y"], [[0.6, -0.8], [0.8, 0.6]], [3, -1]))


@query(f"WITH {P}, m AS (SELECT AVG(x) AS mx, AVG(y) AS my FROM p), r AS (SELECT SQRT(AVG((x - mx) * (x - mx) + (y - my) * (y - my))) AS r FROM p, m) SELECT id, ROUND((x - mx) / r, 6) {C} AS x, ROUND((y - my) / r, 6) {C} AS y FROM p, m, r")
def normalized_coordinates(spark, d):
    return shown(geometry.normalized(points(spark, d), ["x", "y"]), "id", "x", "y")


@query(f"WITH {P} SELECT FLOOR(x / 7)::BIGINT AS vx, FLOOR(y / 7)::BIGINT AS vy, COUNT(*) AS n FROM p GROUP BY 1, 2")
def voxels(spark, d):
    return geometry.voxelize(points(spark, d), ["x", "y"], 7)


@query(f"WITH {P} SELECT id FROM p WHERE x >= 5.5 AND y - 48.5 >= 0 AND y - 48.5 <= 2 * (x - 5.5) AND x <= 30.5")
def inside_polygon(spark, d):
    ring = [(5.5, 48.5), (30.5, 48.5), (30.5, 98.5)]
    return points(spark, d).filter(geometry.inside_convex(F.col("x"), F.col("y"), ring)).select("id")


PI = "pi AS (SELECT l_orderkey % 200 AS a, l_suppkey AS b, SUM(l_quantity) AS p FROM lineitem GROUP BY 1, 2)"


@query(f"WITH {PI} SELECT a, b, p FROM pi QUALIFY ROW_NUMBER() OVER (PARTITION BY a ORDER BY p DESC, b) = 1")
def best_matches(spark, d):
    pi = t(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 200).alias("a"), F.col("l_suppkey").alias("b")).agg(F.sum("l_quantity").alias("p"))
    return geometry.best_matches(pi)


@query(f"WITH {PI} SELECT a, b, ROUND(p / (SUM(p) OVER (PARTITION BY b) + 2.5), 8) AS p FROM pi")
def soft_assignment(spark, d):
    pi = t(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 200).alias("a"), F.col("l_suppkey").alias("b")).agg(F.sum("l_quantity").alias("weight"))
    return geometry.assignment(pi, 2.5).withColumn("p", F.round("p", 8))


@query(f"WITH {knn_sql(4)}, j AS (SELECT src, dist, p_size AS v FROM e JOIN part ON p_partkey = dst) SELECT src, ROUND(COALESCE(AVG(CASE WHEN dist = 0 THEN v END), SUM(v / (dist * dist)) FILTER (dist > 0) / SUM(1 / (dist * dist)) FILTER (dist > 0)), 5) AS value FROM j GROUP BY 1")
def inverse_distance(spark, d):
    s = sizes(spark, d).withColumnRenamed("obs", "id")
    return geometry.shepard(s, graph.knn(points(spark, d), 4)).select("src", rd("value", 5).alias("value"))


@query()
def hull_properties(spark, d):
    p = points(spark, d).join(brands(spark, d).withColumnRenamed("obs", "id"), "id")
    return geometry.points_props(p).drop("hull")


@query(f"WITH {P}, m AS (SELECT AVG(x) AS mx, AVG(y) AS my, ATAN2(2 * COVAR_POP(x, y), VAR_POP(x) - VAR_POP(y)) / 2 AS a FROM p), v AS (SELECT mx, my, COS(a) * CASE WHEN ABS(COS(a)) >= ABS(SIN(a)) THEN SIGN(COS(a)) ELSE SIGN(SIN(a)) END AS c1, SIN(a) * CASE WHEN ABS(COS(a)) >= ABS(SIN(a)) THEN SIGN(COS(a)) ELSE SIGN(SIN(a)) END AS s1, -SIN(a) * CASE WHEN ABS(SIN(a)) >= ABS(COS(a)) THEN SIGN(-SIN(a)) ELSE SIGN(COS(a)) END AS c2, COS(a) * CASE WHEN ABS(SIN(a)) >= ABS(COS(a)) THEN SIGN(-SIN(a)) ELSE SIGN(COS(a)) END AS s2 FROM m) SELECT id, ROUND(c1 * (x - mx) + s1 * (y - my), 5) {C} AS x, ROUND(c2 * (x - mx) + s2 * (y - my), 5) {C} AS y FROM p CROSS JOIN v")
def principal_axes(spark, d):
    out = geometry.pca_align(points(spark, d), ["x", "y"])
    return out.select("id", rd("x", 5).alias("x"), rd("y", 5).alias("y"))


# Learning and iteration: checked by tests, no SQL


@query()
def pca_scores(spark, d):
    return learn.pca(vectors(spark, d), 5)[0]


@query()
def kmeans_clusters(spark, d):
    return learn.kmeans(vectors(spark, d), 10)


@query()
def mixture_clusters(spark, d):
    return learn.gaussian_mixture(vectors(spark, d), 4)


@query(f"WITH {knn_sql(12)}, s AS (SELECT p_partkey AS dst, p_size AS z, p_retailprice / 1000 AS v FROM part), t AS (SELECT src, SUM(w) AS a, SUM(w * z) AS b, SUM(w * z * z) AS c, SUM(w * v) AS f, SUM(w * z * v) AS g FROM (SELECT src, dst, EXP(-0.5 * (dist / 5.0) * (dist / 5.0)) AS w FROM e) JOIN s USING (dst) WHERE w >= 1e-5 GROUP BY 1), r AS (SELECT src, CASE WHEN a * c - b * b <= 1e-9 * a * c THEN f / a / (1 + (b / a) * (b / a)) ELSE (c * f - b * g) / (a * c - b * b) END AS b0, CASE WHEN a * c - b * b <= 1e-9 * a * c THEN f / a * (b / a) / (1 + (b / a) * (b / a)) ELSE (a * g - b * f) / (a * c - b * b) END AS b1 FROM t) SELECT src, ROUND(b0, 4) AS intercept, ROUND(b1, 4) {C} AS slope, ROUND(b0 + b1 * z, 4) AS fitted FROM r JOIN s ON s.dst = r.src")
def local_regression(spark, d):
    e = graph.kernel_weights(graph.knn(points(spark, d), 12), "gaussian", bandwidth=5.0)
    s = t(spark, d, "part").select(F.col("p_partkey").alias("obs"), F.col("p_size").alias("size"), (F.col("p_retailprice") / 1000).alias("price"))
    out = differential.local_regression(e, s, ["size"], "price")
    return out.select("src", rd(F.col("betas")[0], 4).alias("intercept"), rd(F.col("betas")[1], 4).alias("slope"), rd("fitted", 4).alias("fitted"))


@query()
def likelihood_ratio(spark, d):
    x = small(spark, d)
    return differential.likelihood_ratio(x, matrix.observations(x).withColumn("t", (F.col("obs") % 10).cast("double")))


@query()
def transport_distances(spark, d):
    return learn.transport_distances(part_counts(spark, d), points(spark, d))


@query()
def communities(spark, d):
    return iterate.label_propagation(part_edges(spark, d), None)


@query(f"WITH RECURSIVE {knn_sql(4)}, y AS (SELECT src, dst, dist FROM e UNION SELECT dst, src, dist FROM e), t(source, id, dist) USING KEY (source, id) AS (SELECT id, id, CAST(0 AS DOUBLE) FROM p WHERE id % 997 = 1 UNION SELECT source, id, MIN(dist) FROM (SELECT t.source, y.dst AS id, t.dist + y.dist AS dist FROM t JOIN y ON y.src = t.id LEFT JOIN recurring.t r ON r.source = t.source AND r.id = y.dst WHERE r.dist IS NULL OR t.dist + y.dist < r.dist) GROUP BY 1, 2) SELECT source, id, ROUND(dist, 6) AS dist FROM t")
def shortest_paths(spark, d):
    p = points(spark, d)
    return shown(iterate.shortest_paths(graph.symmetric(graph.knn(p, 4)), p.filter("id % 997 = 1").select("id")))


@query()
def count_mixture(spark, d):
    c = t(spark, d, "lineitem").select(F.col("l_quantity").cast("int").alias("v"))
    return iterate.confidence(c, "v", iterate.nb_mixture(c, "v", (0.5, 0.5), (10.0, 35.0), (40.0, 60.0)))


@query()
def grid_belief(spark, d):
    px = square_grid(spark, d).select("x", "y", F.when(F.col("v") >= 6, 0.8).otherwise(0.3).alias("cell"))
    return iterate.grid_belief(px.withColumn("background", 1 - F.col("cell")), 8)


@query()
def race_sample(spark, d):
    return iterate.race_sample(t(spark, d, "part").select("p_partkey", "p_size"), 100, F.col("p_size").cast("double"), "p_partkey")


# Streams


@query("SELECT DATE_TRUNC('day', ts) AS start, event_type, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_bins_daily(spark, d):
    return stream_bins.windowed_counts(t(spark, d, "events")).withColumn("total", F.round("total", 4))


# Plain relational shapes that the others build on


@query("SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark, d):
    li = t(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


# Orders


@query("SELECT p_partkey, ROUND(AVG(p_retailprice) OVER (ORDER BY p_partkey ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 5) AS moving FROM part")
def moving_mean(spark, d):
    p = t(spark, d, "part").select("p_partkey", "p_retailprice")
    return windows.moving_mean(p, "p_retailprice", ["p_partkey"], 7).select("p_partkey", rd("moving", 5).alias("moving"))


@query(
    "WITH s AS (SELECT p_partkey AS id, ROW_NUMBER() OVER (ORDER BY p_partkey) AS i, COUNT(*) OVER () AS n, STDDEV_POP(p_size) OVER (ORDER BY p_partkey ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS s FROM part) "
    "SELECT id, ROUND(CASE WHEN i <= 4 THEN (SELECT s FROM s WHERE i = 5) WHEN i > n - 4 THEN (SELECT s FROM s WHERE i = n - 4) ELSE s END, 6) AS moving FROM s"
)
def moving_deviation(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("v"))
    return shown(windows.moving_deviation(p, "v", ["id"], 9), "id", "moving")


@query("WITH b AS (SELECT p_partkey AS id, p_size AS v, FLOOR((ROW_NUMBER() OVER (ORDER BY p_retailprice, p_partkey) - 1) / 100) AS b FROM part) SELECT id, ROUND((COUNT(*) OVER (PARTITION BY b ORDER BY v DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 1) / (COUNT(*) OVER (PARTITION BY b) + 1), 6) AS p FROM b")
def rank_in_bins(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("v"), "p_retailprice")
    return shown(windows.rank_p(p, "v", "p_retailprice", "id", 100), "id", "p")


@query("SELECT p_partkey, ROUND((p_retailprice - AVG(p_retailprice) OVER (PARTITION BY p_brand)) / STDDEV_SAMP(p_retailprice) OVER (PARTITION BY p_brand), 6) + 0.0 AS z FROM part")
def group_zscore(spark, d):
    return shown(windows.group_zscore(t(spark, d, "part"), "p_retailprice", ["p_brand"]), "p_partkey", "z")


@query()
def permutation_test(spark, d):
    p = t(spark, d, "part").select("p_partkey", "p_retailprice", (F.col("p_size") > 45).alias("large"))
    return windows.permutation_p(p, "p_retailprice", "large", "p_partkey", 50)


@query("WITH s AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, p_retailprice / 100 AS y FROM part), d AS (SELECT id, COALESCE(SQRT((x - LAG(x) OVER (ORDER BY id)) * (x - LAG(x) OVER (ORDER BY id)) + (y - LAG(y) OVER (ORDER BY id)) * (y - LAG(y) OVER (ORDER BY id))), 0) AS d FROM s), a AS (SELECT id, SUM(d) OVER (ORDER BY id) AS arc FROM d) SELECT id, ROUND(arc, 4) AS arc FROM a")
def arc_length(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 100).alias("y"))
    return windows.arc_segments(p, "id", 10).select("id", rd("arc", 4).alias("arc"))


@query(f"WITH {knn_sql(5)}, {PVAL}, l AS (SELECT src AS obs, AVG(z) AS lag FROM e JOIN zz ON zz.obs = e.dst GROUP BY 1), k AS (SELECT p_brand AS \"group\", CASE WHEN z > 0 AND lag > 0 THEN 1 WHEN z <= 0 AND lag > 0 THEN 2 WHEN z <= 0 AND lag <= 0 THEN 3 ELSE 4 END AS quadrant, COUNT(*) AS n FROM zz JOIN l USING (obs) JOIN part ON p_partkey = obs GROUP BY 1, 2) SELECT \"group\", quadrant, n, ROUND(n / SUM(n) OVER (PARTITION BY \"group\"), 6) AS fraction, ROUND(n / SUM(n) OVER (PARTITION BY quadrant), 6) AS specificity FROM k")
def hotspot_summary(spark, d):
    g = brands(spark, d).withColumnRenamed("label", "group")
    return shown(spatial.hotspot_summary(spatial.local_moran(part_edges(spark, d), prices(spark, d)), g), "group", "quadrant", "n", "fraction", "specificity")


@query(f"WITH {knn_sql(9)}, {LB}, v AS (SELECT src, label, COUNT(*) AS n, MIN(rank) AS f FROM e JOIN l ON l.obs = e.dst GROUP BY 1, 2), b AS (SELECT src, label AS best, n AS nb FROM v QUALIFY ROW_NUMBER() OVER (PARTITION BY src ORDER BY n DESC, f) = 1) SELECT l.obs, CASE WHEN COALESCE(v.n, 0) < 4.5 AND nb > 4.5 THEN best ELSE l.label END AS label FROM l LEFT JOIN v ON v.src = l.obs AND v.label = l.label LEFT JOIN b ON b.src = l.obs")
def refined_label(spark, d):
    return graph.refined_label(graph.knn(points(spark, d), 9), brands(spark, d), 9)


@query(f"WITH {X}, {G}, b AS (SELECT obs, feature, value FROM x) SELECT feature, SUM(value) AS total, COUNT(DISTINCT \"group\") AS n_groups FROM b JOIN g USING (obs) WHERE feature IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1")
def semi_joined_totals(spark, d):
    s = t(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("feature"))
    return counts(spark, d).join(s, "feature", "left_semi").join(groups(spark, d), "obs").groupBy("feature").agg(F.sum("value").alias("total"), F.count_distinct("group").alias("n_groups"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
