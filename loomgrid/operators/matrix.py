"""The sparse count matrix as a long table (obs, feature, value): binning, filters, normalisation, feature statistics.

An absent row means 0. Means and variances over all observations therefore divide by the number of observations, which
comes from ``obs`` or is counted over the table itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mathx import safe_divide
from .windows import hash_rank, numbered


def from_reads(reads: DataFrame, obs: str, feature: str, value: str | None = None) -> DataFrame:
    """Long counts; equal (obs, feature) pairs are summed, or counted without a value."""
    v = F.sum(F.col(value).cast("double")) if value else F.count("*").cast("double")
    return reads.groupBy(F.col(obs).alias("obs"), F.col(feature).alias("feature")).agg(v.alias("value"))


def bin_index(c: Column, start=0, size: int = 1) -> Column:
    return F.floor((c - F.lit(start)) / F.lit(size)).cast("long")


def bin_centre(i: Column, start=0, size: int = 1) -> Column:
    return F.lit(start) + i * size + F.lit(size) / 2.0


def bin_reads(reads: DataFrame, x: str, y: str, value: str, size: int, feature: str | None = None, listed=None) -> DataFrame:
    """Sums over square bins, by feature if given; ``listed`` features get a sum of their own beside the total."""
    keys = [bin_index(F.col(x), 0, size).alias("bx"), bin_index(F.col(y), 0, size).alias("by")]
    if feature and listed is None:
        return reads.groupBy(*keys, F.col(feature).alias("feature")).agg(F.sum(value).alias("total"))
    own = [] if listed is None else [F.sum(F.when(F.col(feature).isin(*listed), F.col(value)).otherwise(0)).alias("listed")]
    return reads.groupBy(*keys).agg(F.sum(value).alias("total"), *own)


def bin_properties(bins: DataFrame, x: str = "bx", y: str = "by", size: int = 1) -> DataFrame:
    """Area, half-open bounding box and centre of each bin."""
    b = bins.select(x, y).distinct()
    return b.select(x, y, F.lit(size * size).cast("long").alias("area"), (F.col(x) * size).alias("min_x"), ((F.col(x) + 1) * size).alias("max_x"), (F.col(y) * size).alias("min_y"), ((F.col(y) + 1) * size).alias("max_y"), bin_centre(F.col(x), 0, size).alias("centre_x"), bin_centre(F.col(y), 0, size).alias("centre_y"))


def bin_matrix(px: DataFrame, size: int, i: str = "i", j: str = "j", v: str = "v") -> DataFrame:
    """Block sums of a matrix."""
    return px.groupBy(bin_index(F.col(i), 0, size).alias(i), bin_index(F.col(j), 0, size).alias(j)).agg(F.sum(v).alias(v))


def melt(wide: DataFrame, keys: list[str], columns: list[str], name: str = "obs", value: str = "value") -> DataFrame:
    """Wide counts to long ones without zeros."""
    return wide.unpivot(keys, columns, name, value).filter(F.col(value) > 0)


def observations(x: DataFrame) -> DataFrame:
    return x.select("obs").distinct()


def filter_obs(x: DataFrame, least: int = 1, most: float = float("inf"), keep_flag: bool = False, obs: DataFrame | None = None) -> DataFrame:
    """Observations with a number of expressed features in range; with keep_flag all of them and whether they pass."""
    n = x.filter("value > 0").groupBy("obs").agg(F.count("*").alias("n_features"))
    every = (obs if obs is not None else observations(x)).join(n, "obs", "left").withColumn("n_features", F.coalesce("n_features", F.lit(0)))
    passed = F.col("n_features").between(F.lit(float(least)), F.lit(float(most)))
    return every.withColumn("passes", passed) if keep_flag else every.filter(passed)


def n_obs_of(x: DataFrame) -> DataFrame:
    """One row: the number of observations."""
    return x.agg(F.count_distinct("obs").cast("double").alias("n_obs"))


def feature_stats(x: DataFrame, n_obs: DataFrame | None = None) -> DataFrame:
    """feature, n_expressed, total, mean, var (sample), positive_ratio over all observations, absent ones being 0."""
    n = F.broadcast(n_obs if n_obs is not None else n_obs_of(x))
    sums = x.groupBy("feature").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"), F.count_if(F.col("value") > 0).alias("n_expressed"))
    mean = F.col("s") / F.col("n_obs")
    var = (F.col("q") / F.col("n_obs") - mean * mean) * F.col("n_obs") / F.when(F.col("n_obs") > 1, F.col("n_obs") - 1)
    return sums.join(n).select("feature", "n_expressed", F.col("s").alias("total"), mean.alias("mean"), var.alias("var"), (F.col("n_expressed") / F.col("n_obs")).alias("positive_ratio"))


def obs_stats(x: DataFrame, n_features: int) -> DataFrame:
    """obs, total, mean, population variance over n_features features."""
    s = x.groupBy("obs").agg(F.sum("value").alias("total"), F.sum(F.col("value") ** 2).alias("q"))
    mean = F.col("total") / n_features
    return s.select("obs", "total", mean.alias("mean"), (F.col("q") / n_features - mean * mean).alias("var"))


def filter_features(x: DataFrame, min_obs: int = 1, max_obs: float = float("inf"), min_mean: float = 0, max_mean: float = float("inf"), min_total: float = 0, max_total: float = float("inf")) -> DataFrame:
    s = feature_stats(x)
    return s.filter(F.col("n_expressed").between(float(min_obs), float(max_obs)) & F.col("mean").between(float(min_mean), float(max_mean)) & F.col("total").between(float(min_total), float(max_total)))


def batch_stats(x: DataFrame, batches: DataFrame) -> DataFrame:
    """feature, batch, n, mean, centred sum of squares; batches: (obs, batch)."""
    n = batches.groupBy("batch").agg(F.count("*").cast("double").alias("n"))
    s = x.join(batches, "obs").groupBy("feature", "batch").agg(F.sum("value").alias("s"), F.sum(F.col("value") ** 2).alias("q"))
    return s.join(F.broadcast(n), "batch").select("feature", "batch", "n", (F.col("s") / F.col("n")).alias("mean"), F.when(F.col("n") > 1, F.col("q") - F.col("s") ** 2 / F.col("n")).otherwise(F.col("q")).alias("ss"))


def in_range(points: DataFrame, x_range, y_range, x: str = "x", y: str = "y") -> DataFrame:
    return points.filter(F.col(x).between(*map(F.lit, x_range)) & F.col(y).between(*map(F.lit, y_range)))


#: English comparisons, the longer ones first.
PHRASES = (
    ("greater than or equal to", ">="), ("less than or equal to", "<="), ("not equal to", "<>"), ("greater than", ">"), ("less than", "<"), ("equal to", "="),
    ("at least", ">="), ("at most", "<="),
)


def parse_instruction(text: str, axes: dict[str, str] | None = None) -> str:
    """An English predicate as a SQL condition; axis names are replaced as whole words."""
    import re

    out = text
    for phrase, sign in PHRASES:
        out = re.sub(rf"\b(?:is |are )?{phrase}\b", sign, out, flags=re.IGNORECASE)
    for name, column in (axes or {}).items():
        out = re.sub(rf"\b{re.escape(name)}\b", column, out)
    return out


def filter_by_instructions(points: DataFrame, instructions, axes: dict[str, str] | None = None) -> DataFrame:
    for text in [instructions] if isinstance(instructions, str) else instructions:
        points = points.filter(F.expr(parse_instruction(text, axes)))
    return points


def row_totals(x: DataFrame, exclude_above: float | None = None) -> DataFrame:
    """obs, s; features with any value above that fraction of a row's sum don't count."""
    if exclude_above is None:
        return x.groupBy("obs").agg(F.sum("value").alias("s"))
    by_row = Window.partitionBy("obs")
    high = x.withColumn("s", F.sum("value").over(by_row)).filter(F.col("value") > F.col("s") * exclude_above).select("feature").distinct()
    kept = x.join(high, "feature", "left_anti").groupBy("obs").agg(F.sum("value").alias("s"))
    return observations(x).join(kept, "obs", "left").select("obs", F.coalesce("s", F.lit(0.0)).alias("s"))


def normalize_total(x: DataFrame, target: float | str | None = None, exclude_above: float | None = None) -> DataFrame:
    """Rows scaled to one sum: a number, ``median`` of positive sums, or the power of ten from the mean sum upwards."""
    totals = row_totals(x, exclude_above)
    if target == "median":
        goal = totals.filter("s > 0").agg(F.median("s").alias("goal"))
    elif target is None:
        goal = row_totals(x).agg(F.pow(F.lit(10.0), F.ceil(F.log10(F.avg("s")))).alias("goal"))
    else:
        goal = None
    out = x.join(totals, "obs")
    to = F.lit(float(target)) if goal is None else F.col("goal")
    out = out if goal is None else out.join(F.broadcast(goal))
    return out.select("obs", "feature", (F.col("value") * to / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))).alias("value"))


def log1p(x: DataFrame, base: float | None = None) -> DataFrame:
    v = F.log1p("value")
    return x.withColumn("value", v if base is None else v / F.log(F.lit(float(base))))


def expm1(x: DataFrame) -> DataFrame:
    return x.withColumn("value", F.expm1("value"))


def densify(x: DataFrame, obs: DataFrame | None = None, features: DataFrame | None = None) -> DataFrame:
    """All obs with all features; the feature list is replicated, so it should be the short side."""
    f = features if features is not None else x.select("feature").distinct()
    o = obs if obs is not None else observations(x)
    each = o.join(F.broadcast(f.agg(F.array_sort(F.collect_set("feature")).alias("fs"))))
    return each.select("obs", F.explode("fs").alias("feature")).join(x, ["obs", "feature"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def scale(x: DataFrame, centre: bool = True, most: float | None = None) -> DataFrame:
    """Per-feature z-scores with the sample deviation (0 counts as 1), clipped above only; uncentred it stays sparse."""
    s = feature_stats(x).select("feature", "mean", F.when(F.col("var") > 0, F.sqrt("var")).otherwise(1.0).alias("sd"))
    rows = (densify(x) if centre else x).join(s, "feature")
    z = (F.col("value") - F.col("mean")) / F.col("sd") if centre else F.col("value") / F.col("sd")
    return rows.select("obs", "feature", (z if most is None else F.least(z, F.lit(float(most)))).alias("value"))


def scale_to(x: DataFrame, total: float | None = None) -> DataFrame:
    """Rows to the median row sum, or to a total."""
    return normalize_total(x, "median" if total is None else total)


def min_max(df: DataFrame, column: str, out: str, top: float = 1.0, by: list[str] | None = None) -> DataFrame:
    w = Window.partitionBy(*(by or []))
    low, high = F.min(column).over(w), F.max(column).over(w)
    return df.withColumn(out, F.lit(top) * safe_divide(F.col(column) - low, high - low, 0.0))


def feature_min_max(x: DataFrame) -> DataFrame:
    """Column min-max; a feature that some observation lacks has minimum 0 at most."""
    n = F.broadcast(n_obs_of(x))
    s = x.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("c")).join(n)
    s = s.select("feature", F.when(F.col("c") < F.col("n_obs"), F.least("lo", F.lit(0.0))).otherwise(F.col("lo")).alias("lo"), F.when(F.col("c") < F.col("n_obs"), F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi")).alias("hi"))
    return x.join(s, "feature").select("obs", "feature", safe_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo"), 0.0).alias("value"))


def pearson_residuals(x: DataFrame, theta: float = 100.0) -> DataFrame:
    """Analytic residuals of the stored and absent entries, clipped at the root of the number of observations."""
    rows, cols = x.groupBy("obs").agg(F.sum("value").alias("r")), x.groupBy("feature").agg(F.sum("value").alias("c"))
    total = x.agg(F.sum("value").alias("t"), F.count_distinct("obs").alias("n"))
    d = densify(x).join(rows, "obs").join(cols, "feature").join(F.broadcast(total))
    mu = safe_divide(F.col("r") * F.col("c"), F.col("t"), 0.0)
    z = safe_divide(F.col("value") - mu, F.sqrt(mu + mu * mu / theta), 0.0)
    edge = F.sqrt("n")
    return d.select("obs", "feature", F.greatest(-edge, F.least(edge, z)).alias("value"))


def variable_features(x: DataFrame, bins: int = 20, n_top: int | None = None) -> DataFrame:
    """Highly variable features of log-normalised counts: log dispersion, z-scored within bins of the mean, ranked.

    Bins are of equal width over log1p(mean), closed on the right; the first includes its lower edge.
    """
    s = feature_stats(expm1(x)).filter("mean > 0")
    s = s.select("feature", F.log1p("mean").alias("m"), F.when(F.col("var") > 0, F.ln(F.col("var") / F.col("mean"))).alias("d"))
    every = Window.partitionBy()
    lo, hi = F.min("m").over(every), F.max("m").over(every)
    at = F.when(hi > lo, F.greatest(F.ceil((F.col("m") - lo) / (hi - lo) * bins), F.lit(1))).otherwise(1)
    s = s.withColumn("bin", at.cast("int"))
    by = Window.partitionBy("bin")
    sd = F.stddev_samp("d").over(by)
    z = F.when(sd > 0, (F.col("d") - F.avg("d").over(by)) / sd).otherwise(0.0)
    s = s.withColumn("z", F.coalesce(z, F.lit(0.0)))
    out = s.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("z"), "feature")))
    return out if n_top is None else out.filter(F.col("rank") <= n_top)


def fano_factors(x: DataFrame) -> DataFrame:
    """feature, mean, var (population), fano, cv."""
    s = feature_stats(x).join(F.broadcast(n_obs_of(x)))
    var = F.col("var") * (F.col("n_obs") - 1) / F.col("n_obs")
    return s.select("feature", "mean", var.alias("var"), safe_divide(var, F.col("mean")).alias("fano"), safe_divide(F.sqrt(var), F.col("mean")).alias("cv"))


def fano_variable_features(x: DataFrame, minimal_mean: float = 0.5, top: int = 20) -> DataFrame:
    """Fano factor against its expectation A^2 mean + B^2: A from the steadiest frequent features, B from the middle of the others."""
    s = fano_factors(x).filter("mean > 0")
    a = s.orderBy(F.desc("mean"), "feature").limit(top).agg(F.min("cv").alias("a"))
    q = s.agg(*[F.percentile(c, p).alias(f"{c}{k}") for c in ("mean", "fano") for k, p in (("_lo", 0.1), ("_hi", 0.9))])
    box = s.join(F.broadcast(q)).filter("mean between mean_lo and mean_hi and fano between fano_lo and fano_hi").agg(F.sqrt(F.median("fano")).alias("b"))
    e = s.join(F.broadcast(a)).join(F.broadcast(box)).withColumn("expected", F.col("a") ** 2 * F.col("mean") + F.col("b") ** 2).withColumn("ratio", safe_divide(F.col("fano"), F.col("expected")))
    t = e.agg((1 + F.stddev_pop("fano")).alias("t"))
    return e.join(F.broadcast(t)).select("feature", "mean", "fano", "expected", "ratio", ((F.col("ratio") > F.col("t")) & (F.col("mean") >= minimal_mean)).alias("selected"))


def factor_quantile(x: DataFrame, p: float = 0.75) -> DataFrame:
    """The p-quantile of each row, zeros included, over the row's sum."""
    rows = x.groupBy("obs").agg(F.sum("value").alias("lib"))
    q = densify(x).groupBy("obs").agg(F.percentile("value", p).alias("q"))
    return q.join(rows, "obs").select("obs", safe_divide(F.col("q"), F.col("lib")).alias("factor"))


def factor_rle(x: DataFrame) -> DataFrame:
    """Median over features of value by geometric mean, over features that every observation has."""
    n = F.broadcast(n_obs_of(x))
    gm = x.filter("value > 0").groupBy("feature").agg(F.exp(F.avg(F.ln("value"))).alias("gm"), F.count("*").alias("c")).join(n).filter("c = n_obs").select("feature", "gm")
    return x.join(gm, "feature").groupBy("obs").agg(F.median(F.col("value") / F.col("gm")).alias("factor"))


def factor_tmm(x: DataFrame, reference, log_ratio_trim: float = 0.3, sum_trim: float = 0.05) -> DataFrame:
    """Weighted mean of log ratios to a reference observation after trimming the low tails by ratio and by abundance."""
    lib = x.groupBy("obs").agg(F.sum("value").alias("n"))
    d = x.filter("value > 0").join(lib, "obs")
    r = d.filter(F.col("obs") == F.lit(reference)).select("feature", F.col("value").alias("rv"), F.col("n").alias("rn"))
    u, v = safe_divide(F.col("value"), F.col("n")), safe_divide(F.col("rv"), F.col("rn"))
    pair = d.join(r, "feature").select("obs", "feature", F.log2(u / v).alias("m"), ((F.log2(u) + F.log2(v)) / 2).alias("a"), (safe_divide(F.col("n") - F.col("value"), F.col("n")) / F.col("value") + safe_divide(F.col("rn") - F.col("rv"), F.col("rn")) / F.col("rv")).alias("w"))
    by = Window.partitionBy("obs")
    ranked = pair.withColumn("c", F.count("*").over(by)).withColumn("rm", F.row_number().over(by.orderBy("m", "feature"))).withColumn("ra", F.row_number().over(by.orderBy("a", "feature")))
    kept = ranked.filter((F.col("rm") >= F.floor(F.col("c") * log_ratio_trim) + 1) & (F.col("ra") >= F.floor(F.col("c") * sum_trim) + 1))
    f = kept.groupBy("obs").agg(F.pow(F.lit(2.0), safe_divide(F.sum(F.col("m") / F.when(F.col("w") > 0, F.col("w"))), F.sum(1 / F.when(F.col("w") > 0, F.col("w"))), 0.0)).alias("factor"))
    return observations(x).join(f, "obs", "left").select("obs", F.coalesce("factor", F.lit(1.0)).alias("factor"))


def scaled_to_unit_mean(factors: DataFrame) -> DataFrame:
    """Factors over their geometric mean."""
    g = factors.filter("factor > 0").agg(F.exp(F.avg(F.ln("factor"))).alias("g"))
    return factors.join(F.broadcast(g)).select("obs", safe_divide(F.col("factor"), F.col("g")).alias("factor"))


def library_offset(x: DataFrame, factors: DataFrame | None = None) -> DataFrame:
    """ln of the library size (times factor); an empty library has offset 0."""
    lib = x.groupBy("obs").agg(F.sum("value").alias("s"))
    lib = lib.join(factors, "obs", "left") if factors is not None else lib.withColumn("factor", F.lit(1.0))
    t = F.col("s") * F.coalesce("factor", F.lit(1.0))
    return lib.select("obs", F.when(t > 0, F.ln(t)).otherwise(0.0).alias("offset"))


def shuffle_rows(x: DataFrame, seed: int, replace: bool = False) -> DataFrame:
    """Observations' rows dealt to other observations by a hash order, or drawn with replacement."""
    ids = observations(x)
    to = hash_rank(ids, [], F.xxhash64(F.lit(seed), "obs"), ["obs"], "k").select(F.col("obs").alias("to"), "k")
    from_ = numbered(ids, ["obs"], "k").select("obs", "k")
    if replace:
        n = F.broadcast(ids.agg(F.count("*").alias("n")))
        to = to.join(n).select("to", (F.pmod(F.xxhash64(F.lit(seed + 1), "to"), F.col("n")) + 1).alias("k"))
    return x.join(from_.join(to, "k"), "obs").select(F.col("to").alias("obs"), "feature", "value")


def diagonal_coordinate(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Distance along the diagonal of the bounding box, from its lower corner; 0 where all points are equal."""
    b = points.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    t = safe_divide((F.col(x) - F.col("x0")) * dx + (F.col(y) - F.col("y0")) * dy, F.sqrt(dx * dx + dy * dy), 0.0)
    return points.join(F.broadcast(b)).withColumn("along", t).drop("x0", "x1", "y0", "y1")


def split_slices(points: DataFrame, axis: str, parts: int, key: str) -> DataFrame:
    """Consecutive chunks of equal count along an axis; the remainder is dropped, so with fewer rows than parts all are."""
    n = F.broadcast(points.agg(F.floor(F.count("*") / parts).alias("k_")))
    p = numbered(points, [axis, key], "rn_").join(n).filter("k_ > 0")
    return p.withColumn("slice", F.floor(F.try_divide(F.col("rn_") - 1, F.col("k_"))).cast("int")).filter(F.col("slice") < parts).drop("rn_", "k_", "part_")


def running_offset(frames: DataFrame, key: str, value: str) -> DataFrame:
    """Sum of the values of earlier keys."""
    w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return frames.withColumn("offset", F.coalesce(F.sum(value).over(w), F.lit(0)))


def winsor_floor(df: DataFrame, column: str, q: float = 0.997) -> DataFrame:
    """Values cut at a quantile, then rounded down."""
    t = F.broadcast(df.agg(F.percentile(column, q).alias("t_")))
    return df.join(t).withColumn(column, F.floor(F.least(F.col(column), F.col("t_")))).drop("t_")


def integrate(frames: list[DataFrame], names: list[str], column: str = "batch", fill: float = 0.0) -> DataFrame:
    """All rows of all frames with their batch; columns that a frame lacks are filled."""
    out = frames[0].withColumn(column, F.lit(names[0]))
    for f, n in zip(frames[1:], names[1:], strict=True):
        out = out.unionByName(f.withColumn(column, F.lit(n)), allowMissingColumns=True)
    return out.fillna(fill)
