"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target number of words: its weight's share of all words, at most ``most`` times its own words, what
exceeds that being reshared by weight. A document wants ``target / own`` copies; the whole part is given, the fraction is
rounded: two documents with fractions p and q and sizes s and t move words between each other, at random in one of the two
directions that leave both expectations as they are, until one of them is integral. The other one is paired on. So the
words of a source stay at its target up to one document, whatever the choices.

The pairing is a tree: groups of at most about ``FAN`` documents leave one residual each, residuals form the next groups.
Everything is a DataFrame expression. Rows that agree in source, key and size are counted before the first shuffle and
rounded as one, so repeated rows and hot sources reach no task whole; random numbers are hashes of the keys and a seed, so
reruns agree whatever the partitions.

Defined edge cases: null texts have size 0; documents of size 0 are kept with no words taken; a null source is a source of
its own and comes last; repeated rows are documents of their own; an empty table gives an empty table; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, word_count, written

FAN = 64
#: Up to so many sources, their table (three numbers each) is broadcast; beyond, it is joined by shuffling. Their targets come from one task in any case.
BROADCAST_SOURCES = 10_000
EPS = 1e-9
#: Copies of a repeated row that one task writes at once.
AT_ONCE = 4096


def targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """source, source_size, n, weight, target from rows of (source, size, n): by code point, null last, the weights repeating.

    Resharing what exceeds the caps until none is above has one fixed point: min(cap, level * weight) for the level at
    which these sum to the total. Sources in order of cap / weight are capped up to some point; window sums find it.
    """
    own = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"), F.sum("n").cast("long").alias("n"))
    placed = own.withColumn("at", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    each = F.array(*[F.lit(float(w)) for w in weights])
    w = placed.withColumn("weight", F.element_at(each, (F.col("at") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    w = w.withColumn("ratio", F.col("cap") / F.col("weight"))
    before = Window.orderBy("ratio", "at").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("ratio", "at").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    w = w.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    w = w.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    # the first source whose cap isn't reached by the level of all from it on
    w = w.withColumn("fits", F.when(F.col("level") <= F.col("ratio"), F.col("level")))
    w = w.withColumn("final", F.min_by("fits", F.when(F.col("fits").isNotNull(), F.struct("ratio", "at"))).over(everything))
    return w.select("source", "source_size", "n", "weight", F.least(F.col("cap"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap"))).alias("target"))


def _uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def _let(value: Column, then) -> Column:
    """then(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _pair(seed: int):
    """Fold of a group's units (size, h, id, p), the largest first so that small ones even out what they leave: one unit stays in ``rest``, decided ones gather in ``done``."""

    unit = lambda x, v: F.struct(x["size"].alias("size"), x.h.alias("h"), x.id.alias("id"), v.alias("p"))
    near = lambda v: F.least(v, 1 - v)

    def moved(a: Column, b: Column) -> Column:
        up = F.least((1 - a.p) * a["size"], b.p * b["size"])
        down = F.least(a.p * a["size"], (1 - b.p) * b["size"])
        words = F.when(up + down <= EPS, F.lit(0.0)).when(_uniform(F.lit(seed), a.h, b.h) * (up + down) < down, up).otherwise(-down)
        return _let(words, lambda w: F.array(unit(a, a.p + w / a["size"]), unit(b, b.p - w / b["size"])))

    def settled(two: Column, acc: Column) -> Column:
        first = near(two[0].p) <= near(two[1].p)  # the more integral one is decided
        done = F.when(first, two[0]).otherwise(two[1])
        return F.struct(F.when(first, two[1]).otherwise(two[0]).alias("rest"), F.array_append(acc.done, F.struct(done.id.alias("id"), F.round(done.p).cast("long").alias("extra"))).alias("done"))

    def step(acc: Column, b: Column) -> Column:
        return F.when(acc.rest.isNull(), F.struct(b.alias("rest"), acc.done.alias("done"))).otherwise(_let(moved(acc.rest, b), lambda two: settled(two, acc)))

    return step


def rounded(units: DataFrame, seed: int = 0) -> DataFrame:
    """id, extra (0 or 1) for units (source, id, h, size double > 0, p strictly between 0 and 1, n units of the source)."""
    kind = "struct<size:double,h:bigint,id:struct<source:string,key:bigint,size:bigint>,p:double>"
    top = units.agg(F.max("n").alias("n")).first()["n"] or 0
    groups = lambda n: F.greatest(F.lit(1), F.ceil(n / FAN)).cast("long")
    rows = units.select("source", F.pmod(F.col("h"), groups(F.col("n"))).alias("g"), F.struct("size", "h", "id", "p").cast(kind).alias("unit"))
    out, level, left = [], 0, max(1, math.ceil(top / FAN))
    while True:
        start = F.struct(F.lit(None).cast(kind).alias("rest"), F.array().cast("array<struct<id:struct<source:string,key:bigint,size:bigint>,extra:bigint>>").alias("done"))
        folded = rows.groupBy("source", "g").agg(F.sort_array(F.collect_list("unit"), asc=False).alias("units"))
        folded = folded.select("source", "g", F.aggregate("units", start, _pair(seed + level)).alias("f"))
        out.append(folded.select(F.inline("f.done")))
        rest = folded.select("source", "g", F.col("f.rest").alias("unit"))
        if left == 1:
            break
        rows, left, level = rest.withColumn("g", F.floor(F.col("g") / FAN).cast("long")), math.ceil(left / FAN), level + 1
    out.append(rest.select(F.col("unit.id").alias("id"), F.round(F.col("unit.p")).cast("long").alias("extra")))  # one document a source: to the nearer side
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole


def plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=(5, 2, 1), share: float = 1.0, most: float = 3.0, seed: int = 0) -> DataFrame:
    """One row for each distinct (source, key, size): m rows have it; each gets ``base`` copies, the first ``more`` of them one more.

    Columns: source, key, size, m, source_size, target, base, more.
    """
    slim = docs.select(F.col(source).cast("string").alias("source"), F.col(key).cast("long").alias("key"), word_count(F.col(text)).alias("size"))
    same = cut(slim.groupBy("source", "key", "size").agg(F.count("*").alias("m")))
    goal = targets(same.select("source", "size", F.col("m").alias("n")), weights, share, most).withColumnRenamed("source", "source_")
    few = goal.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    goal = F.broadcast(goal) if few else goal
    rows = same.join(goal, F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_", "weight")
    factor = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    rows = rows.withColumn("want", F.when(F.col("size") > 0, F.least(factor, F.lit(float(most)))).otherwise(0.0))
    rows = rows.withColumn("base", F.floor(F.col("want") + EPS).cast("long"))
    rows = rows.withColumn("extra_", F.greatest(F.lit(0.0), F.col("want") - F.col("base")) * F.col("m"))
    rows = rows.withColumn("sure", F.floor(F.col("extra_") + EPS).cast("long")).withColumn("p", F.greatest(F.lit(0.0), F.col("extra_") - F.col("sure")))
    ident = F.struct(F.col("source"), F.col("key"), F.col("size"))
    units = rows.filter((F.col("p") > EPS) & (F.col("size") > 0)).select("source", ident.alias("id"), F.xxhash64(F.lit(seed), "source", "key", "size").alias("h"), F.col("size").cast("double").alias("size"), "p", "n")
    chosen = rounded(units, seed).filter("extra > 0").select(F.col("id.source").alias("s_"), F.col("id.key").alias("k_"), F.col("id.size").alias("z_"), "extra")
    on = F.col("source").eqNullSafe(F.col("s_")) & F.col("key").eqNullSafe(F.col("k_")) & (F.col("size") == F.col("z_"))
    return rows.join(chosen, on, "left").select("source", "key", "size", "m", "source_size", "target", "base", (F.col("sure") + F.coalesce("extra", F.lit(0))).alias("more"))


def taken(planned: DataFrame) -> DataFrame:
    """One row for each document: key, source, size, source_size, target, copies, taken."""
    m = F.col("m")
    few = planned.filter(m <= AT_ONCE).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), m)))
    # a row that repeats often is spread over tasks in pieces first
    spread = int(planned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = planned.filter(m > AT_ONCE).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((m - 1) / AT_ONCE)))).repartition(spread, "source", "key", "piece")
    ends = F.least(m, (F.col("piece") + 1) * AT_ONCE)
    many = many.withColumn("i", F.explode(F.sequence(F.col("piece") * AT_ONCE + 1, ends))).drop("piece")
    each = few.unionByName(many)
    copies = F.col("base") + (F.col("i") <= F.col("more")).cast("long")
    return each.select("key", "source", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **given) -> DataFrame:
    """The documents themselves, each row as often as the mix takes it; documents of size 0 carry no words and stay once.

    Rows that agree in source, key and size are numbered part by part, with the counts of the parts before, so no such
    group stands in one window.
    """
    planned = plan(docs, key, text, source, **given).select(F.col("source").alias("s"), F.col("key").alias("k"), F.col("size").alias("z"), "m", "base", "more")
    names = docs.columns
    own = [f"c{i}" for i in range(len(names))]
    at = {c: F.col(own[names.index(c)]) for c in (key, text, source)}
    rows = docs.toDF(*own).withColumns({"src": at[source].cast("string"), "key": at[key].cast("long"), "size": word_count(at[text])})
    on = F.col("src").eqNullSafe(F.col("s")) & F.col("key").eqNullSafe(F.col("k")) & (F.col("size") == F.col("z"))
    rows = rows.join(planned, on).drop("s", "k", "z")
    once = rows.filter("m = 1").withColumn("i", F.lit(1).cast("long"))
    again = written(rows.filter("m > 1").withColumn("part", F.spark_partition_id()))
    same = ["src", "key", "size", "part"]
    counted = again.groupBy(*same).agg(F.count("*").alias("c"))
    before = Window.partitionBy("src", "key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("ahead", F.coalesce(F.sum("c").over(before), F.lit(0))).select(*(F.col(c).alias(f"{c}_") for c in same), "ahead")
    on = F.col("src").eqNullSafe(F.col("src_")) & F.col("key").eqNullSafe(F.col("key_")) & (F.col("size") == F.col("size_")) & (F.col("part") == F.col("part_"))
    again = again.withColumn("i", F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0))))
    again = again.join(counted, on).withColumn("i", F.col("i") + F.col("ahead")).select(*once.columns)
    copies = F.when(F.col("size") == 0, 1).otherwise(F.col("base") + (F.col("i") <= F.col("more")).cast("long"))
    rows = once.unionByName(again).withColumn("copies", copies).filter("copies > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select(*[F.col(c).alias(name) for c, name in zip(own, names, strict=True)])
