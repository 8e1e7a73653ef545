"""Readers of the platforms' text formats into long tables, and sinks. Schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Names by which count columns go.
ALIASES = {"MIDCount": "total", "MIDCounts": "total", "UMICount": "total", "UMICounts": "total", "EXONIC": "spliced", "INTRONIC": "unspliced", "geneID": "gene"}


def reads_tsv(spark: SparkSession, path: str, label: str | None = None) -> DataFrame:
    """Tab-separated reads (gene, x, y, total[, spliced, unspliced][, label]) with # comments; two names for one column are an error."""
    raw = spark.read.csv(path, sep="\t", comment="#", header=True)
    names = [ALIASES.get(c, c) for c in raw.columns]
    if twice := {n for n in names if names.count(n) > 1}:
        raise ValueError(f"several columns for {sorted(twice)}")
    if missing := {"gene", "x", "y", "total"} - set(names):
        raise ValueError(f"no column for {sorted(missing)}")
    df = raw.toDF(*names)
    ints = [c for c in ("x", "y", "total", "spliced", "unspliced") if c in names]
    extra = [F.col(label).cast("int").alias("label")] if label else []
    return df.select("gene", *[F.col(c).cast("int").alias(c) for c in ints], *extra)


def transcripts_csv(spark: SparkSession, path: str, labels: list[str] | None = None) -> DataFrame:
    """One row a molecule: gene, x, y[, label] with labels joined by '-'."""
    d = spark.read.csv(path, header=True)
    own = [F.concat_ws("-", *labels).alias("label")] if labels else []
    return d.select(F.col("target").alias("gene"), F.col("x_global_px").cast("double").alias("x"), F.col("y_global_px").cast("double").alias("y"), F.lit(1).alias("total"), *own)


def molecules_to_counts(molecules: DataFrame) -> DataFrame:
    return molecules.groupBy(F.col("label").alias("obs"), F.col("gene").alias("feature")).agg(F.count("*").cast("double").alias("value"))


def wide_counts(spark: SparkSession, path: str, sep: str = "\t", gene: str | None = None) -> DataFrame:
    """A genes x barcodes table as long counts without zeros."""
    d = spark.read.csv(path, sep=sep, header=True)
    g = gene or d.columns[0]
    others = [c for c in d.columns if c != g]
    d = d.select(F.col(g).alias("feature"), *[F.col(f"`{c}`").cast("double").alias(c) for c in others])
    return d.unpivot(["feature"], [F.col(f"`{c}`") for c in others], "obs", "value").filter("value > 0").select("obs", "feature", "value")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(number, value): text lines numbered from 0, files by path; splits are counted, so no task sees all lines."""
    t = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file_"), F.col("_metadata.file_block_start").alias("block_"), F.monotonically_increasing_id().alias("id_"))
    counts = t.groupBy("file_", "block_").agg(F.count("*").alias("c_"))
    before = Window.orderBy("file_", "block_").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    counts = counts.select("file_", "block_", F.coalesce(F.sum("c_").over(before), F.lit(0)).alias("ahead_"))
    within = F.row_number().over(Window.partitionBy("file_", "block_").orderBy("id_")) - 1
    return t.join(counts, ["file_", "block_"]).select((F.col("ahead_") + within).alias("number"), "value")


def headerless_counts(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(i, j, value) of a plain matrix file; a row's number is that of its line."""
    return lines(spark, path).select(F.col("number").alias("i"), F.posexplode(F.split("value", sep)).alias("j", "value")).select("i", "j", F.col("value").cast("double").alias("value")).filter("value <> 0")


def matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, value), counted from 1, of a coordinate file; comments and the size line are left out."""
    t = lines(spark, path).filter(~F.col("value").startswith("%"))
    p = F.split(F.trim("value"), r"\s+")
    rows = t.select(p[0].cast("long").alias("row"), p[1].cast("long").alias("col"), p[2].cast("double").alias("value"), F.col("number").alias("n_"))
    return rows.join(F.broadcast(rows.agg(F.min("n_").alias("first_")))).filter("n_ <> first_").drop("n_", "first_")


def numbered_lines(spark: SparkSession, path: str, names: list[str], sep: str = "\t") -> DataFrame:
    """Lines of a dictionary file with their number from 1."""
    t = lines(spark, path)
    p = F.split("value", sep)
    return t.select((F.col("number") + 1).alias("number"), *[p[i].alias(n) for i, n in enumerate(names)])


def counts_from_market(matrix: DataFrame, features: DataFrame, barcodes: DataFrame, key: str = "gene_id") -> DataFrame:
    """Long counts from a genes x barcodes matrix and its two dictionaries."""
    return matrix.join(features.select(F.col("number").alias("row"), F.col(key).alias("feature")), "row").join(barcodes.select(F.col("number").alias("col"), F.col("barcode").alias("obs")), "col").groupBy("obs", "feature").agg(F.sum("value").alias("value"))


TISSUE = "barcode string, in_tissue int, array_row int, array_col int, y double, x double"


def tissue_positions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=TISSUE)


def whitespace_positions(spark: SparkSession, path: str) -> DataFrame:
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(p[0].alias("barcode"), *[p[i + 1].cast("long").alias(n) for i, n in enumerate(("lane", "tile", "x", "y"))])


def bead_positions(spark: SparkSession, path: str) -> DataFrame:
    """Barcode, x, y with or without a header line."""
    p = F.split("value", ",")
    return spark.read.text(path).select(p[0].alias("barcode"), p[1].try_cast("double").alias("x"), p[2].try_cast("double").alias("y")).filter("x is not null")


def with_positions(x: DataFrame, positions: DataFrame, strict: bool = True) -> DataFrame:
    """Counts with their barcode's position; with strict, a barcode without one is an error."""
    p = positions.withColumnRenamed("barcode", "obs")
    if strict and (lost := x.select("obs").distinct().join(p, "obs", "left_anti").limit(1).collect()):
        raise ValueError(f"no position for {lost[0]['obs']!r}")
    return x.join(p, "obs")


def frames_of_view(cells: DataFrame, offsets: DataFrame | None = None, accumulate: bool = False) -> DataFrame:
    """Cells (fov, cell_id, x, y) moved by their field's offset (fov, x_offset, y_offset), summed over earlier fields if asked; whole coordinates."""
    if offsets is None:
        return cells
    o = offsets
    if accumulate:
        w = Window.orderBy("fov")
        o = o.select("fov", F.sum("x_offset").over(w).alias("x_offset"), F.sum("y_offset").over(w).alias("y_offset"))
    return cells.join(F.broadcast(o), "fov").withColumns({"x": (F.col("x") + F.col("x_offset")).cast("int"), "y": (F.col("y") + F.col("y_offset")).cast("int")}).drop("x_offset", "y_offset")


def shifted_to_origin(points: DataFrame, axes=("x", "y")) -> DataFrame:
    """Coordinates less the smallest of all axes."""
    lo = points.agg(F.least(*[F.min(a) for a in axes]).alias("lo_"))
    return points.join(F.broadcast(lo)).withColumns({a: F.col(a) - F.col("lo_") for a in axes}).drop("lo_")


def labels_in_range(px: DataFrame, low: int, high: int) -> DataFrame:
    """Pixels of labels whose area lies strictly between two bounds, without the largest label."""
    ok = px.filter("label <> 0").groupBy("label").agg(F.count("*").alias("a")).filter((F.col("a") > low) & (F.col("a") < high))
    top = F.broadcast(px.agg(F.max("label").alias("top")))
    return px.join(ok.select("label"), "label", "left_semi").join(top).filter("label < top").drop("top")


def images(spark: SparkSession, path: str) -> DataFrame:
    """Path and bytes of image files; decoding is left to the caller."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def write_table(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None, mode: str = "errorifexists") -> None:
    w = df.write.mode(mode)
    w = w.partitionBy(*by) if by else w
    (w.option("header", True) if kind == "csv" else w).format(kind).save(path)
