"""What the corpus operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of other characters than these.
BLANKS = r"\x20\x09-\x0D"
WORD = rf"[^{BLANKS}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors reach; only where it is unset and the master is local, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        found = tempfile.mkdtemp(prefix="loomgrid-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, *partition_by: str, path: str | None = None) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read again; a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = path or f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables in the shared folder that only intermediate steps read; drop() deletes them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.names = spark, [], []
        self.tables: dict[int, str] = {}

    def path(self) -> str:
        self.paths.append(f"{shared_dir(self.spark).rstrip('/')}/table-{uuid.uuid4().hex}")
        return self.paths[-1]

    def written(self, df: DataFrame, *partition_by: str) -> DataFrame:
        out = written(df, *partition_by, path=self.path())
        self.tables[id(out)] = self.paths[-1]
        return out

    def bucketed(self, df: DataFrame, *keys: str) -> DataFrame:
        """The same rows in as many buckets as shuffles have partitions: joins by these keys move only the other side."""
        self.names.append(f"loomgrid_{uuid.uuid4().hex}")
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.format("parquet").bucketBy(n, *keys).option("path", self.path()).saveAsTable(self.names[-1])
        return self.spark.table(self.names[-1])

    def drop(self, *tables: DataFrame, but: Sequence[DataFrame] = ()) -> None:
        """Deletes these tables, or all but those, when nothing reads them any more; then files of shuffles without use go too.

        Spark deletes a shuffle's files when its plan is no longer reachable in the driver, which it learns from the JVM's
        collector only; that one seldom runs on a driver with little to do.
        """
        kept = {self.tables[id(t)] for t in but}
        gone = [self.tables[id(t)] for t in tables] if tables else [p for p in self.paths if p not in kept]
        if not tables:
            for name in self.names:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self.names = []
        for path in gone:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        self.paths = [p for p in self.paths if p not in gone]
        gc.collect()
        self.spark._jvm.System.gc()


#: Bits of the bitmaps that tell which rows a later step needs.
BITS = 1 << 25


def bits_of(hashes: DataFrame) -> np.ndarray:
    """A bitmap of BITS bits, with those of the hashes in the only column set; its size doesn't depend on the rows."""
    h = F.pmod(F.col(hashes.columns[0]), F.lit(BITS))
    got = hashes.select(F.bitmap_bucket_number(h + 1).alias("b"), F.bitmap_bit_position(h + 1).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits")).collect()
    out = np.zeros(BITS // 8 + 4096, np.uint8)
    for r in got:
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[(r["b"] - 1) * 4096 : (r["b"] - 1) * 4096 + len(part)] = part
    return out


def has_bit(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (bits[x >> 3] >> (x & 7).astype(np.uint8) & 1).astype(bool)


def passing(bits: np.ndarray, wanted: bool):
    """A mapInArrow function that drops the column ``bit`` and passes on the rows whose bit is set, or those whose bit isn't."""

    def each(batches):
        for batch in batches:
            has = has_bit(bits, batch.column("bit").to_numpy()) == wanted
            yield batch.filter(pa.array(has)).drop_columns(["bit"])

    return each


def remainder(column: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def word_count(text: Column) -> Column:
    """Number of words (long); null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
