"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side is broadcast only if it was counted and has at most this many slim rows.
BROADCAST_ROWS = 2_000_000
#: Slim rows of one file of a scratch table whose size is known, and files at least.
FILE_ROWS, LEAST_FILES = 50_000, 6


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir; where that is unset one of our own, but only if driver and
    executors are one process: on a cluster each would write to its own disk."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = "file://" + tempfile.mkdtemp(prefix="peakfold-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def bounded_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Have Spark hand Python at most `most` bytes at once (a longer row comes alone), so that memory outside the heap
    doesn't depend on how long texts are.  A smaller bound of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key, "64m"))
    if now > most:
        spark.conf.set(key, str(most))


class Scratch:
    """Tables written to the shared folder, so that lineage is cut and a lost executor costs one stage.

    Results read them lazily, so they stay until `clean_up` is called or the cluster clears its checkpoint folder.
    """

    roots: list[str] = []
    #: Catalog tables that name files of scratch tables.
    tables: list[str] = []

    def __init__(self, spark: SparkSession, tag: str):
        bounded_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        self.n = 0
        Scratch.roots.append(self.root)

    def save(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """Write and reread.  `rows`: a bound on the rows, if known, which then go to a file for every FILE_ROWS."""
        self.n += 1
        if rows is not None:
            df = df.coalesce(max(LEAST_FILES, -(-rows // FILE_ROWS)))
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for t in tables:
            delete_path(self.spark, t._scratch_path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clean_up(spark: SparkSession) -> None:
    """Delete all scratch tables of this process; results that weren't written yet can't be read afterwards."""
    while Scratch.tables:
        spark.sql(f"DROP TABLE IF EXISTS {Scratch.tables.pop()}")
    while Scratch.roots:
        delete_path(spark, Scratch.roots.pop())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def maybe_broadcast(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a counted side if it is small; else Spark shuffles both sides."""
    return F.broadcast(df) if rows <= most else df


def dense_index(df: DataFrame, group: list[str], bucket: Column, order: list[Column], out: str, amount: Column | None = None) -> DataFrame:
    """Add `out`: gapless index from 0 (or running sum of `amount` before the row) within `group`.

    Rows are ordered by (bucket, order).  Only one (group, bucket) is sorted in a task; the offsets of buckets come from
    their counts, so a group may hold any share of the rows.  Names starting with two underscores are ours.
    """
    add = F.lit(1) if amount is None else amount
    x = df.withColumn("__b", bucket).withColumn("__a", add.cast("long"))
    within = Window.partitionBy(*group, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("__i", F.coalesce(F.sum("__a").over(within), F.lit(0)))
    sums = df.select(*group, bucket.alias("__b"), add.cast("long").alias("__a")).groupBy(*group, "__b").agg(F.sum("__a").alias("__t"))
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*group, "__b", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__o"))
    return x.join(offsets, [*group, "__b"]).withColumn(out, F.col("__i") + F.col("__o")).drop("__b", "__a", "__i", "__o")
