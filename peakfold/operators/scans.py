"""Scans, filters and projections.  Every predicate is a plain comparison of columns, so it reaches the Parquet scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def covering(df: DataFrame, point: float, low: str, high: str) -> DataFrame:
    """Rows whose closed interval [low, high] holds a point."""
    return df.where((F.col(low) <= point) & (F.col(high) >= point))


def overlapping(df: DataFrame, start: float, stop: float, low: str, high: str) -> DataFrame:
    """Rows whose closed interval meets [start, stop]."""
    return df.where((F.col(low) <= stop) & (F.col(high) >= start))


def between(df: DataFrame, column: str, low, high) -> DataFrame:
    return df.where(F.col(column).between(low, high))


def subset(df: DataFrame, **members) -> DataFrame:
    """Rows that match any of the given sets (column=values); array columns match by overlap; without a set, all rows."""
    any_of = None
    for name, values in members.items():
        if values:
            array = df.schema[name].dataType.typeName() == "array"
            one = F.arrays_overlap(F.col(name), F.array(*[F.lit(v) for v in values])) if array else F.col(name).isin(list(values))
            any_of = one if any_of is None else any_of | one
    return df if any_of is None else df.where(any_of)


def enough_rows(df: DataFrame, key: list[str], least: int) -> DataFrame:
    """Rows of keys with at least `least` rows."""
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least).drop("__n")
    return df.join(counts, key, "left_semi")


def top_per_bin(df: DataFrame, group: list[str], x: str, weight: str, width: float, n: int, tie: list[str]) -> DataFrame:
    """The n heaviest rows of each bin of x."""
    w = Window.partitionBy(*group, "__bin").orderBy(F.desc(weight), *tie)
    binned = df.withColumn("__bin", F.floor(F.col(x) / width))
    return binned.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__bin", "__r")


def island_around(df: DataFrame, group: list[str], order: str, centre: Column, probability: str, least: float = 0.5) -> DataFrame:
    """Per group the unbroken stretch of rows with probability >= least that holds the row nearest to `centre`."""
    w = Window.partitionBy(*group).orderBy(order)
    x = df.withColumn("__bad", (F.col(probability) < least).cast("int")).withColumn("__run", F.sum("__bad").over(w))
    nearest = x.groupBy(*group).agg(F.min_by(F.struct("__run", "__bad"), F.struct(F.abs(F.col(order) - centre), F.col(order))).alias("__at"))
    x = x.join(nearest, group)
    return x.where((F.col("__bad") == 0) & (F.col("__at.__bad") == 0) & (F.col("__run") == F.col("__at.__run"))).drop("__bad", "__run", "__at")


def gate(primary: Column, evidence: Column, least: float = 0.25) -> Column:
    """0 where the evidence is under a share of the primary score."""
    return F.when(F.try_divide(evidence, primary) < least, F.lit(0.0)).otherwise(primary)


def downsample_windows(scans: DataFrame, coarse: DataFrame) -> DataFrame:
    """Merge the scans of each cycle inside coarser windows: scans (cycle, low, high, rt, time), coarse (window, low, high).

    rt is the mean and time the sum; the scan that closes a cycle belongs to the next one.  `coarse` is a dimension of a
    few hundred rows that is checked before it is broadcast.
    """
    from peakfold.operators.joins import small_side

    c = coarse.select("window", F.col("low").alias("clow"), F.col("high").alias("chigh"))
    inside = scans.join(small_side(c), (F.col("low") >= F.col("clow")) & (F.col("high") <= F.col("chigh")))
    return inside.groupBy("cycle", "window").agg(F.avg("rt").alias("rt"), F.sum("time").alias("time"), F.count(F.lit(1)).alias("n"))


def mask_by_targets(scans: DataFrame, targets: DataFrame, half_width: float = 0.35) -> DataFrame:
    """Scans that some target hits: scans (mz, rt), targets (mz, start, stop)."""
    from peakfold.operators.joins import range_semi

    t = targets.select((F.col("mz") - half_width).alias("t_low"), (F.col("mz") + half_width).alias("t_high"), F.col("start").alias("t_start"), F.col("stop").alias("t_stop")).distinct()
    return range_semi(scans, t, "mz", "t_low", "t_high", 2 * half_width, F.col("rt").between(F.col("t_start"), F.col("t_stop")))
