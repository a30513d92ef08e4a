"""Ordered-window operators over traces (key, order, value): smoothing, baselines, areas, centroids, ranks.

Each is a window expression or an aggregate; the ones that carry state from row to row are in kernels.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def over(key: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*key).orderBy(*order)


def forward_sum(df: DataFrame, key: list[str], order: list[str], value: str, width: int, out: str = "moving_sum") -> DataFrame:
    """Sum of `width` rows from each row on; the last `width` rows of a trace of n have no sum, so n - width remain."""
    w = over(key, order)
    x = df.withColumn(out, F.sum(value).over(w.rowsBetween(0, width - 1))).withColumn("__left", F.count(F.lit(1)).over(w.rowsBetween(1, width)))
    return x.where(F.col("__left") == width).drop("__left")


def centred_sum(value: str, w: WindowSpec, width: int) -> Column:
    """Sum over a centred frame, cut off at the ends."""
    half = (width - 1) // 2
    return F.sum(value).over(w.rowsBetween(-half, width - 1 - half))


def centred_average(value: str, w: WindowSpec, width: int) -> Column:
    """The cut-off sum over the full width."""
    return centred_sum(value, w, width) / width


def filled_average(df: DataFrame, key: list[str], order: list[str], value: str, width: int, out: str, median: bool = False) -> DataFrame:
    """Centred average (or median) whose ends hold the first and last full frame; a trace of at most `width` rows holds its mean."""
    w = over(key, order)
    whole = Window.partitionBy(*key)
    half = (width - 1) // 2
    frame = w.rowsBetween(-half, width - 1 - half)
    stat = F.percentile(value, F.lit(0.5)).over(frame) if median else F.avg(value).over(frame)
    x = df.withColumn("__n", F.count(F.lit(1)).over(whole)).withColumn("__i", F.row_number().over(w) - 1).withColumn("__s", stat)
    at = lambda k: F.max(F.when(F.col("__i") == k, F.col("__s"))).over(whole)
    last = F.col("__n") - 1 - (width - 1 - half)
    x = x.withColumn("__f", at(F.lit(half))).withColumn("__l", at(last)).withColumn("__m", F.avg(value).over(whole))
    filled = F.when(F.col("__n") <= width, F.col("__m")).when(F.col("__i") < half, F.col("__f")).when(F.col("__i") > last, F.col("__l")).otherwise(F.col("__s"))
    return x.withColumn(out, filled).drop("__n", "__i", "__s", "__f", "__l", "__m")


def subtract_baseline(df: DataFrame, key: list[str], order: list[str], value: str, width: int, out: str = "corrected", median: bool = True) -> DataFrame:
    """Value less its moving median (or mean), not below 0."""
    x = filled_average(df, key, order, value, width, "__base", median)
    return x.withColumn(out, F.greatest(F.col(value) - F.col("__base"), F.lit(0.0))).drop("__base")


def gaussian_average(value: str, w: WindowSpec, width: int) -> Column:
    """Centred average with Gaussian weights (deviation a sixth of the width), weights of missing rows left out."""
    half, sd = (width - 1) // 2, width / 6
    parts = [(k, math.exp(-0.5 * (k / sd) ** 2)) for k in range(-half, half + 1)]
    num = sum((F.coalesce(F.lead(value, k).over(w) if k >= 0 else F.lag(value, -k).over(w), F.lit(0.0)) * g for k, g in parts), F.lit(0.0))
    den = sum((F.when((F.lead(value, k).over(w) if k >= 0 else F.lag(value, -k).over(w)).isNotNull(), F.lit(g)).otherwise(0.0) for k, g in parts), F.lit(0.0))
    return num / den


# Quadratic Savitzky-Golay coefficients and their divisors.
SAVITZKY_GOLAY = {3: ((1, 1, 1), 3), 5: ((-3, 12, 17, 12, -3), 35), 7: ((-2, 3, 6, 7, 6, 3, -2), 21), 9: ((-21, 14, 39, 54, 59, 54, 39, 14, -21), 231)}


def savitzky_golay(df: DataFrame, key: list[str], order: list[str], value: str, points: int = 9, out: str = "smoothed") -> DataFrame:
    """Smoothed trace, zero beyond the ends and not below 0; traces shorter than the filter stay as they are."""
    w = over(key, order)
    c, by = SAVITZKY_GOLAY[points]
    half = points // 2
    terms = [(F.lag(value, -k, 0.0) if k < 0 else F.lead(value, k, 0.0)).over(w) * c[k + half] for k in range(-half, half + 1)]
    smooth = F.greatest(sum(terms[1:], terms[0]) / by, F.lit(0.0))
    return df.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*key))).withColumn(out, F.when(F.col("__n") < points, F.col(value)).otherwise(smooth)).drop("__n")


def adaptive_savitzky_golay(df: DataFrame, key: list[str], order: list[str], value: str, out: str = "smoothed") -> DataFrame:
    """The widest of the fixed filters that the points above a twentieth of the maximum allow, per trace."""
    whole = Window.partitionBy(*key)
    x = df.withColumn("__top", F.max(value).over(whole)).withColumn("__wide", F.count(F.when(F.col(value) > 0.05 * F.col("__top"), 1)).over(whole))
    for p in (3, 5, 7, 9):
        x = savitzky_golay(x, key, order, value, p, f"__s{p}")
    pick = F.when(F.col("__wide") >= 18, F.col("__s9")).when(F.col("__wide") >= 14, F.col("__s7")).when(F.col("__wide") >= 10, F.col("__s5")).otherwise(F.col("__s3"))
    return x.withColumn(out, pick).drop("__top", "__wide", "__s3", "__s5", "__s7", "__s9")


def derivative(value: str, w: WindowSpec) -> Column:
    return F.col(value) - F.lag(value).over(w)


def trapezoid_area(df: DataFrame, key: list[str], x: str, y: str, background: bool = True) -> DataFrame:
    """Per trace: area by trapezoids, area under the lower end (following the signal where it dips below), their difference."""
    w = over(key, [x])
    ends = df.withColumn("__a", F.first(y).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).withColumn("__z", F.last(y).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ends = ends.withColumn("__low", F.least("__a", "__z")).withColumn("__b", F.least(F.col(y), F.col("__low")))
    step = F.col(x) - F.lag(x).over(w)
    ends = ends.withColumn("__t", step * (F.col(y) + F.lag(y).over(w)) / 2).withColumn("__u", step * (F.col("__b") + F.lag("__b").over(w)) / 2)
    area, under = F.coalesce(F.sum("__t"), F.lit(0.0)), F.coalesce(F.sum("__u"), F.lit(0.0))
    return ends.groupBy(*key).agg(area.alias("area"), under.alias("background"), (area - (under if background else F.lit(0.0))).alias("net"))


def normalize_trace(df: DataFrame, key: list[str], order: list[str], value: str, how: str = "sum", out: str = "normalized") -> DataFrame:
    """By the sum, the maximum, length 1, or the sum after the line between the ends was subtracted ("line")."""
    whole = Window.partitionBy(*key)
    x = df
    if how == "line":
        w = over(key, order)
        full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        x = x.withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", F.count(F.lit(1)).over(whole)).withColumn("__a", F.first(value).over(full)).withColumn("__z", F.last(value).over(full))
        line = F.col("__a") + (F.col("__z") - F.col("__a")) * F.col("__i") / F.greatest(F.col("__n") - 1, F.lit(1))
        top = F.max(value).over(whole)
        skip = (F.col("__a") >= top) | (F.col("__z") >= top)
        x = x.withColumn("__v", F.when(skip, F.col(value)).otherwise(F.greatest(F.col(value) - line, F.lit(0.0)))).drop("__i", "__n", "__a", "__z")
    else:
        x = x.withColumn("__v", F.col(value))
    by = {"sum": F.sum("__v"), "line": F.sum("__v"), "max": F.max("__v"), "l2": F.sqrt(F.sum(F.col("__v") * F.col("__v")))}[how].over(whole)
    return x.withColumn("__d", by).withColumn(out, F.when(F.col("__d") > 0, F.col("__v") / F.col("__d")).otherwise(F.col("__v"))).drop("__v", "__d")


def median_trace(df: DataFrame, key: list[str], order: str, value: str, members: int | None = None) -> DataFrame:
    """Median over the members of each (key, order); with `members`, missing ones count as 0."""
    if members is None:
        return df.groupBy(*key, order).agg(F.percentile(value, F.lit(0.5)).alias("median"))
    padded = F.concat(F.collect_list(F.col(value).cast("double")), F.array_repeat(F.lit(0.0), F.greatest(F.lit(members) - F.count(F.lit(1)).cast("int"), F.lit(0))))
    from peakfold.functions.arrays import quantile

    return df.groupBy(*key, order).agg(padded.alias("__v")).select(*key, order, quantile(F.col("__v"), 0.5).alias("median"))


def trace_correlation(df: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """Pearson correlation of two columns per key, 0 without variance, at most 1."""
    return df.groupBy(*key).agg(F.least(F.lit(1.0), F.coalesce(F.nanvl(F.corr(a, b), F.lit(0.0)), F.lit(0.0))).alias("correlation"), F.count(F.lit(1)).alias("n"))


def correlation_tier(correlation: Column) -> Column:
    """Transition quality: quantitative from 0.9, identifying from 0.75, weak from 0.5."""
    return F.when(correlation >= 0.9, F.lit("quantitative")).when(correlation >= 0.75, F.lit("identifying")).when(correlation >= 0.5, F.lit("weak")).otherwise(F.lit("poor"))


def apex_centroid(df: DataFrame, key: list[str], x: str, y: str, share: float = 0.5) -> DataFrame:
    """Intensity-weighted mean of x over the points of at least a share of the maximum."""
    top = df.groupBy(*key).agg(F.max(y).alias("top"))
    live = df.join(top, key).where(F.col(y) >= share * F.col("top"))
    return live.groupBy(*key).agg((F.sum(F.col(x) * F.col(y)) / F.sum(y)).alias("apex"), F.max("top").alias("top"))


def rank_in_trace(df: DataFrame, key: list[str], value: str) -> DataFrame:
    return df.withColumn("rank", F.rank().over(Window.partitionBy(*key).orderBy(F.desc(value))))


def coeluting(df: DataFrame, key: list[str], order: list[str], hits: str, half: int) -> DataFrame:
    """Hits within a sliding half width, then the sliding maximum of that."""
    w = over(key, order).rowsBetween(-half, half)
    return df.withColumn("__c", F.sum(hits).over(w)).withColumn("coeluting", F.max("__c").over(w)).drop("__c")


def isotope_areas(df: DataFrame, key: list[str], x: str, isotopes: list[str]) -> DataFrame:
    """Trapezoid area of each isotope column."""
    w = over(key, [x])
    step = F.col(x) - F.lag(x).over(w)
    y = df.select(*key, *[(step * (F.col(c) + F.lag(c).over(w)) / 2).alias(c) for c in isotopes])
    return y.groupBy(*key).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in isotopes])


def interpolate_at(knots: DataFrame, queries: DataFrame, key: list[str], x: str, y: str) -> DataFrame:
    """y at the x of each query row, linear between the knots and flat beyond: one sort of knots and queries together."""
    both = queries.withColumn("__k", F.lit(0)).unionByName(knots.select(*key, x, F.col(y).alias("__y")).withColumn("__k", F.lit(1)), allowMissingColumns=True)
    point = F.when(F.col("__k") == 1, F.struct(F.col(x).alias("x"), F.col("__y").alias("y")))
    w = over(key, [x, "__k"])
    both = both.withColumn("__a", F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__b", F.first(point, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    a, b = F.col("__a"), F.col("__b")
    inside = F.when(b["x"] == a["x"], b["y"]).otherwise(a["y"] + (b["y"] - a["y"]) * (F.col(x) - a["x"]) / (b["x"] - a["x"]))
    return both.where("__k = 0").withColumn("value", F.when(a.isNull(), b["y"]).when(b.isNull(), a["y"]).otherwise(inside)).drop("__k", "__a", "__b", "__y")


def demultiplex(df: DataFrame, window: str, cycle: str, mz: str, intensity: str) -> DataFrame:
    """Split each peak of an overlapping window by its neighbours' signal at the same m/z: df (window, cycle, mz, intensity)
    with windows numbered so that k overlaps k - 1 and k + 1.  Rows (window, half, ...); a peak without support goes."""
    w = Window.partitionBy(cycle, mz).orderBy(window)
    near = lambda f: F.when(f(window).over(w) == F.col(window) + (1 if f is F.lead else -1), f(intensity).over(w)).otherwise(F.lit(0.0))
    x = df.withColumn("__p", near(F.lag)).withColumn("__q", near(F.lead)).where((F.col("__p") + F.col("__q")) > 0)
    halves = F.array(F.struct(F.lit("lower").alias("half"), (F.col(intensity) * F.col("__p") / (F.col("__p") + F.col("__q"))).alias("part")), F.struct(F.lit("upper").alias("half"), (F.col(intensity) * F.col("__q") / (F.col("__p") + F.col("__q"))).alias("part")))
    return x.withColumn("__h", F.explode(halves)).select(*df.columns, "__h.half", "__h.part").where("part > 0")
