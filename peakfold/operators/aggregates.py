"""Aggregations.  Variances are population variances; quantiles interpolate at (n - 1) p, as percentile() does."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(df: DataFrame, group: list[str], value: str) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*group).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("stdev"), F.var_pop(v).alias("variance"), F.min(v).alias("least"), F.max(v).alias("most"))


def quantiles(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Median, interquartile range and the range of the middle nine tenths; one exact percentile state for all five."""
    p = df.groupBy(*group).agg(F.percentile(value, F.array(*[F.lit(x) for x in (0.5, 0.25, 0.75, 0.05, 0.95)])).alias("__p"))
    return p.select(*group, F.col("__p")[0].alias("median"), (F.col("__p")[2] - F.col("__p")[1]).alias("iqr"), (F.col("__p")[4] - F.col("__p")[3]).alias("range90"))


def best_per_key(df: DataFrame, key: list[str], score: str, tie: list, higher: bool = True) -> DataFrame:
    """One row a key: the best score, ties by `tie`.  A struct maximum, which combines before the shuffle, not a sort."""
    rest = [c for c in df.columns if c not in key]
    rank = F.struct((F.col(score) if not higher else -F.col(score)).alias("s"), *tie)
    best = df.groupBy(*key).agg(F.min_by(F.struct(*rest), rank).alias("__b"))
    return best.select(*key, *[F.col("__b")[c].alias(c) for c in rest])


def best_with_hysteresis(df: DataFrame, key: list[str], score: str, delta: str, order: list[str], keep: float = 0.9) -> DataFrame:
    """Fold over the rows of a key in a fixed order: a row replaces the best if the best is under `keep` of its score, or
    if it is within a tenth and nearer in |delta|."""
    rest = [c for c in df.columns if c not in key]
    item = F.struct(*[F.col(c) for c in [*order, *[c for c in rest if c not in order]]])
    rows = df.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("__r"))

    def step(best, x):
        better = best[score] < keep * x[score]
        close = (x[score] >= keep * best[score]) & (F.abs(x[delta]) < F.abs(best[delta]))
        return F.when(better | close, x).otherwise(best)

    rows = rows.withColumn("__b", F.aggregate(F.slice("__r", 2, F.greatest(F.size("__r") - 1, F.lit(1))), F.col("__r")[0], step))
    return rows.select(*key, *[F.col("__b")[c].alias(c) for c in rest])


def intensity_matrix(df: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """Sum of values per row and column, 0 where there is none; the columns are given, so that no pass is spent on them."""
    m = df.groupBy(row).pivot(column, columns).agg(F.sum(value))
    return m.select(row, *[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(str(c)) for c in columns])


def tic_normalize(df: DataFrame, file: str, value: str, tic: str | None = None) -> DataFrame:
    """Adds `normalized`: value / total of its file * mean total of the files; files without signal pass through."""
    totals = df.groupBy(file).agg(F.sum(value).alias("__t")) if tic is None else df.groupBy(file).agg(F.max(tic).alias("__t"))
    mean = totals.agg(F.avg("__t").alias("__m"))
    return df.join(totals, file).join(F.broadcast(mean)).withColumn("normalized", F.when(F.col("__t") > 0, F.col(value) / F.col("__t") * F.col("__m")).otherwise(F.col(value))).drop("__t", "__m")  # mean is one row


def replicate_normalize(df: DataFrame, file: str, sample: str, tic: str, value: str) -> DataFrame:
    """As tic_normalize, towards the mean total of the replicates of the same sample."""
    files = df.groupBy(file, sample).agg(F.max(tic).alias("__t"))
    files = files.join(files.groupBy(sample).agg(F.avg("__t").alias("__m")), sample)
    return df.join(files, [file, sample]).withColumn("normalized", F.when(F.col("__t") > 0, F.col(value) / F.col("__t") * F.col("__m")).otherwise(F.col(value))).drop("__t", "__m")


def replicate_cv(df: DataFrame, key: list[str], sample: str, replicate: str, value: str, replicates: int) -> DataFrame:
    """Per key: mean over samples of the coefficient of variation within replicates, and whether any sample is complete."""
    one = df.groupBy(*key, sample, replicate).agg(F.sum(value).alias("v"))
    per = one.groupBy(*key, sample).agg((F.stddev_pop("v") / F.avg("v")).alias("cv"), (F.count(F.when(F.col("v") > 0, 1)) >= replicates).alias("full"))
    return per.groupBy(*key).agg(F.avg("cv").alias("cv"), F.bool_or("full").alias("fully_measured"), F.count(F.lit(1)).alias("samples"))


def unique_rollup(members: DataFrame, values: DataFrame, member: str, group: str, value: str) -> DataFrame:
    """Sum of values per group over the members that belong to that group alone: members (member, group), values (member, value)."""
    alone = members.select(member, group).distinct().groupBy(member).agg(F.count(F.lit(1)).alias("__n"), F.first(group).alias(group)).where("__n = 1").drop("__n")
    per = values.groupBy(member).agg(F.sum(value).alias(value))
    return alone.join(per, member).groupBy(group).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("members"))


def duty_cycle(df: DataFrame, window: list[str], rt: str) -> DataFrame:
    """Mean gap between neighbouring scans of a window.  A mean of differences is the span over n - 1: no sort is needed."""
    a = df.groupBy(*window).agg(F.min(rt).alias("a"), F.max(rt).alias("b"), F.count(rt).alias("n"))
    return a.where("n > 1").select(*window, ((F.col("b") - F.col("a")) / (F.col("n") - 1)).alias("duty_cycle"), "n")


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts of equal bins of [low, high); values outside are left out."""
    k = F.floor((F.col(value) - low) / ((high - low) / bins))
    h = df.where((F.col(value) >= low) & (F.col(value) < high)).groupBy(k.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return h.withColumn("start", low + F.col("bin") * ((high - low) / bins))


def binned_percentile(hist: DataFrame, share: float) -> DataFrame:
    """Start of the first bin whose cumulative share exceeds `share`; hist has a row a bin."""
    w = Window.orderBy("bin")
    c = hist.withColumn("__c", F.sum("n").over(w) / F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return c.where(F.col("__c") > share).agg(F.min("start").alias("value"))


def background(df: DataFrame, key: list[str], score: str) -> DataFrame:
    """Mean and deviation of scores, for z-scores."""
    return df.groupBy(*key).agg(F.avg(score).alias("bg_mean"), F.stddev_pop(score).alias("bg_stdev"), F.count(F.lit(1)).alias("bg_n"))


def fragment_frequency(df: DataFrame, mz: str, bins: int = 4000, pseudocount: float = 1.0) -> DataFrame:
    """Weight of each integer bin: the mean count of bins over its own, rarer being larger; every bin has a pseudocount."""
    counts = df.select(F.floor(mz).cast("int").alias("bin")).where((F.col("bin") >= 0) & (F.col("bin") < bins)).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)) + pseudocount)
    return every.withColumn("weight", F.sum("n").over(Window.partitionBy(F.lit(0))) / bins / F.col("n"))


def consensus_peaks(df: DataFrame, key: list[str], mz: str, intensity: str, gap_ppm: float, top: int | None = None) -> DataFrame:
    """Peaks of many spectra merged with the least m/z of their group that is within a tolerance: mean m/z, count, total
    intensity.  A long chain of neighbours is cut at every peak that is too far from where its group began.

    Equal m/z are added up before the shuffle; a key's distinct m/z are walked in order, from group to group by bisection.
    """
    from peakfold.operators.kernels import per_group

    same = df.where(F.col(mz).isNotNull()).groupBy(*key, F.col(mz).cast("double").alias("__m")).agg(F.count(F.lit(1)).alias("__n"), F.coalesce(F.sum(intensity), F.lit(0.0)).cast("double").alias("__t"))

    def kernel(m, n, total):
        starts, i = [], 0
        while i < len(m):
            starts.append(i)
            reach = m[i] * (gap_ppm * 1e-6)
            j = int(np.searchsorted(m, m[i] + reach, "right"))
            while j < len(m) and m[j] - m[i] <= reach:  # what rounding of the sum left out
                j += 1
            while m[j - 1] - m[i] > reach:
                j -= 1
            i = j
        count = np.add.reduceat(n, starts)
        return {"mz": np.add.reduceat(m * n, starts) / count, "n": count, "intensity": np.add.reduceat(total, starts)}

    out = per_group(same, key, ["__m"], ["__m", "__n", "__t"], "mz double, n long, intensity double", kernel)
    if top is not None:
        out = out.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n"), F.desc("intensity"), "mz"))).where(F.col("__r") <= top).drop("__r")
    return out


def weighted_consensus(df: DataFrame, key: list[str], mz: str, intensity: str, correlation: str, width: float, most_bad: float = 0.2, good: float = 0.75) -> DataFrame:
    """Correlation-weighted intensity of each m/z bin; a bin goes if badly correlated intensity exceeds a share of good."""
    c = F.col(correlation)
    out = df.groupBy(*key, F.floor(F.col(mz) / width).alias("bin")).agg(F.sum(F.col(intensity) * F.greatest(c, F.lit(0.0))).alias("weighted"), F.sum(F.when(c >= good, F.col(intensity)).otherwise(0.0)).alias("good"), F.sum(F.when(c < good, F.col(intensity)).otherwise(0.0)).alias("bad"))
    return out.where(F.col("bad") <= most_bad * F.col("good"))


def merge_spectra(df: DataFrame, key: list[str], rt: str, mz: str, intensity: str, width: float = 0.1) -> DataFrame:
    """One spectrum a key: intensity summed in m/z bins, m/z weighted by intensity, mean rt."""
    out = df.groupBy(*key, F.floor(F.col(mz) / width).alias("bin")).agg((F.sum(F.col(mz) * F.col(intensity)) / F.sum(intensity)).alias("mz"), F.sum(intensity).alias("intensity"))
    return out.join(df.groupBy(*key).agg(F.avg(rt).alias("rt")), key)


def roc_auc(df: DataFrame, score: str, positive: Column, ranges: int = 1) -> DataFrame:
    """Area under the ROC curve, ties by half: from counts per distinct score, so one row a score is sorted, not one a row, in
    `ranges` of the score."""
    from peakfold.operators.running import running

    per = df.groupBy(F.col(score).alias("s")).agg(F.count(F.when(positive, 1)).alias("p"), F.count(F.when(~positive, 1)).alias("n"))
    per = running(per.withColumn("__g", F.lit(0)), ["__g"], "s", {"__upto": ("sum", F.col("n"))}, ranges=ranges).withColumn("below", F.col("__upto") - F.col("n"))
    return per.agg((F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)) / (F.sum("p") * F.sum("n"))).alias("auc"), F.sum("p").alias("positives"), F.sum("n").alias("negatives"))


def label_counts(df: DataFrame, decoy: Column, entrapment: Column) -> DataFrame:
    return df.agg(F.count_if(~decoy & ~entrapment).alias("targets"), F.count_if(decoy).alias("decoys"), F.count_if(~decoy & entrapment).alias("entrapments"))


def group_accessions(df: DataFrame, key: list[str], accession: str) -> DataFrame:
    return df.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set(accession)), ";").alias("accessions"))
