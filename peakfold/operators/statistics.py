"""Statistics over scored rows: error rates, null models, fits.  Windows and aggregates; iterative ones are in kernels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakfold.functions.distributions import gaussian_sf


def at_levels(df: DataFrame, levels: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the columns that the levels (a row a value of `by`, nulls too) have besides."""
    names = {c: f"__l_{c}" for c in by}
    on = F.lit(True)
    for c, n in names.items():
        on = on & F.col(c).eqNullSafe(F.col(n))
    return df.join(levels.withColumnsRenamed(names), on).drop(*names.values())


def benjamini_hochberg(df: DataFrame, group: list[str], p: str, out: str = "q", ranges: int = 1) -> DataFrame:
    """Adjusted p-values per group: the least of n p' / rank over all p' at or above p.  Ties share one value.

    Rows of one p are counted first, and only the counts are ordered.  With `ranges` over 1 a group's order is cut into that
    many ranges, so no task sorts a whole group.
    """
    from peakfold.operators.running import few_groups, running

    x = df.groupBy(*group, p).agg(F.count(F.lit(1)).alias("__c"))
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
    x = at_levels(x, F.broadcast(sizes) if few_groups(df, group) else sizes, group)
    x = running(x, group, p, {"__rank": ("sum", F.col("__c"))}, ranges=ranges)
    x = running(x, group, p, {"__least": ("min", F.col("__n") * F.col(p) / F.col("__rank"))}, descending=True, ranges=ranges)
    return at_levels(df, x.select(*group, p, F.least(F.lit(1.0), F.col("__least")).alias(out)), [*group, p])


def pi0(df: DataFrame, group: list[str], p: str, low: float = 0.05, high: float = 1.0) -> DataFrame:
    """Share of nulls: median over 0.1 .. 0.9 of the scaled share of p-values above, clipped."""
    steps = [k / 10 for k in range(1, 10)]
    a = df.groupBy(*group).agg(F.array(*[F.count(F.when(F.col(p) > s, 1)) / (F.count(F.lit(1)) * (1 - s)) for s in steps]).alias("__v"))
    return a.select(*group, F.greatest(F.lit(low), F.least(F.lit(high), F.element_at(F.array_sort("__v"), 5))).alias("pi0"))


def null_p_values(df: DataFrame, group: list[str], score: str, decoy: Column, out: str = "p") -> DataFrame:
    """Upper tail of each score in a Gaussian fitted to the decoys of its group; 1 where there is none."""
    null = df.where(decoy).groupBy(*group).agg(F.avg(score).alias("__m"), F.stddev_pop(score).alias("__s"))
    x = df.join(null, group, "left")
    tail = gaussian_sf(F.col(score), F.col("__m"), F.col("__s"))
    return x.withColumn(out, F.when(F.col("__s") > 0, tail).otherwise(F.lit(1.0))).drop("__m", "__s")


def passing_fdr(df: DataFrame, q: str, threshold: float, strict: bool = False) -> DataFrame:
    return df.where(F.col(q) < threshold if strict else F.col(q) <= threshold)


def top_share(df: DataFrame, group: list[str], score: str, share: float) -> DataFrame:
    """Rows at or above the (1 - share) quantile of their group."""
    cut = df.groupBy(*group).agg(F.percentile(score, F.lit(1 - share)).alias("__c"))
    return df.join(cut, group).where(F.col(score) >= F.col("__c")).drop("__c")


def tdc_levels(df: DataFrame, group: list[str], score: str, decoy: Column, out: str = "q", higher: bool = True, ranges: int = 1) -> DataFrame:
    """group, score, q of every different score: target-decoy q-values, running decoys / targets from the best score, then the
    running minimum from the worst.

    Without targets so far the rate is 1.  Equal scores share one value, so they are counted first and only the counts are ordered.
    With `ranges` over 1 a group's order is cut into that many ranges, so no task sorts a whole group.
    """
    from peakfold.operators.running import running

    x = df.groupBy(*group, score).agg(F.sum(decoy.cast("long")).alias("__nd"), F.sum((~decoy).cast("long")).alias("__nt"))
    x = running(x, group, score, {"__d": ("sum", F.col("__nd")), "__t": ("sum", F.col("__nt"))}, descending=higher, ranges=ranges)
    x = x.withColumn("__f", F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("__d"), F.col("__t")), F.lit(1.0))))
    x = running(x, group, score, {"__q": ("min", F.col("__f"))}, descending=not higher, ranges=ranges)
    return x.select(*group, score, F.col("__q").alias(out))


def tdc_q_values(df: DataFrame, group: list[str], score: str, decoy: Column, out: str = "q", higher: bool = True, ranges: int = 1) -> DataFrame:
    """Rows with the target-decoy q-value of their score."""
    return at_levels(df, tdc_levels(df, group, score, decoy, out, higher, ranges), [*group, score])


def compete(df: DataFrame, key: list[str], score: str, tie: list) -> DataFrame:
    """The best row of each competing set."""
    from peakfold.operators.aggregates import best_per_key

    return best_per_key(df, key, score, tie)


def linear_fit(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*group).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def fixed_intercept_slope(df: DataFrame, group: list[str], x: str, y: str, intercept: float = 0.0) -> DataFrame:
    return df.groupBy(*group).agg((F.sum(F.col(x) * (F.col(y) - intercept)) / F.sum(F.col(x) * F.col(x))).alias("slope"))


def e_value_fit(df: DataFrame, group: list[str], score: str, bins: int = 50, slope: float = -0.25, intercept: float = 3.5, least_count: int = 3) -> DataFrame:
    """Line through ln(survivors) over the upper half of a histogram of scores, counts over `least_count` only; the
    defaults stand where that leaves fewer than two points."""
    ends = df.groupBy(*group).agg(F.min(score).alias("__a"), F.max(score).alias("__z"))
    x = df.join(ends, group)
    k = F.least(F.floor((F.col(score) - F.col("__a")) / ((F.col("__z") - F.col("__a")) / bins)), F.lit(bins - 1))
    h = x.where("__z > __a").groupBy(*group, k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.max("__a").alias("__a"), F.max("__z").alias("__z"))
    w = Window.partitionBy(*group).orderBy(F.desc("k"))
    h = h.withColumn("survive", F.sum("n").over(w)).withColumn("at", F.col("__a") + F.col("k") * ((F.col("__z") - F.col("__a")) / bins))
    h = h.where((F.col("k") >= bins // 2) & (F.col("survive") > least_count)).withColumn("ln", F.ln("survive"))
    fit = h.groupBy(*group).agg(F.regr_slope("ln", "at").alias("m"), F.regr_intercept("ln", "at").alias("b"))
    return ends.select(*group).join(fit, group, "left").select(*group, F.coalesce("m", F.lit(slope)).alias("slope"), F.when(F.col("m").isNull(), F.lit(intercept)).otherwise(F.col("b")).alias("intercept"))


def e_value(score: Column, slope: Column, intercept: Column, least: float = -3.0) -> Column:
    """-(slope score + intercept) as -ln E; null below `least`."""
    v = -(slope * score + intercept)
    return F.when(v >= least, v)


def seed_run(df: DataFrame, run: str) -> DataFrame:
    """The run with most rows, ties to the smaller name."""
    return df.groupBy(run).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(run)).limit(1)


def theil_sen(df: DataFrame, group: list[str], x: str, y: str, gap: int = 0) -> DataFrame:
    """Median of slopes.  With gap 0 over all pairs of a group, which must be small by nature (a bin of a trace); with a
    gap, over pairs that many rows apart, which is linear in the rows."""
    if gap:
        w = Window.partitionBy(*group).orderBy(x)
        s = df.withColumn("__s", (F.lead(y, gap).over(w) - F.col(y)) / (F.lead(x, gap).over(w) - F.col(x)))
        return s.where(F.col("__s").isNotNull()).groupBy(*group).agg(F.percentile("__s", F.lit(0.5)).alias("slope"))
    pts = df.groupBy(*group).agg(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))).alias("__p"))
    pairs = F.flatten(F.transform("__p", lambda a: F.transform(F.filter("__p", lambda b: b["x"] > a["x"]), lambda b: (b["y"] - a["y"]) / (b["x"] - a["x"]))))
    from peakfold.functions.arrays import quantile

    return pts.select(*group, quantile(pairs, 0.5).alias("slope"))


def binned_reference(df: DataFrame, group: list[str], x: str, y: str, bins: int = 40) -> DataFrame:
    """Median x and y of equal-count bins along x: knots of a running reference."""
    w = Window.partitionBy(*group).orderBy(x, y)
    return df.withColumn("bin", F.ntile(bins).over(w)).groupBy(*group, "bin").agg(F.percentile(x, F.lit(0.5)).alias("x"), F.percentile(y, F.lit(0.5)).alias("y"), F.count(F.lit(1)).alias("n"))


def infer_value(actual: Column, probability: Column, warped: Column, least: float = 0.001) -> Column:
    """The observed value where it is likely under the model, else the warped one."""
    return F.when(probability > least, actual).otherwise(warped)


def symmetric_delta(forward: Column, inverse: Column) -> Column:
    """The smaller of two deviations by size."""
    return F.when(F.abs(forward) <= F.abs(inverse), forward).otherwise(inverse)


def localization_fdr(df: DataFrame, score: str, threshold: float, ranges: int = 1) -> DataFrame:
    """p = 10^-score, adjusted; rows above the threshold or without a score go."""
    x = df.where(F.col(score).isNotNull()).withColumn("__p", F.pow(F.lit(10.0), -F.col(score))).withColumn("__g", F.lit(0))
    return benjamini_hochberg(x, ["__g"], "__p", "fdr", ranges).where(F.col("fdr") <= threshold).drop("__p", "__g")


def best_localization(df: DataFrame, key: list[str]) -> DataFrame:
    """Site-specific rows before others, then the less ambiguous, then the higher score."""
    w = Window.partitionBy(*key).orderBy(F.desc(F.col("is_site_specific").cast("int")), "n_ambiguous", F.desc("score"), "form")
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def k_fold(df: DataFrame, ident: list[str], folds: int, seed: int = 1, buckets: int = 1024) -> DataFrame:
    """Fold of each row: its place in the order of a hash, so folds are equal to one row and reruns agree.  Rows are ordered
    bucket by bucket, and a bucket's places follow those of the buckets before it."""
    h = F.xxhash64(*ident, F.lit(seed))
    x = df.withColumn("__h", h).withColumn("__b", F.pmod(F.col("__h"), F.lit(buckets)))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    ahead = df.select(F.pmod(h, F.lit(buckets)).alias("__b")).groupBy("__b").agg(F.count(F.lit(1)).alias("__n")).select("__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__a"))
    place = F.row_number().over(Window.partitionBy("__b").orderBy("__h", *ident)) - 1 + F.col("__a")
    return x.join(F.broadcast(ahead), "__b").withColumn("fold", (place % folds).cast("int")).drop("__h", "__b", "__a")  # a row a bucket


def kde_mode(df: DataFrame, key: list[str], value: str, bins: int = 100) -> DataFrame:
    """Mode of each key's density on a grid from its least to its greatest value: cosine bells that end after two of Silverman's
    widths.  Every value adds to the grid points that it reaches; sums are combined before the shuffle, so a key may hold any
    share of the rows."""
    import math

    s = df.where(F.col(value).isNotNull()).groupBy(*key).agg(F.min(value).cast("double").alias("__a"), F.max(value).cast("double").alias("__z"), F.stddev_pop(value).alias("__s"), F.count(F.lit(1)).alias("n"))
    s = s.withColumn("__h", F.greatest(1.06 * F.col("__s") * F.pow("n", F.lit(-0.2)), F.lit(1e-9))).withColumn("__d", (F.col("__z") - F.col("__a")) / (bins - 1))
    x = df.where(F.col(value).isNotNull()).join(s.where("__z > __a"), key)
    first = F.greatest(F.ceil((F.col(value) - 2 * F.col("__h") - F.col("__a")) / F.col("__d")), F.lit(0).cast("long"))
    last = F.least(F.floor((F.col(value) + 2 * F.col("__h") - F.col("__a")) / F.col("__d")), F.lit(bins - 1).cast("long"))
    x = x.withColumn("__k", F.explode(F.sequence(first, last)))
    bell = F.cos((F.col("__a") + F.col("__k") * F.col("__d") - F.col(value)) * math.pi / (4 * F.col("__h")))
    grid = x.groupBy(*key, "__k").agg(F.sum(bell).alias("__y"))
    best = grid.groupBy(*key).agg(F.min_by("__k", F.struct(-F.round("__y", 9), "__k")).alias("__k"))
    return s.join(best, key, "left").select(*key, (F.col("__a") + F.coalesce("__k", F.lit(0)) * F.col("__d")).alias("mode"), "n")


def lda_moments(df: DataFrame, label: Column, features: list[str]) -> DataFrame:
    """Per class: count, sums and sums of products; all that a linear discriminant needs of the rows."""
    cols = [F.count(F.lit(1)).alias("n")] + [F.sum(f).alias(f"s_{i}") for i, f in enumerate(features)]
    cols += [F.sum(F.col(a) * F.col(b)).alias(f"c_{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features) if j >= i]
    return df.groupBy(label.alias("positive")).agg(*cols)


def lda_score(features: list[str], coefficients: list[float], constant: float) -> Column:
    return sum((F.col(f) * c for f, c in zip(features, coefficients)), F.lit(float(constant)))
