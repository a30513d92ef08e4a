"""Scores of candidates from their transition traces: the sliding-correlation search and its feature vector.

Traces are dense tables (key, ion, at, value): a row for every ion and scan of a candidate, `at` numbering its scans from 0.
All of it is windows and aggregates; only a candidate's own rows meet in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakfold.functions import arrays as A
from peakfold.operators import windows as win

#: Least correlation of each tier of transitions, and what a transition of the tier counts.
TIERS = ((0.9, 1.0), (0.75, 0.1), (0.5, 0.01), (0.0, 0.001))


def local_share(df: DataFrame, key: list[str], ion: str, at: str, value: str, width: int, out: str = "share") -> DataFrame:
    """Value over the sum of a centred frame, cut off at the ends; 0 where the frame is empty."""
    total = win.centred_sum(value, win.over([*key, ion], [at]), width)
    return df.withColumn(out, F.when(total > 0, F.col(value) / total).otherwise(F.lit(0.0)))


def upper_median(df: DataFrame, key: list[str], at: str, value: str, transitions: int, out: str = "median") -> DataFrame:
    """Per scan: of the ions that are there, the value that `transitions` of them reach (interpolated); 0 with fewer ions."""
    live = F.filter(F.collect_list(F.col(value).cast("double")), lambda v: v > 0)
    g = df.groupBy(*key, at).agg(live.alias("__v"))
    n = F.size("__v")
    # The share is clipped below, as the quantile is built for both branches.
    share = F.greatest(F.lit(0.0), 1 - F.lit(float(transitions)) / F.greatest(n, F.lit(1)))
    place = (F.greatest(n, F.lit(1)) - 1) * share
    low = F.floor(place).cast("int")
    up = F.array_sort("__v")
    value_at = lambda i: F.try_element_at(up, i + 1)
    q = value_at(low) + (F.coalesce(value_at(low + 1), value_at(low)) - value_at(low)) * (place - low)
    return g.select(*key, at, F.when(n < transitions, F.lit(0.0)).otherwise(q).alias(out))


def sliding_correlation(df: DataFrame, key: list[str], ion: str, at: str, value: str, median: str, width: int, out: str = "correlation") -> DataFrame:
    """Correlation of each ion with the median over width + 1 scans around each scan at which the median is above both ends of
    the frame; else 0.  A frame must lie within the trace."""
    before, after = width // 2, width - width // 2
    w = win.over([*key, ion], [at])
    frame = w.rowsBetween(-before, after)
    full = F.count(F.lit(1)).over(frame) == width + 1
    peak = (F.col(median) > F.lag(median, before).over(w)) & (F.col(median) > F.lead(median, after).over(w))
    spread = F.stddev_pop(value).over(frame) * F.stddev_pop(median).over(frame)
    r = F.try_divide(F.covar_pop(value, median).over(frame), spread)
    return df.withColumn(out, F.when(full & peak, F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0))).otherwise(F.lit(0.0)))


def tier_weight(correlation: Column) -> Column:
    """What a transition of this correlation counts."""
    out = F.lit(0.0)
    for least, weight in reversed(TIERS):
        out = F.when(correlation > least, F.lit(weight)).otherwise(out)
    return out


def trace_scores(traces: DataFrame, key: list[str], ion: str, at: str, value: str, width: int, transitions: int = 3) -> DataFrame:
    """Per scan of each candidate: median, summed correlation (averaged over width / 2, per transition), tiers."""
    x = local_share(traces, key, ion, at, value, round(width * 1.5))
    x = x.join(upper_median(x, key, at, "share", transitions).hint("merge"), [*key, at])
    x = sliding_correlation(x, key, ion, at, value, "median", width)
    s = x.groupBy(*key, at).agg(F.max("median").alias("median"), F.sum("correlation").alias("__c"), F.sum(tier_weight(F.col("correlation"))).alias("tiers"))
    s = win.filled_average(s, key, [at], "__c", max(1, width // 2), "__a")
    return s.withColumn("correlation_sum", F.col("__a") / transitions).drop("__c", "__a")


def candidate_scores(primary: DataFrame, traces: DataFrame, key: list[str], at: str, score: str = "primary", low_resolution: bool = False) -> DataFrame:
    """Primary score of each scan times its summed correlation, and times its tiers for noisy instruments."""
    x = primary.join(traces.hint("merge"), [*key, at])
    return x.withColumn("score", F.col(score) * F.col("correlation_sum") * (F.col("tiers") if low_resolution else F.lit(1.0)))


def match_features(ions: DataFrame, key: list[str], used: int = 3, tolerance: float = 10.0) -> DataFrame:
    """Features of each key from its library ions: ion_type, ion_index, predicted, intensity (0 where unmatched), delta (of the
    most intense peak), tic (of the scan).

    n_matched, n_above (over tic / (1 + ions squared)), delta_mean and delta_abs of the `used` + 1 most intense ions (the
    tolerance stands for missing ones in the latter), dot, hyperscore (+2, not below 0), fit_score (ln 1 / squared error over
    ions on both sides, +1, not below 0; 0 for an error of 1e-12 or less, which is rounding), ln_sp (preliminary score, at least 1), ladder (most matched ions of one type).
    """
    ranked = ions.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("intensity"), F.desc("delta"))))
    whole = Window.partitionBy(*key)
    length = lambda c: F.sqrt(F.sum(F.col(c) * F.col(c)).over(whole))
    unit = lambda c: F.when(length(c) > 0, F.col(c) / length(c)).otherwise(F.lit(0.0))
    ranked = ranked.withColumn("__n", F.count(F.lit(1)).over(whole)).withColumn("__p", unit("predicted")).withColumn("__a", unit("intensity"))
    ladder = ions.where("intensity > 0").groupBy(*key, "ion_type").agg(F.countDistinct("ion_index").alias("__l")).groupBy(*key).agg(F.max("__l").cast("long").alias("ladder"))
    near, both = F.col("__r") <= used + 1, (F.col("__p") > 0) & (F.col("__a") > 0)
    hit = F.col("intensity") > 0
    f = ranked.groupBy(*key).agg(
        F.count_if(hit).alias("n_matched"), F.count_if(hit & (F.col("intensity") > F.col("tic") / (1 + F.col("__n") * F.col("__n")))).alias("n_above"), F.avg(F.when(near, F.col("delta"))).alias("delta_mean"),
        ((F.sum(F.when(near, F.abs("delta"))) + tolerance * F.greatest(F.lit(0), used - F.count_if(near))) / used).alias("delta_abs"), F.sum(F.col("__p") * F.col("__a")).alias("dot"),
        F.coalesce(F.sum(F.when(both, (F.col("__p") - F.col("__a")) * (F.col("__p") - F.col("__a")))), F.lit(0.0)).alias("__e"), F.sum("intensity").alias("__s"), F.max("__n").alias("__n"),
    )
    f = f.join(ladder.hint("merge"), key, "left").withColumn("ladder", F.coalesce("ladder", F.lit(0).cast("long")))
    sp = F.greatest(F.lit(1.0), F.col("__s") * F.col("n_matched") * (1 + 0.075 * F.col("ladder")) / F.col("__n"))
    f = f.withColumn("hyperscore", F.when((F.col("dot") > 0) & (F.col("n_matched") > 0), A.hyperscore(F.col("dot"), F.col("n_matched"))).otherwise(F.lit(0.0)))
    f = f.withColumn("fit_score", F.when(F.col("__e") > 1e-12, F.greatest(F.lit(0.0), 1 - F.ln("__e"))).otherwise(F.lit(0.0)))
    return f.withColumn("ln_sp", F.ln(sp)).drop("__e", "__s", "__n")


def background_weights(ions: DataFrame, background: DataFrame, key: list[str], mz: str, ppm: float) -> DataFrame:
    """Ions weighted by how rare they are: 100 / (1 + the counts of background masses (mass, n) within the tolerance), at length 1
    a key."""
    from peakfold.operators.joins import band_join

    named = background.select(F.col("mass").alias("__mass"), F.col("n").alias("__count"))
    found = band_join(ions.select(mz).distinct(), named, mz, "__mass", ppm).groupBy(mz).agg(F.sum("__count").alias("__c"))
    x = ions.join(found, mz, "left").withColumn("__w", 100.0 / (1 + F.coalesce("__c", F.lit(0))))
    return x.withColumn("weight", F.col("__w") / F.sqrt(F.sum(F.col("__w") * F.col("__w")).over(Window.partitionBy(*key)))).drop("__c", "__w")


def compete(df: DataFrame, key: list[str], score: str, tie: list[str]) -> DataFrame:
    """The one best row of each key over targets and decoys together, with the margin to the next."""
    w = Window.partitionBy(*key).orderBy(F.desc(score), *tie)
    x = df.withColumn("__r", F.row_number().over(w)).withColumn("margin", F.col(score) - F.coalesce(F.lead(score).over(w), F.lit(0.0)))
    return x.where("__r = 1").drop("__r")


#: Names of the default search's features, in the order of its feature table.
FEATURES = (
    "primary", "evalue", "correlation_to_gaussian", "correlation_to_precursor", "is_integrated_signal", "is_integrated_precursor", "n_good_correlation", "hyperscore", "xcorr_lib", "xcorr_model", "fit_score", "n_matched", "n_above", "delta_mean", "isotope_dot",
    "parent_delta", "ln_sp", "ladder",
)


def scan_scores(matches: DataFrame, width: int, transitions: int = 3, low_resolution: bool = False) -> DataFrame:
    """candidate, scan, at, primary, correlation_sum, tiers, score of every scan: the default search's score over time."""
    unit = matches.groupBy("candidate", "scan", "at").agg(F.sqrt(F.sum(F.col("predicted") * F.col("predicted"))).alias("p"), F.sqrt(F.sum(F.col("intensity") * F.col("intensity"))).alias("a"), F.sum(F.col("predicted") * F.col("intensity")).alias("s"), F.count_if(F.col("intensity") > 0).alias("n"))
    primary = unit.select("candidate", "scan", "at", F.when((F.col("s") > 0) & (F.col("n") > 0), A.hyperscore(F.col("s") / (F.col("p") * F.col("a")), F.col("n"))).otherwise(F.lit(0.0)).alias("primary"))
    return candidate_scores(primary, trace_scores(matches, ["candidate"], "ion", "at", "intensity", width, transitions), ["candidate"], "at", low_resolution=low_resolution)


def default_search(matches: DataFrame, width: int, transitions: int = 3, k: int = 5, low_resolution: bool = False) -> DataFrame:
    """The default search: matches (candidate, group, decoy, scan, at, ion, predicted, intensity), dense over ions and scans, as
    the best separate scans of each candidate; one row a group stays, the winner over target and decoy candidates."""
    from peakfold.operators.kernels import topk_exclusion

    scored = scan_scores(matches, width, transitions, low_resolution)
    best = topk_exclusion(scored.where("score > 0"), ["candidate"], ["at"], "scan", "score", k, width)
    names = matches.select("candidate", "group", "decoy").distinct()
    return compete(best.join(names.hint("merge"), "candidate"), ["group"], "score", ["candidate", "scan"])


def feature_search(matches: DataFrame, scans: DataFrame, width: int, rt_width: float, transitions: int = 3, k: int = 2, low_resolution: bool = False, tolerance: float = 10.0) -> DataFrame:
    """The default search with its whole feature vector, for the rescoring that follows it.

    matches: candidate, group, decoy, scan, at, rt, ion, ion_type, ion_index, predicted, intensity (square roots), delta, tic,
    precursor (its signal in that scan), dense over ions and scans; scans: candidate, scan, xcorr_lib, xcorr_model,
    isotope_dot, parent_delta, for the scans that may be chosen.  `width`: scans of a peak; `rt_width`: its expected width in rt.

    The k + 1 best scans of a candidate are taken, each 2 `width` scans from better ones.  Around each, transitions are
    refined (`quantitation.shape_features`); scans with fewer than `transitions` well correlating ones give way to those with
    enough, if the candidate has such.  Returns candidate, group, decoy, scan, rank and FEATURES.  Matches are dense, so Spark may take
    them for far fewer than they are: no table is broadcast.
    """
    from peakfold.operators.kernels import topk_exclusion
    from peakfold.operators.quantitation import shape_features
    from peakfold.operators.statistics import e_value, e_value_fit

    scored = scan_scores(matches, width, transitions, low_resolution)
    best = topk_exclusion(scored, ["candidate"], ["at"], "scan", "score", k + 1, 2 * width)
    taken = best.join(matches.select("candidate", "scan", "at", "rt").distinct().hint("merge"), ["candidate", "scan"])
    # Each taken scan's surroundings: a join on the candidate, of as many rows as a few peaks have.
    around = matches.select("candidate", F.col("at").alias("__at"), F.col("rt").alias("__x"), "ion", (F.col("intensity") * F.col("intensity")).alias("__v"), "precursor")
    local = taken.select("candidate", "scan", "at", F.col("rt").alias("__centre")).join(around.hint("merge"), "candidate").where(F.abs(F.col("__at") - F.col("at")) <= 2 * width)
    shape = shape_features(local, ["candidate", "scan"], "ion", "__x", "__v", "precursor", "__centre", rt_width)
    fit = e_value_fit(scored, ["candidate"], "score")
    ions = matches.join(taken.select("candidate", "scan").hint("merge"), ["candidate", "scan"])
    parts = match_features(ions.withColumn("intensity", F.col("intensity") * F.col("intensity")), ["candidate", "scan"], transitions, tolerance)
    x = taken.withColumnRenamed("score", "primary").join(shape.withColumnRenamed("n_good", "n_good_correlation").hint("merge"), ["candidate", "scan"]).join(parts.hint("merge"), ["candidate", "scan"]).join(fit.hint("merge"), "candidate").join(scans.hint("merge"), ["candidate", "scan"], "left")
    x = x.withColumn("evalue", F.coalesce(e_value(F.col("primary"), F.col("slope"), F.col("intercept")), F.lit(-1.0)))
    x = x.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(default)) for c, default in (("xcorr_lib", 0.0), ("xcorr_model", 0.0), ("isotope_dot", 0.0), ("parent_delta", tolerance))})
    enough = F.col("n_good_correlation") >= transitions
    x = x.withColumn("__some", F.max(enough).over(Window.partitionBy("candidate"))).where(enough | (~F.col("__some") & (F.col("rank") == 1)))
    names = matches.select("candidate", "group", "decoy").distinct()
    return x.join(names.hint("merge"), "candidate").select("candidate", "group", "decoy", "scan", "rank", *FEATURES)
