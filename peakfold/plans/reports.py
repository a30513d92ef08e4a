"""Library upkeep, localisation reports, alignment of runs and integration with given bounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakfold.functions import arrays as A
from peakfold.functions.distributions import gaussian_pdf
from peakfold.operators import joins, kernels, scans, setops
from peakfold.operators import statistics as st
from peakfold.operators import windows as win

#: Fixed value: mass of a neutron.
NEUTRON = 1.0033548378


# -- libraries ---------------------------------------------------------------------------------------------------------


def localized_entries(localizations: DataFrame, entries: DataFrame, bridge: DataFrame, least: float, only_localized: bool = True) -> DataFrame:
    """Entries with a localisation of at least `least`: localizations and entries meet in (modseq, charge, source), proteins of
    the sequence that are no decoys are joined by ;.  Entries of no protein go."""
    key = ["modseq", "charge", "source"]
    loc = localizations.where(F.col("localization_score") >= least)
    loc = loc.where("is_localized") if only_localized else loc
    owners = bridge.where("not is_decoy").groupBy("seq").agg(F.array_join(F.array_sort(F.collect_set("accession")), ";").alias("accessions"))
    return entries.join(loc, key).join(owners, "seq")


def stored_groups(scores: DataFrame, bridge: DataFrame) -> DataFrame:
    """Protein groups as they were stored: scores (protein_group, accession, q, least_error, is_decoy) with the sequences of their
    accessions: one row a group."""
    x = scores.join(bridge.select("accession", "seq"), "accession", "left")
    return x.groupBy("protein_group").agg(F.array_join(F.array_sort(F.collect_set("accession")), ";").alias("accessions"), F.min("q").alias("q"), F.min("least_error").alias("least_error"), F.bool_or("is_decoy").alias("is_decoy"), F.countDistinct("seq").alias("sequences"))


def passing_proteins(results: DataFrame, threshold: float) -> DataFrame:
    """Rows of a protein result table (ProteinId, q-value, posterior_error_prob, peptideIds) at or below the threshold, the best row of
    each set of accessions."""
    x = results.select(F.array_join(F.array_sort(F.split("ProteinId", "[;,]")), ";").alias("accessions"), F.col("`q-value`").cast("double").alias("q"), F.col("posterior_error_prob").cast("double").alias("pep"), F.size(F.split(F.trim("peptideIds"), r"[;\s]+")).alias("peptides"))
    w = Window.partitionBy("accessions").orderBy("q", "pep", F.desc("peptides"))
    return x.where(F.col("q") <= threshold).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def sequence_times(entries: DataFrame, key: list[str], rt: str, decoy: Column) -> DataFrame:
    """Mean and median time of each sequence over its entries that are no decoys."""
    return entries.where(~decoy).groupBy(*key).agg(F.avg(rt).alias("mean_rt"), F.percentile(rt, F.lit(0.5)).alias("median_rt"), F.count(F.lit(1)).alias("n"))


def as_many_decoys(targets: DataFrame, decoys: DataFrame, order: list) -> DataFrame:
    """The first decoys, as many as there are targets.  Their number is found by a count, the rows by a sort with a limit."""
    return decoys.orderBy(*order).limit(targets.count())


def updated(entries: DataFrame, **columns: Column) -> DataFrame:
    """Entries with some columns replaced, such as time, mass or peaks; names that the table lacks are an error."""
    missing = set(columns) - set(entries.columns)
    if missing:
        raise ValueError(f"no such columns: {sorted(missing)}")
    return entries.withColumns(columns)


def isotope_match(entry_mz: Column, charge: Column, precursor_mz: Column, ppm: float, isotopes: int = 1) -> Column:
    """Whether a precursor is within the tolerance of an entry's mass or of its first isotopes."""
    return _any([A.within_ppm(entry_mz + k * NEUTRON / charge, precursor_mz, ppm) for k in range(isotopes + 1)])


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def sample_library(peaks: DataFrame, targets: DataFrame, ppm: float, tiny: float = 1e-30) -> DataFrame:
    """Peaks (modseq, mz, intensity) of a sample's best entries with the transitions to be measured marked: targets (modseq, target).
    Sequences without targets go; targets without a peak within the tolerance are added at a tiny intensity."""
    live = peaks.join(targets.select("modseq").distinct(), "modseq", "left_semi")
    t = targets.select(F.col("modseq").alias("__s"), F.col("target").alias("__t")).distinct()
    hit = joins.band_join(live.select("modseq", "mz").distinct(), t, "mz", "__t", ppm, F.col("modseq") == F.col("__s"))
    near = hit.withColumn("__r", F.row_number().over(Window.partitionBy("modseq", "__t").orderBy(F.abs(F.col("mz") - F.col("__t")), "mz"))).where("__r = 1")
    marked = live.join(near.select("modseq", "mz").distinct().withColumn("quantified", F.lit(True)), ["modseq", "mz"], "left").withColumn("quantified", F.coalesce("quantified", F.lit(False)))
    absent = targets.select("modseq", "target").distinct().join(live.select("modseq").distinct(), "modseq", "left_semi").join(near.select("modseq", F.col("__t").alias("target")), ["modseq", "target"], "left_anti")
    return marked.select("modseq", "mz", "intensity", "quantified").unionByName(absent.select("modseq", F.col("target").alias("mz"), F.lit(tiny).alias("intensity"), F.lit(True).alias("quantified")))


def rounds_file(members: list[DataFrame]) -> DataFrame:
    """Several tables of the same columns as one, each a member numbered from 0."""
    return setops.union_runs([m.withColumn("member", F.lit(k)) for k, m in enumerate(members)])


def tee(df: DataFrame, *consumers: Callable[[DataFrame], object]) -> list:
    """What several consumers make of a table that is computed once."""
    kept = df.persist()
    try:
        return [c(kept) for c in consumers]
    finally:
        kept.unpersist()


def localization_report(localized: DataFrame) -> DataFrame:
    """Rows of a localisation report, best form of each sequence and charge first by score; text columns as they are written."""
    best = st.best_localization(localized, ["modseq", "charge"])
    return best.select("modseq", "charge", "form", F.round("score", 4).alias("score"), F.when(F.col("is_site_specific"), F.lit("yes")).otherwise(F.lit("no")).alias("site_specific"), "n_ambiguous")


# -- runs --------------------------------------------------------------------------------------------------------------


def target_decoy_times(points: DataFrame, group: list[str], delta: str, decoy: Column, trim: int = 20, least: float = 0.05) -> DataFrame:
    """Adds `probability` that a time difference is a target's, and whether it passes: a Gaussian of the decoys against one of the
    targets without the worst in `trim`, those farthest from 0 (of equally far ones the larger difference stays longest)."""
    null = points.where(decoy).groupBy(*group).agg(F.avg(delta).alias("__dm"), F.stddev_pop(delta).alias("__ds"))
    w = Window.partitionBy(*group).orderBy(F.desc(F.abs(F.col(delta))), delta)
    kept = points.where(~decoy).withColumn("__r", F.row_number().over(w)).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*group))).where(F.col("__r") > F.floor(F.col("__n") / trim))
    own = kept.groupBy(*group).agg(F.avg(delta).alias("__tm"), F.stddev_pop(delta).alias("__ts"))
    x = points.join(own.join(null, group), group)
    a, b = gaussian_pdf(F.col(delta), F.col("__tm"), F.col("__ts")), gaussian_pdf(F.col(delta), F.col("__dm"), F.col("__ds"))
    x = x.withColumn("probability", F.when(a + b > 0, a / (a + b)).otherwise(F.lit(0.0)))
    return x.withColumn("passes", F.col("probability") >= least).drop("__dm", "__ds", "__tm", "__ts")


def corrected_mass_errors(points: DataFrame, key: list[str], rt: str, error: str, ident: str) -> DataFrame:
    """Mass errors less their ridge over time, a run each: with over 20 points the ridge of a density, with 2 to 20 a line, else
    nothing is taken off."""
    x = kernels.rt_align(points.select(*key, ident, rt, error), key, rt, error, ident)
    return x.select(*key, ident, F.col("delta").alias("corrected"), "probability")


def peak_locations(peptides: DataFrame, least: float = 0.001) -> DataFrame:
    """Where each sequence of any run lies in every run: peptides (run, modseq, rt).

    The run with most sequences is the seed.  Every other run is aligned to it by the sequences that both have; what a run
    observed stays where it fits the alignment, and elsewhere the seed's time is warped into it, linear between aligned pairs.
    Rows (run, modseq, rt, observed); sequences that neither the seed nor the run has are left out.
    """
    best = peptides.groupBy("run", "modseq").agg(F.min("rt").alias("rt"))
    seed = best.join(F.broadcast(st.seed_run(best, "run").select("run")), "run").select("modseq", F.col("rt").alias("seed_rt"))  # one row
    pairs = best.join(seed, "modseq")
    fitted = kernels.rt_align(pairs, ["run"], "seed_rt", "rt", "modseq").select("run", "modseq", "warped", "probability")
    pairs = pairs.join(fitted, ["run", "modseq"])
    knots = pairs.groupBy("run", "seed_rt").agg(F.avg("warped").alias("warped"))
    runs = joins.small_side(best.select("run").distinct().withColumn("__k", F.lit(0)))
    wanted = seed.withColumn("__k", F.lit(0)).join(runs, "__k").drop("__k").join(best.select("run", "modseq"), ["run", "modseq"], "left_anti")
    inferred = win.interpolate_at(knots, wanted.select("run", "modseq", "seed_rt"), ["run"], "seed_rt", "warped").select("run", "modseq", F.col("value").alias("rt"), F.lit(False).alias("observed"))
    seen = pairs.select("run", "modseq", st.infer_value(F.col("rt"), F.col("probability"), F.col("warped"), least).alias("rt"), (F.col("probability") > least).alias("observed"))
    return seen.unionByName(inferred)


def aligned_fractions(fractions: DataFrame, reference: DataFrame) -> DataFrame:
    """Entries of many fractions (fraction, modseq, rt, ...) at the times of one run (modseq, rt), the alignment of each fraction
    being that of the sequences it shares with the run."""
    ref = reference.groupBy("modseq").agg(F.min("rt").alias("ref_rt"))
    own = fractions.groupBy("fraction", "modseq").agg(F.min("rt").alias("rt"))
    fitted = kernels.rt_align(own.join(ref, "modseq"), ["fraction"], "rt", "ref_rt", "modseq").select("fraction", "modseq", "warped")
    knots = own.join(fitted, ["fraction", "modseq"]).groupBy("fraction", "rt").agg(F.avg("warped").alias("warped"))
    return win.interpolate_at(knots, fractions, ["fraction"], "rt", "warped").withColumn("rt", F.col("value")).drop("value")


def reintegrate(points: DataFrame, bounds: DataFrame, key: list[str], x: str = "rt", y: str = "intensity") -> DataFrame:
    """Areas of traces between bounds (key, start, stop) that another program chose, above the background; a trace without points
    inside its bounds has area 0."""
    inside = points.join(bounds, key).where(F.col(x).between(F.col("start"), F.col("stop")))
    area = win.trapezoid_area(inside.select(*key, x, y), key, x, y)
    out = bounds.select(*key).distinct().join(area, key, "left")
    return out.select(*key, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("area", "background", "net")])


def capped_isotopes(areas: DataFrame, key: list[str], isotopes: list[str], expected: list[str], most: float = 1.5) -> DataFrame:
    """Isotope areas of which none counts more than `most` times what the first isotope lets expect: the total, and how many were cut."""
    first, share = F.col(isotopes[0]), F.col(expected[0])
    limit = [first * F.col(e) / share * most for e in expected]
    total = sum((F.least(F.col(i), m) for i, m in zip(isotopes[1:], limit[1:])), first)
    cut = sum(((F.col(i) > m).cast("int") for i, m in zip(isotopes[1:], limit[1:])), F.lit(0))
    return areas.select(*key, total.alias("total"), cut.alias("cut"))


def processed(runs: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Scans after each processor in turn."""
    for step in steps:
        runs = step(runs)
    return runs


def on_list(features: DataFrame, windows: DataFrame, sequence: str) -> tuple[DataFrame, DataFrame]:
    """(features on a target list, the others): the best feature of each cleaned sequence, marked by the first window of it."""
    from peakfold.functions.sequences import strip_modifications

    best = features.withColumn("__c", strip_modifications(F.col(sequence)))
    best = best.withColumn("__r", F.row_number().over(Window.partitionBy("__c").orderBy(F.desc("score"), sequence))).where("__r = 1").drop("__r")
    listed = windows.select(strip_modifications(F.col(sequence)).alias("__c")).distinct()
    return best.join(listed, "__c", "left_semi").drop("__c"), best.join(listed, "__c", "left_anti").drop("__c")


def ion_counts(matches: DataFrame, key: list[str], least: int = 1) -> DataFrame:
    """How many different ions each key matched, and their signal."""
    return matches.where("intensity > 0").groupBy(*key).agg(F.countDistinct("ion_mz").alias("ions"), F.sum("intensity").alias("signal")).where(F.col("ions") >= least)


def group_libraries(runs: DataFrame, groups: DataFrame, coarse: DataFrame | None = None) -> DataFrame:
    """Best entry of each (sample group, modseq, charge) over the group's runs: runs (run, modseq, charge, score, ...), groups (run,
    sample).  `coarse`: windows into which the scans' cycles are merged first (cycle, low, high, rt, time)."""
    from peakfold.operators.aggregates import best_per_key

    x = runs if coarse is None else scans.downsample_windows(runs, coarse)
    return best_per_key(x.join(F.broadcast(groups), "run") if groups.count() <= 100_000 else x.join(groups, "run"), ["sample", "modseq", "charge"], "score", [F.col("run")])


# -- sequences ---------------------------------------------------------------------------------------------------------


def transition_counts(sequences: DataFrame, column: str, order: int = 1) -> DataFrame:
    """How often each letter follows each run of `order` letters: (context, next, n); ^ pads the start, $ is the end."""
    padded = F.concat(F.lit("^" * order), F.col(column), F.lit("$"))
    pairs = F.transform(F.sequence(F.lit(1), F.length(column) + 1), lambda i: F.struct(F.substr(padded, i, F.lit(order)).alias("context"), F.substr(padded, i + order, F.lit(1)).alias("next")))
    return sequences.where(F.col(column).isNotNull()).select(F.explode(pairs).alias("p")).groupBy("p.context", "p.next").agg(F.count(F.lit(1)).alias("n"))


def markov_sequences(counts: DataFrame, rows: DataFrame, ident: str, order: int = 1, longest: int = 400) -> DataFrame:
    """A sequence for each row, drawn letter by letter from transition counts by a hash of (ident, place).  The model is one row of at
    most (letters ^ (order + 1)) entries."""
    upto = Window.partitionBy("context").orderBy("next").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = counts.withColumn("z", F.sum("n").over(upto)).withColumn("t", F.sum("n").over(Window.partitionBy("context")))
    per = cum.groupBy("context").agg(F.array_sort(F.collect_list(F.struct((F.col("z") / F.col("t")).alias("z"), "next"))).alias("v"))
    model = per.agg(F.map_from_entries(F.collect_list(F.struct("context", "v"))).alias("__m"))
    x = rows.select(ident).join(F.broadcast(model))  # one row

    def step(s, k):
        u = F.pmod(F.xxhash64(F.col(ident), k), F.lit(1 << 52)) / (1 << 52)
        letter = F.element_at(F.filter(F.col("__m")[F.right(s, F.lit(order))], lambda e: e["z"] > u), 1)["next"]
        return F.when(s.endswith("$"), s).otherwise(F.concat(s, letter))

    made = F.aggregate(F.sequence(F.lit(1), F.lit(longest)), F.lit("^" * order), step)
    return x.select(ident, F.rtrim(F.substr(made, F.lit(order + 1)), F.lit("$")).alias("sequence"))
