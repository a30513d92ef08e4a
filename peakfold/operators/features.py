"""Feature vectors of scored candidates, model plug-ins, and what flows need beside joins and windows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakfold.functions import arrays as A
from peakfold.functions import chemistry as chem
from peakfold.functions import sequences as seq
from peakfold.operators import joins, kernels


@dataclass(frozen=True)
class Scorer:
    """A plug-in score: an expression over the columns of a candidate table, its name and its value without data."""

    name: str
    expression: Callable[[], Column]
    missing: float = 0.0


SCORERS: dict[str, Scorer] = {}


def register(scorer: Scorer) -> Scorer:
    SCORERS[scorer.name] = scorer
    return scorer


register(Scorer("xtandem", lambda: A.xtandem_score(F.col("dot"), F.col("matches"))))
register(Scorer("log_dot", lambda: A.protected_log(F.col("dot"), 10)))
register(Scorer("match_share", lambda: F.try_divide(F.col("matches"), F.col("n_ions"))))
register(Scorer("mean_ppm", lambda: F.col("ppm_sum") / F.col("matches")))
register(Scorer("mean_abs_ppm", lambda: F.col("ppm_abs_sum") / F.col("matches"), 20.0))
register(Scorer("tic_share", lambda: F.try_divide(F.col("matched_intensity"), F.col("tic"))))


def score(df: DataFrame, names: list[str]) -> DataFrame:
    """Adds the named scores; rows that lack what a score needs get its missing value."""
    return df.withColumns({n: F.coalesce(F.nanvl(SCORERS[n].expression().cast("double"), F.lit(None)), F.lit(SCORERS[n].missing)) for n in names})


def matched_summary(matches: DataFrame, scans: DataFrame, ions: DataFrame) -> DataFrame:
    """matches (scan, candidate, ion_mz, peak_mz, intensity, weight) as one row a (scan, candidate) with what scores need."""
    ppm = A.delta_ppm(F.col("peak_mz"), F.col("ion_mz"))
    m = matches.groupBy("scan", "candidate").agg(F.count(F.lit(1)).alias("matches"), F.sum(F.col("weight") * F.sqrt("intensity")).alias("dot"), F.sum("intensity").alias("matched_intensity"), F.sum(ppm).alias("ppm_sum"), F.sum(F.abs(ppm)).alias("ppm_abs_sum"))
    return m.join(scans.select("scan", A.peak_total(F.col("peaks")).alias("tic")), "scan").join(ions.groupBy("candidate").agg(F.count(F.lit(1)).alias("n_ions")), "candidate")


def peptide_columns(df: DataFrame, sequence: str, charge: str) -> DataFrame:
    """Columns of a feature table: missed cleavages, length, charges 1 to 4 as indicators, flanked sequence."""
    plain = seq.strip_modifications(F.col(sequence))
    cols = {"missed": chem.missed_cleavages(plain), "pep_length": F.length(plain), "flanked": F.concat(F.lit("-."), F.col(sequence), F.lit(".-"))}
    return df.withColumns(cols | {f"charge{z}": (F.col(charge) == z).cast("int") for z in range(1, 5)})


def precursor_columns(df: DataFrame, packet: str, expected: str) -> DataFrame:
    """Isotope features of packets (-1, 0, +1, +2)."""
    return df.withColumns({"isotope_dot": A.isotope_dot(F.col(packet), F.col(expected)), "blank_ratio": A.blank_ratio(F.col(packet)), "isotope_matches": F.size(F.filter(packet, lambda x: x > 0))})


def z_scores(df: DataFrame, background: DataFrame, key: list[str], score_column: str) -> DataFrame:
    """Scores less the mean of their background, over its deviation (0 without one)."""
    x = df.join(background, key, "left")
    return x.withColumn("z", F.coalesce((F.col(score_column) - F.col("bg_mean")) / F.nullif(F.col("bg_stdev"), F.lit(0.0)), F.lit(0.0)))


def xcorr_scores(df: DataFrame) -> DataFrame:
    """Adds `xcorr` to rows with `peaks` and `ions` (array<double>), in Arrow batches."""

    @F.pandas_udf("double")
    def run(mz: pd.Series, intensity: pd.Series, ions: pd.Series) -> pd.Series:
        return pd.Series([kernels.xcorr(np.asarray(t, float), np.asarray(m, float), np.asarray(y, float)) for m, y, t in zip(mz, intensity, ions)])

    return df.withColumn("xcorr", run(F.transform("peaks", lambda p: p["mz"]), F.transform("peaks", lambda p: p["intensity"]), F.col("ions")))


def xcorr_pair(df: DataFrame) -> DataFrame:
    """Adds `xcorr_lib` and `xcorr_model` to rows with `peaks`, `library` (both array<struct<mz, intensity>>) and `ions` (array<double>):
    the spectrum against the library's peaks by their intensities, and against the theoretical ions as equals."""
    parts = lambda c: (F.transform(c, lambda p: p["mz"]), F.transform(c, lambda p: p["intensity"]))

    @F.pandas_udf("struct<lib: double, model: double>")
    def run(mz: pd.Series, intensity: pd.Series, lib_mz: pd.Series, lib_intensity: pd.Series, ions: pd.Series) -> pd.DataFrame:
        rows = [[np.asarray(c, float) for c in r] for r in zip(mz, intensity, lib_mz, lib_intensity, ions)]
        return pd.DataFrame({"lib": [kernels.xcorr(a, m, y, weights=b) for m, y, a, b, _ in rows], "model": [kernels.xcorr(t, m, y) for m, y, _, _, t in rows]})

    x = df.withColumn("__x", run(*parts("peaks"), *parts("library"), F.col("ions")))
    return x.withColumns({"xcorr_lib": F.col("__x.lib"), "xcorr_model": F.col("__x.model")}).drop("__x")


def isotope_columns(df: DataFrame, sequence: str, peaks: int = 5) -> DataFrame:
    """Adds `isotopes`, the expected isotope distribution of a sequence (modifications left out)."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        water = np.array([2, 0, 1, 0, 0])
        return s.map(lambda x: kernels.isotope_distribution(sum((np.array(chem.ATOMS.get(a, (0, 0, 0, 0, 0))) for a in x), water), peaks))

    return df.withColumn("isotopes", run(seq.strip_modifications(F.col(sequence))))


def has_modification(sequence: Column, residues: str, mass: str | None = None) -> Column:
    """A residue of the given kinds carries a modification (of that mass, if given)."""
    mark = r"\[[^\]]*\]" if mass is None else r"\[\+?" + mass.replace(".", r"\.") + r"[0-9]*\]"
    return sequence.rlike(f"[{residues}]{mark}")


def exclude_ions(peaks: DataFrame, excluded: DataFrame, width: float = 0.05) -> DataFrame:
    """Peaks (mz, rt) that no exclusion (x_low, x_high, x_start, x_stop) covers."""
    return joins.range_join(peaks, excluded, "mz", "x_low", "x_high", width, F.col("rt").between(F.col("x_start"), F.col("x_stop")), "left_anti")


def variant_sequences(proteins: DataFrame, variants: DataFrame) -> DataFrame:
    """proteins (accession, sequence), variants (accession, position from 1, residues): each protein with one variant put in,
    and where it is."""
    x = proteins.join(variants, "accession")
    changed = F.concat(F.substr("sequence", F.lit(1), F.col("position") - 1), "residues", F.substr("sequence", F.col("position") + 1))
    return x.where(F.col("position").between(1, F.length("sequence"))).select("accession", F.concat("accession", F.lit("_"), F.col("position").cast("string"), "residues").alias("variant"), changed.alias("sequence"), "position", F.length("residues").alias("width"))


def variant_peptides(proteins: DataFrame, variants: DataFrame, enzyme: str = "trypsin", missed: int = 1) -> DataFrame:
    """Peptides of variant proteins that hold the variant."""
    from peakfold.operators.generators import digest

    d = digest(variant_sequences(proteins, variants), "sequence", enzyme, missed)
    return d.where((F.col("start") < F.col("position") - 1 + F.col("width")) & (F.col("start") + F.length("peptide") >= F.col("position"))).select("accession", "variant", "peptide", "start")


def parse_mass_map(text: str) -> dict[str, float]:
    """`C=57.02,n=42.01` as residue or terminus (n, c) -> mass; blanks are ignored, a residue named twice adds up."""
    out: dict[str, float] = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        name, _, mass = part.partition("=")
        if len(name.strip()) != 1 or not mass:
            raise ValueError(f"not a modification: {part!r}")
        out[name.strip()] = out.get(name.strip(), 0.0) + float(mass)
    return out


def apply_mass_map(sequence: Column, masses: dict[str, float]) -> Column:
    """Put fixed modifications behind their residues; residues that carry one already stay."""
    out = sequence
    for residue, mass in masses.items():
        if residue.isupper():
            out = F.regexp_replace(out, rf"{residue}(?!\[)", rf"{residue}[{mass:+g}]")
    return out


def shuffled(df: DataFrame, sequence: str, seed: int = 1) -> DataFrame:
    """Sequences shuffled between their ends, each by its own hash, so reruns agree; collisions with the input go."""
    t = seq.tokens(F.col(sequence))
    middle = F.slice(t, 2, F.greatest(F.size(t) - 2, F.lit(0)))
    mixed = F.transform(F.array_sort(F.transform(middle, lambda x, i: F.struct(F.xxhash64(F.col(sequence), i, F.lit(seed)).alias("k"), x.alias("x")))), lambda s: s["x"])
    out = F.when(F.size(t) > 2, F.array_join(F.concat(F.slice(t, 1, 1), mixed, F.slice(t, F.size(t), 1)), "")).otherwise(F.col(sequence))
    return df.withColumn(sequence, out).join(df.select(sequence).distinct(), sequence, "left_anti").select(*df.columns)


def sequence_per_candidate_margin(df: DataFrame, key: list[str], sequence: str, score_column: str, most: int = 2) -> DataFrame:
    """Best row of each key and its margin to the best row whose sequence is not similar (more than `most` mismatches)."""
    w = Window.partitionBy(*key).orderBy(F.desc(score_column), sequence)
    best = df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    other = df.select(*key, F.col(sequence).alias("__s"), F.col(score_column).alias("__v")).join(best.select(*key, F.col(sequence).alias("__b")), key)
    unlike = other.where(F.coalesce(seq.mismatches(F.col("__s"), F.col("__b")), F.lit(most + 1)) > most).groupBy(*key).agg(F.max("__v").alias("__next"))
    return best.join(unlike, key, "left").withColumn("margin", F.col(score_column) - F.coalesce("__next", F.lit(0.0))).drop("__next")


def random_forest(df: DataFrame, features: list[str], label: str, trees: int = 50, seed: int = 1):
    """A fitted forest of Spark ML and the table with its probability of label 1."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    x = VectorAssembler(inputCols=features, outputCol="__x").transform(df)
    model = RandomForestClassifier(featuresCol="__x", labelCol=label, numTrees=trees, seed=seed, probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__y").fit(x)
    return model, model.transform(x).withColumn("probability", vector_to_array("__p")[1]).drop("__x", "__p", "__raw", "__y")


def select_transitions(df: DataFrame, key: list[str], member: str, sample: str, value: str, least: int = 3) -> DataFrame:
    """Transitions of each key whose share varies least over the samples: key, member."""
    types = dict(df.dtypes)

    def kernel(members, samples, values):
        m = pd.DataFrame({"m": members, "s": samples, "v": values.astype(float)}).pivot_table(index="s", columns="m", values="v", aggfunc="sum", fill_value=0.0)
        return {member: m.columns.to_numpy()[kernels.select_transitions(m.to_numpy(), least)]}

    return kernels.per_group(df, key, [sample, member], [member, sample, value], f"`{member}` {types[member]}", kernel)


def delta_time_summary(df: DataFrame, key: list[str], delta: str, score_column: str) -> DataFrame:
    """Per key: mode of the deviation (median for few values), its interquartile range, an upper quantile of the score."""

    def kernel(d, s):
        d, s = d.astype(float), s.astype(float)
        n = len(d)
        centre = kernels.mode(d) if n > 10 else float(np.median(d))
        return {"centre": [centre], "iqr": [float(np.subtract(*np.percentile(d, [75, 25])))], "score_cut": [float(np.quantile(s, max(0.5, 1 - 3 / n) if n > 3 else 0.5))], "n": [n]}

    return kernels.per_group(df, key, [delta, score_column], [delta, score_column], "centre double, iqr double, score_cut double, n long", kernel)
