"""Named flows, composed of the operators: searches, rescoring, reports, localisation, library upkeep.

Every flow is DataFrame in, DataFrame out, lazily; kernels run where an operator needs row-to-row state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakfold.functions import arrays as A
from peakfold.functions import sequences as seq
from peakfold.operators import aggregates as agg
from peakfold.operators import generators as gen
from peakfold.operators import joins, kernels, setops
from peakfold.operators import statistics as st
from peakfold.operators import windows as win
from peakfold.operators.components import bridge_components


def peak_matches(scans: DataFrame, ions: DataFrame, ppm: float) -> DataFrame:
    """scans (scan, rt, low, high, peaks), ions (candidate, precursor_mz, mz, weight): one row a matched ion of a
    (scan, candidate): the most intense peak within the tolerance.

    The range join on the isolation window comes first and carries keys only; peaks and ions then meet in a band join.
    """
    windows = scans.select("scan", "low", "high")
    width = 25.0
    cand = ions.select("candidate", "precursor_mz").distinct()
    pairs = joins.range_join(cand, windows, "precursor_mz", "low", "high", width).select("scan", "candidate")
    sp = scans.select("scan", "rt", F.explode("peaks").alias("p")).select("scan", "rt", F.col("p.mz").alias("peak_mz"), F.col("p.intensity").alias("intensity"))
    wanted = pairs.join(ions.select("candidate", F.col("mz").alias("ion_mz"), "weight"), "candidate")
    hit = joins.band_join(sp, wanted.withColumnRenamed("scan", "scan2"), "peak_mz", "ion_mz", ppm, F.col("scan") == F.col("scan2"))
    return hit.groupBy("scan", "rt", "candidate", "ion_mz").agg(F.max("intensity").alias("intensity"), F.first("weight").alias("weight"))


def library_search(scans: DataFrame, ions: DataFrame, ppm: float = 10.0, k: int = 3, zone: int = 4, least_ions: int = 3) -> DataFrame:
    """Best k separate scans of each candidate: candidate, scan, rt, score, rank, matches, dot, evalue."""
    m = peak_matches(scans, ions, ppm)
    s = m.groupBy("candidate", "scan", "rt").agg(F.count(F.lit(1)).alias("matches"), F.sum(F.col("weight") * F.sqrt("intensity")).alias("dot")).where(F.col("matches") >= least_ions)
    s = s.withColumn("score", A.xtandem_score(F.col("dot"), F.col("matches")))
    best = kernels.topk_exclusion(s, ["candidate"], ["rt"], "scan", "score", k, zone)
    fit = st.e_value_fit(s, ["candidate"], "score")
    out = best.join(s.select("candidate", "scan", "rt", "matches", "dot"), ["candidate", "scan"]).join(fit, "candidate")
    return out.withColumn("evalue", F.coalesce(st.e_value(F.col("score"), F.col("slope"), F.col("intercept")), F.lit(-1.0))).drop("slope", "intercept")


def with_fragment_ions(peptides: DataFrame, most_charge: int = 1) -> DataFrame:
    """peptides (candidate, sequence, precursor_mz) as ions of even weight, for searches without a library."""
    return gen.fragments(peptides, "sequence", most_charge).select("candidate", "precursor_mz", "mz", F.lit(1.0).alias("weight"))


def fasta_search(scans: DataFrame, proteins: DataFrame, charge: int = 2, enzyme: str = "trypsin", **how) -> DataFrame:
    """Digest, add decoys, expand to ions, search; peptides outside all windows go before ions are made."""
    from peakfold.functions import chemistry as chem

    pep = gen.digest(proteins, "sequence", enzyme).select(F.col("peptide").alias("sequence")).distinct()
    pep = gen.with_decoys(pep.withColumn("id", F.col("sequence")), "sequence", "id")
    pep = pep.select(F.concat_ws("|", "kind", "sequence").alias("candidate"), "sequence", chem.charged_mass(chem.sequence_mass(F.col("sequence")), F.lit(charge)).alias("precursor_mz"))
    return library_search(scans, with_fragment_ions(pep), **how)


def spectrum_search(spectra: DataFrame, library: DataFrame, ppm: float = 20.0, k: int = 2) -> DataFrame:
    """spectra and library (id, precursor_mz, vector): the best k library entries of each spectrum by fit error score, with the
    margin to the next."""
    a = spectra.select(F.col("id").alias("spectrum"), F.col("precursor_mz").alias("a_mz"), F.col("vector").alias("a_vec"))
    b = library.select(F.col("id").alias("entry"), F.col("precursor_mz").alias("b_mz"), F.col("vector").alias("b_vec"))
    s = joins.band_join(a, b, "a_mz", "b_mz", ppm).withColumn("score", A.fit_error_score(F.col("b_vec"), F.col("a_vec")))
    w = Window.partitionBy("spectrum").orderBy(F.desc("score"), "entry")
    s = s.withColumn("rank", F.row_number().over(w)).withColumn("delta", F.col("score") - F.coalesce(F.lead("score").over(w), F.lit(0.0)))
    return s.where(F.col("rank") <= k).select("spectrum", "entry", "score", "delta", "rank")


def rescore(features: DataFrame, names: list[str], decoy: str, ident: str, key: list[str], threshold: float = 0.01) -> DataFrame:
    """Semi-supervised score, one row a key, q-values; all rows with q, and whether they pass."""
    scored = kernels.lda_semi_supervised(features, names, decoy, ident)
    best = agg.best_per_key(scored, key, "lda_score", [F.col(ident)]).withColumn("__g", F.lit(0))
    q = st.tdc_q_values(best, ["__g"], "lda_score", F.col(decoy)).drop("__g")
    return q.withColumn("passes", (F.col("q") <= threshold) & ~F.col(decoy))


def apply_model(features: DataFrame, names: list[str], coefficients: dict[str, float], constant: float) -> DataFrame:
    """Score with a given model; features are matched by name, and those the table lacks count as 0."""
    terms = [F.coalesce(F.col(n), F.lit(0.0)) * c for n, c in coefficients.items() if n in names]
    return features.withColumn("score", sum(terms, F.lit(float(constant))))


def quant_report(runs: list[DataFrame], passing: DataFrame, bridge: DataFrame, files: list[str]) -> tuple[DataFrame, DataFrame]:
    """(peptide matrix, protein matrix): runs (file, modseq, seq, charge, intensity) of passing (modseq, charge); bridge
    (seq, accession).  Charge states add up, files are normalised, proteins get what is theirs alone."""
    x = joins.passing(setops.union_runs(runs), passing.distinct(), ["modseq", "charge"])
    n = agg.tic_normalize(x, "file", "intensity")
    peptides = agg.intensity_matrix(n, "seq", "file", "normalized", files)
    alone = bridge.distinct().groupBy("seq").agg(F.count(F.lit(1)).alias("__n"), F.first("accession").alias("accession")).where("__n = 1").drop("__n")
    proteins = agg.intensity_matrix(n.join(alone, "seq"), "accession", "file", "normalized", files)
    return peptides, proteins


def integrate(points: DataFrame, key: list[str], x: str = "rt", y: str = "intensity", smooth: int = 5) -> DataFrame:
    """Smoothed traces (key, rt, intensity) integrated between their own boundaries, above the background."""
    s = win.savitzky_golay(points, key, [x], y, smooth, "smoothed")
    b = kernels.bounds(s, key, x, "smoothed")
    inside = s.join(b, key).where(F.col(x).between(F.col("start"), F.col("stop")))
    return win.trapezoid_area(inside, key, x, "smoothed").join(b, key)


def refine_transitions(points: DataFrame, key: list[str], member: str, x: str = "rt", y: str = "intensity", quant: float = 0.9, identify: float = 0.75) -> DataFrame:
    """Correlation of each transition with the median trace of its group, and what it is good for."""
    n = win.normalize_trace(points, [*key, member], [x], y)
    m = win.median_trace(n, key, x, "normalized")
    c = win.trace_correlation(n.join(m, [*key, x]), [*key, member], "normalized", "median")
    return c.withColumn("quantitative", F.col("correlation") >= quant).withColumn("identifying", F.col("correlation") >= identify)


def localize(peptides: DataFrame, evidence: DataFrame, residues: str, k: int, ppm: float = 10.0, threshold: float = 0.05) -> DataFrame:
    """peptides (candidate, sequence): all placements of k modifications, scored by -log10 of the background frequency of the
    ions that only one placement has: evidence (candidate, mz, frequency).  The best form of each candidate and its FDR."""
    forms = gen.site_choices(peptides, "sequence", residues, k).withColumn("form", F.array_join(F.transform("sites", lambda i: i.cast("string")), ","))
    masses = gen.fragments(forms.select("candidate", "form", "sequence", "sites"), "sequence", 1)
    moved = F.aggregate("sites", F.lit(0), lambda s, i: s + F.when(F.col("ion") == "b", (i < F.col("index")).cast("int")).otherwise((i >= F.length("sequence") - F.col("index")).cast("int")))
    ions = masses.withColumn("mz", F.col("mz") + 79.966331 * moved)
    unique = ions.groupBy("candidate", F.round("mz", 4).alias("mz")).agg(F.min("form").alias("form"), F.countDistinct("form").alias("n")).where("n = 1")
    hit = joins.band_join(unique.withColumnRenamed("mz", "ion_mz"), evidence.select(F.col("candidate").alias("c2"), F.col("mz").alias("peak_mz"), "frequency"), "ion_mz", "peak_mz", ppm, F.col("candidate") == F.col("c2"))
    score = hit.groupBy("candidate", "form", "ion_mz").agg(F.min("frequency").alias("f")).groupBy("candidate", "form").agg(F.sum(-F.log10("f")).alias("score"), F.count(F.lit(1)).alias("ions"))
    w = Window.partitionBy("candidate").orderBy(F.desc("score"), "form")
    best = score.withColumn("__r", F.row_number().over(w)).withColumn("margin", F.col("score") - F.coalesce(F.lead("score").over(w), F.lit(0.0))).where("__r = 1").drop("__r")
    return st.localization_fdr(best, "margin", threshold)


def protein_groups(bridge: DataFrame, scores: DataFrame) -> DataFrame:
    """bridge (seq, accession), scores (seq, pep): parsimonious groups per connected component, found by star contraction."""
    b = bridge.join(scores.groupBy("seq").agg(F.min("pep").alias("error")), "seq")
    labels = bridge_components(b, "seq", "accession")
    return kernels.parsimony_groups(b.join(labels, "accession").withColumnRenamed("accession", "grp"), "seq", "grp", "error", "component")


def protein_q_values(groups: DataFrame, ranges: int = 1) -> DataFrame:
    """groups (members, least_error): q-values from groups whose members are all decoys."""
    decoy = F.forall(F.split("members", ";"), lambda a: a.startswith("DECOY_"))
    return st.tdc_q_values(groups.withColumn("decoy", decoy).withColumn("__g", F.lit(0)), ["__g"], "least_error", F.col("decoy"), higher=False, ranges=ranges).drop("__g")


def clean_library(entries: DataFrame, proteins: DataFrame, score: str = "score") -> DataFrame:
    """The best entry of each modified sequence and charge; accessions rebuilt from the proteins that hold the sequence,
    entries of no protein dropped."""
    best = agg.best_per_key(entries.drop("accessions"), ["modseq", "charge"], score, [F.col("source")])
    hits = joins.substring_join(best.select("seq").distinct(), proteins.select("accession", "sequence"), "seq", "sequence", 6)
    return best.join(agg.group_accessions(hits, ["seq"], "accession"), "seq")


def coverage(peptides: DataFrame, proteins: DataFrame) -> DataFrame:
    """Per protein: peptides, unique peptides, share of residues covered."""
    hits = joins.substring_join(peptides.select(F.col("seq").alias("piece")).distinct(), proteins.select("accession", "sequence"), "piece", "sequence", 6)
    return joins.covered_share(hits, ["accession"], "sequence", "piece")


def modify_library(entries: DataFrame, residues: str, mass: float, keep: bool = True) -> DataFrame:
    """Entries with each placement of one modification; precursors move by its mass."""
    forms = gen.modified_forms(entries, "modseq", residues, f"[{mass:+}]").where(F.col("form") != F.col("modseq"))
    forms = forms.withColumn("precursor_mz", F.col("precursor_mz") + mass / F.col("charge")).withColumn("modseq", F.col("form")).drop("form")
    return setops.union_runs([entries, forms]) if keep else forms


def decoy_library(entries: DataFrame) -> DataFrame:
    """Entries and their decoys: sequences reversed inside, peaks shifted where they match a fragment of the target."""
    ions = gen.fragments(entries.select("modseq", "seq"), "seq", 1).groupBy("modseq").agg(F.collect_list(F.col("mz")).alias("targets"))
    d = entries.join(ions, "modseq").withColumn("peaks", gen.shifted_peaks(F.col("peaks"), F.transform("targets", lambda t: t), 14.01565, 20.0)).drop("targets")
    d = d.withColumn("modseq", seq.reverse_inside(F.col("modseq"))).withColumn("seq", seq.reverse_inside(F.col("seq")))
    return entries.withColumn("decoy", F.lit(False)).unionByName(d.withColumn("decoy", F.lit(True)))


def consensus_times(libraries: list[DataFrame], key: list[str], rt: str) -> DataFrame:
    """Mean time of each key after every library was fitted by a line to the largest one."""
    sized = sorted(((df.count(), i, df) for i, df in enumerate(libraries)), key=lambda x: (-x[0], x[1]))
    base = sized[0][2].select(*key, F.col(rt).alias("__t"))
    fitted = [base.withColumn("__s", F.lit(0))]
    for n, (_, _, df) in enumerate(sized[1:], 1):
        pair = df.select(*key, F.col(rt).alias("__x")).join(base, key).agg(F.regr_slope("__t", "__x").alias("m"), F.regr_intercept("__t", "__x").alias("b"))
        fitted.append(df.join(F.broadcast(pair)).select(*key, (F.coalesce("m", F.lit(1.0)) * F.col(rt) + F.coalesce("b", F.lit(0.0))).alias("__t"), F.lit(n).alias("__s")))  # pair is one row
    return setops.union_runs(fitted).groupBy(*key).agg(F.avg("__t").alias(rt), F.count(F.lit(1)).alias("n"))


def bootstrap_targets(entries: DataFrame, ident: str, n: int, seed: int = 1) -> DataFrame:
    """n targets drawn by hash, the same on every run, and their decoys."""
    drawn = entries.orderBy(F.xxhash64(ident, F.lit(seed)), ident).limit(n)
    return setops.targets_and_decoys(drawn, "modseq")


def encode_sequences(df: DataFrame, sequence: str, length: int) -> DataFrame:
    """Residues as indices 1 to 20, padded with 0 (unknown letters are 0)."""
    letters = "ACDEFGHIKLMNPQRSTVWY"
    table = F.create_map(*[F.lit(x) for i, a in enumerate(letters, 1) for x in (a, i)])
    codes = F.transform(F.filter(F.split(seq.strip_modifications(F.col(sequence)), ""), lambda a: a != ""), lambda a: F.coalesce(table[a], F.lit(0)))
    return df.withColumn("codes", F.slice(F.concat(codes, F.array_repeat(F.lit(0), length)), 1, length))
