"""Reports, alignment of runs, notation and trace scores: by hand, by loops, by laws."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakfold.functions import notation
from peakfold.operators import tracescore
from peakfold.plans import reports


def test_uncertain_sites(spark):
    rows = [("ASPTSK", [[1, 4], [1, 3]]), ("ASPTSK", [[1], [3], [4]]), ("SSSK", [[0, 1], [1, 2]]), ("ASPTSK", [[1, 4]])]
    df = spark.createDataFrame(rows, "seq string, forms array<array<int>>").withColumn("g", notation.site_groups(F.col("forms")))
    out = df.select(notation.ambiguous_notation(F.col("seq"), F.col("g")).alias("n"), notation.ambiguous_residues(F.col("g")).alias("r"), notation.without(F.col("forms"), F.array(F.lit(1))).alias("w")).collect()
    assert [r.n for r in out] == ["AS[1!]PT[2]S[2]K", "AS[1]PT[1]S[1]K", "S[1]S[1]S[1]K", "AS[1!]PTS[2!]K"]
    assert [r.r for r in out] == [2, 3, 3, 0] and out[0].w == [[1, 4], [1, 3]] and out[1].w == [[1]]


def test_ion_strings(spark):
    df = spark.createDataFrame([("y7",), ("b12++",), ("nonsense",), (None,)], "n string")
    assert [r.p and tuple(r.p) for r in df.select(notation.parse_ion(F.col("n")).alias("p")).collect()] == [("y", 7, 1), ("b", 12, 2), None, None]
    df = spark.createDataFrame([(" ",), ("null",), (None,), ("y|1|175.1,b|2|200.25",)], "s string")
    assert [len(r.i) for r in df.select(notation.from_archive(F.col("s")).alias("i")).collect()] == [0, 0, 0, 2]
    got = spark.createDataFrame([("C[57.02]K[Acetyl]M[15.9949]A[+1.5]S[odd]",)], "m string").select(notation.canonical_masses(F.col("m"))).first()[0]
    assert got == "C[+57.021464]K[+42.010565]M[+15.994915]A[+1.500000]S[odd]"


def run_points(rng, n, scale, shift, noise=0.05):
    return [(f"P{i}", float(x), float(scale * x + shift + rng.normal() * noise)) for i, x in enumerate(rng.uniform(5, 95, n))]


def test_locations_are_inferred(spark):
    rng = np.random.default_rng(1)
    base = [(f"P{i}", float(x)) for i, x in enumerate(rng.uniform(5, 95, 300))]
    rows = [("seed", m, x) for m, x in base]
    rows += [("late", m, 1.1 * x + 3 + rng.normal() * 0.02) for m, x in base[:250]]
    rows[-1] = ("late", rows[-1][1], rows[-1][2] + 40)  # found in the wrong place
    rows += [("few", m, x) for m, x in base[:1]]
    got = {(r.run, r.modseq): (r.rt, r.observed) for r in reports.peak_locations(spark.createDataFrame(rows, "run string, modseq string, rt double")).collect()}
    assert len(got) == 900
    late = [(got["late", m], 1.1 * x + 3) for m, x in base]
    assert sum(o for (_, o), _ in late) >= 230 and not got["late", "P249"][1]
    # Times outside what the pairs cover are flat, so the ends are left out.
    assert all(abs(t - want) < 1.5 for ((t, _), want), (_, x) in zip(late, base) if 12 < x < 88)


def test_fractions_get_the_times_of_a_run(spark):
    rng = np.random.default_rng(2)
    ref = [(f"P{i}", float(x)) for i, x in enumerate(rng.uniform(5, 95, 200))]
    rows = [(f, m, 0.5 * x + 2 * (f == "b")) for f in "ab" for m, x in ref[:150]] + [("a", "Q", 25.0)]
    out = reports.aligned_fractions(spark.createDataFrame(rows, "fraction string, modseq string, rt double").withColumn("score", F.lit(1)), spark.createDataFrame(ref, "modseq string, rt double"))
    want = dict(ref)
    got = [(r.modseq, r.rt) for r in out.collect()]
    assert len(got) == 301 and "score" in out.columns
    assert np.median([abs(t - want[m]) for m, t in got if m in want]) < 0.5 and abs(dict(got)["Q"] - 50) < 1.5


def test_mass_errors_follow_their_ridge(spark):
    rng = np.random.default_rng(3)
    rows = [("r", i, float(x), float(2 + 0.05 * x + rng.normal() * 0.1)) for i, x in enumerate(rng.uniform(0, 100, 400))] + [("one", 999, 5.0, 3.0)]
    got = reports.corrected_mass_errors(spark.createDataFrame(rows, "run string, id int, rt double, error double"), ["run"], "rt", "error", "id").collect()
    assert len(got) == 401 and abs(np.median([r.corrected for r in got if r.run == "r"])) < 0.2 and np.std([r.corrected for r in got if r.run == "r"]) < 0.5


def test_small_reports(spark):
    f = spark.createDataFrame([("A[+1]B", 3.0, 1), ("AB", 5.0, 2), ("CD", 1.0, 3), ("C[+2]D", 0.5, 4)], "modseq string, score double, id int")
    on, off = reports.on_list(f, spark.createDataFrame([("AB",), ("XY",)], "modseq string"), "modseq")
    assert [r.id for r in on.collect()] == [2] and [r.id for r in off.collect()] == [3]
    assert reports.tee(f, lambda d: d.count(), lambda d: d.agg(F.sum("score")).first()[0]) == [4, 9.5]
    both = reports.rounds_file([f.limit(1), f])
    assert sorted((r.member, r.id) for r in both.collect()) == [(0, 1), (1, 1), (1, 2), (1, 3), (1, 4)]
    assert reports.processed(f, lambda d: d.where("id > 1"), lambda d: d.where("score > 0.6")).count() == 2
    assert {r.score for r in reports.updated(f, score=F.col("score") * 2).collect()} == {6.0, 10.0, 2.0, 1.0}
    with pytest.raises(ValueError):
        reports.updated(f, unknown=F.lit(1))
    p = spark.createDataFrame([("B;A", "0.005", "0.1", "x y z"), ("A,B", "0.001", "0.2", "x"), ("C", "0.5", "0.9", "q"), ("D", "bad", "1", "q")], "ProteinId string, `q-value` string, posterior_error_prob string, peptideIds string").withColumn("q-value", F.col("`q-value`").try_cast("double"))
    assert [(r.accessions, r.q, r.peptides) for r in reports.passing_proteins(p, 0.01).collect()] == [("A;B", 0.001, 1)]
    loc = spark.createDataFrame([("AS", 2, "a", 3.0, False, 1), ("AS", 2, "b", 1.0, True, 2), ("AS", 3, "c", 1.0, False, 1)], "modseq string, charge int, form string, score double, is_site_specific boolean, n_ambiguous int")
    assert sorted((r.charge, r.form, r.site_specific) for r in reports.localization_report(loc).collect()) == [(2, "b", "yes"), (3, "c", "no")]


def test_markov_sequences_follow_their_model(spark):
    seqs = spark.createDataFrame([("ABAB",), ("ABA",), ("",), (None,), ("BAB",)], "s string")
    counts = reports.transition_counts(seqs, "s")
    assert {(r.context, r.next): r.n for r in counts.collect()} == {("^", "A"): 2, ("^", "B"): 1, ("^", "$"): 1, ("A", "B"): 4, ("B", "A"): 3, ("B", "$"): 2, ("A", "$"): 1}
    made = [r.sequence for r in reports.markov_sequences(counts, spark.range(2000), "id").collect()]
    assert len(made) == 2000 and all(x != y for m in made for x, y in zip(m, m[1:])) and set("".join(made)) <= {"A", "B"}
    assert 0.4 < sum(m[:1] == "A" for m in made) / 2000 < 0.6 and 0.18 < sum(m == "" for m in made) / 2000 < 0.32
    assert made == [r.sequence for r in reports.markov_sequences(counts, spark.range(2000), "id").collect()]


def test_traces_by_loops(spark):
    """Every step of the trace scores, scan by scan."""
    rng = np.random.default_rng(4)
    n, ions, width, least = 25, 5, 4, 3
    v = np.where(rng.random((ions, n)) < 0.7, rng.random((ions, n)), 0)
    v[:, 8:17] += np.exp(-0.5 * ((np.arange(9) - 4) / 1.5) ** 2) * (1 + np.arange(ions))[:, None]
    df = spark.createDataFrame([("c", k, j, float(v[k, j])) for k in range(ions) for j in range(n)], "c string, ion int, at int, v double")
    got = {r["at"]: r for r in tracescore.trace_scores(df, ["c"], "ion", "at", "v", width, least).collect()}
    share = np.zeros_like(v)
    for k, j in itertools.product(range(ions), range(n)):
        total = v[k, max(0, j - 2) : j + 4].sum()
        share[k, j] = v[k, j] / total if total > 0 else 0
    med = np.zeros(n)
    for j in range(n):
        live = sorted(x for x in share[:, j] if x > 0)
        med[j] = np.quantile(live, 1 - least / len(live)) if len(live) >= least else 0
    s, tiers = np.zeros(n), np.zeros(n)
    for k, j in itertools.product(range(ions), range(2, n - 2)):
        if med[j] > med[j - 2] and med[j] > med[j + 2]:
            a, b = v[k, j - 2 : j + 3], med[j - 2 : j + 3]
            r = np.corrcoef(a, b)[0, 1] if a.std() > 0 and b.std() > 0 else 0
            s[j] += r
            tiers[j] += next((w for c, w in tracescore.TIERS if r > c), 0)
    smooth = [(s[min(j, n - 2)] + s[min(j, n - 2) + 1]) / 2 for j in range(n)]
    for j in range(n):
        assert got[j]["median"] == pytest.approx(med[j], abs=1e-9) and got[j].tiers == pytest.approx(tiers[j], abs=1e-9)
        assert got[j].correlation_sum == pytest.approx(smooth[j] / least, abs=1e-9)


def test_search_finds_where_ions_rise_together(spark):
    rng = random.Random(5)
    rows = []
    for g in range(12):
        for decoy in (False, True):
            for ion in range(6):
                for j in range(60):
                    rise = 0 if decoy else (1 + ion) * 20 * math.exp(-0.5 * ((j - 15 - 2 * g) / 2) ** 2)
                    rows.append((f"{g}{'d' if decoy else 't'}", g, decoy, j, j, ion, float(1 + ion), math.sqrt(rise + rng.random())))
    df = spark.createDataFrame(rows, "candidate string, group int, decoy boolean, scan int, at int, ion int, predicted double, intensity double")
    out = tracescore.default_search(df, 8).collect()
    assert len(out) == 12 and sum(not r.decoy for r in out) >= 11 and sum(abs(r.scan - 15 - 2 * r.group) <= 2 for r in out) >= 11
