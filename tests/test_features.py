"""Features, plug-ins and generators on inputs whose answers are known."""

import pytest
from pyspark.sql import functions as F

from peakfold.operators import features as f
from peakfold.operators import generators as gen


def test_scorers(spark):
    df = spark.createDataFrame([(3, 100.0, 6, 3.0, 9.0, 5.0, 10.0), (0, 0.0, 0, 0.0, 0.0, 0.0, 0.0)], "matches long, dot double, n_ions long, ppm_sum double, ppm_abs_sum double, matched_intensity double, tic double").where("matches > 0")
    r = f.score(df, list(f.SCORERS)).first()
    assert r.match_share == 0.5 and r.mean_ppm == 1 and r.mean_abs_ppm == 3 and r.tic_share == 0.5 and r.xtandem == pytest.approx(2 + 0.7781512503)
    f.register(f.Scorer("twice", lambda: F.col("dot") * 2, -1.0))
    assert f.score(df, ["twice"]).first().twice == 200


def test_columns(spark):
    r = f.peptide_columns(spark.createDataFrame([("AK[+42]RPEK", 3)], "s string, z int"), "s", "z").first()
    assert (r.missed, r.pep_length, r.charge3, r.charge2, r.flanked) == (1, 6, 1, 0, "-.AK[+42]RPEK.-")
    r = f.precursor_columns(spark.createDataFrame([([0.0, 3.0, 2.0, 1.0], [3.0, 2.0, 1.0])], "p array<double>, e array<double>"), "p", "e").first()
    assert r.isotope_dot == pytest.approx(1) and r.blank_ratio == 0 and r.isotope_matches == 3
    r = f.isotope_columns(spark.createDataFrame([("PEPTIDE",)], "s string"), "s").first()
    assert sum(r.isotopes) == pytest.approx(1) and r.isotopes[0] > r.isotopes[1] > r.isotopes[2]
    p = spark.createDataFrame([([(200.1, 5.0), (300.2, 7.0)], [200.1, 300.2]), ([(200.1, 5.0), (300.2, 7.0)], [231.0, 350.0])], "peaks array<struct<mz:double,intensity:double>>, ions array<double>")
    x = [r.xcorr for r in f.xcorr_scores(p).collect()]
    assert x[0] > x[1]


def test_z_scores(spark):
    from peakfold.operators.aggregates import background

    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 5.0)], "k int, s double")
    assert sorted(r.z for r in f.z_scores(df, background(df, ["k"], "s"), ["k"], "s").collect()) == [-1, 0, 1]


def test_modifications(spark):
    s = spark.createDataFrame([("PEPS[+79.966]K",), ("PEPSC[+57.02]K",)], "s string")
    assert [r[0] for r in s.select(f.has_modification(F.col("s"), "STY")).collect()] == [True, False]
    assert [r[0] for r in s.select(f.has_modification(F.col("s"), "STY", "79.9")).collect()] == [True, False]
    assert f.parse_mass_map("C=57.02, n=42.01,C=1") == {"C": 58.02, "n": 42.01}
    with pytest.raises(ValueError):
        f.parse_mass_map("CC=1")
    assert spark.createDataFrame([("AC[+1]C",)], "s string").select(f.apply_mass_map(F.col("s"), {"C": 57.02})).first()[0] == "AC[+1]C[+57.02]"


def test_exclusions(spark):
    peaks = spark.createDataFrame([(100.0, 1.0), (100.0, 9.0), (200.0, 1.0)], "mz double, rt double")
    gone = spark.createDataFrame([(99.9, 100.1, 0.0, 5.0)], "x_low double, x_high double, x_start double, x_stop double")
    assert {(r.mz, r.rt) for r in f.exclude_ions(peaks, gone).collect()} == {(100.0, 9.0), (200.0, 1.0)}


def test_variants(spark):
    p = spark.createDataFrame([("P1", "AAAAAAKCCCCCCKDDDDDDK")], "accession string, sequence string")
    v = spark.createDataFrame([("P1", 10, "W"), ("P1", 99, "W")], "accession string, position int, residues string")
    assert {r.peptide for r in f.variant_peptides(p, v, missed=0).collect()} == {"CCWCCCK"}


def test_shuffles_and_margins(spark):
    s = spark.createDataFrame([("PEPTIDEABCK",), ("AK",), ("AAAAK",)], "s string")
    got = [r.s for r in f.shuffled(s, "s").collect()]
    assert len(got) == 1 and sorted(got[0]) == sorted("PEPTIDEABCK") and got[0][0] == "P" and got[0][-1] == "K"
    df = spark.createDataFrame([(1, "PEPTIDEK", 9.0), (1, "PEPTLDEK", 8.0), (1, "AAAAAAAK", 5.0)], "k int, seq string, s double")
    r = f.sequence_per_candidate_margin(df, ["k"], "seq", "s").collect()
    assert len(r) == 1 and r[0].margin == 4


def test_forest_and_transitions(spark):
    df = spark.range(400).select((F.col("id") % 2).cast("double").alias("y"), (F.col("id") % 2 + F.rand(1)).alias("a"), F.rand(2).alias("b"))
    _, out = f.random_forest(df, ["a", "b"], "y", trees=10)
    r = out.groupBy("y").agg(F.avg("probability").alias("p")).orderBy("y").collect()
    assert r[0].p < 0.2 and r[1].p > 0.8
    rows = [("p", m, s, v) for m, v in (("a", 10.0), ("b", 20.0), ("c", 30.0)) for s in range(6)] + [("p", "bad", s, 9.0 * (s % 2)) for s in range(6)]
    x = spark.createDataFrame(rows, "pep string, ion string, sample int, v double")
    assert {r.ion for r in f.select_transitions(x, ["pep"], "ion", "sample", "v").collect()} == {"a", "b", "c"}
    d = f.delta_time_summary(spark.createDataFrame([("k", float(i % 5), float(i)) for i in range(40)], "k string, d double, s double"), ["k"], "d", "s").first()
    assert 0 <= d.centre <= 4 and d.n == 40 and d.iqr == 2


def test_generators(spark):
    p = spark.createDataFrame([("P", "MAAAAAKBBBBBBRPCCCCCK")], "acc string, sequence string")
    got = {(r.peptide, r.start, r.missed) for r in gen.digest(p, "sequence", missed=1, least=3, most=40).collect()}
    assert ("MAAAAAK", 0, 0) in got and ("AAAAAK", 1, 0) in got and ("BBBBBBRPCCCCCK", 7, 0) in got and ("AAAAAKBBBBBBRPCCCCCK", 1, 1) in got
    assert {r.form for r in gen.modified_forms(spark.createDataFrame([("STK",)], "s string"), "s", "ST", "[+80]").collect()} == {"STK", "S[+80]TK", "ST[+80]K"}
    sites = gen.site_choices(spark.createDataFrame([("STYSK",)], "s string"), "s", "STY", 3).collect()
    assert len(sites) == 4 and all(r.sites == sorted(r.sites) for r in sites)
    with pytest.raises(ValueError):
        gen.site_choices(p, "sequence", "STY", 6)
    assert gen.polymer_series(spark, 44.026, 19.018, 100, 300).count() == 5
    assert [r.stop for r in gen.range_bins(spark, 0, 10, 4).orderBy("bin").collect()] == [2.5, 5, 7.5, 10]
    kinds = gen.with_decoys(spark.range(2000).select("id", F.lit("PEPTIDEK").alias("s")), "s", "id", extra=0.25).groupBy("kind").count().collect()
    n = {r.kind: r["count"] for r in kinds}
    assert n["target"] == n["decoy"] == 2000 and 400 < n["entrapment"] < 600
