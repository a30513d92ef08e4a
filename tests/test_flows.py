"""Flows on small invented inputs whose answers are known."""

import pytest
from pyspark.sql import functions as F

from peakfold.functions.chemistry import PROTON, RESIDUES, WATER
from peakfold.plans import flows

PEAKS = "array<struct<mz:double,intensity:double>>"


def ions(s):
    b = [sum(RESIDUES[a] for a in s[:n]) + PROTON for n in range(1, len(s))]
    y = [sum(RESIDUES[a] for a in s[-n:]) + WATER + PROTON for n in range(1, len(s))]
    return b + y


def mz(s, z=2):
    return (sum(RESIDUES[a] for a in s) + WATER + z * PROTON) / z


@pytest.fixture(scope="module")
def scans(spark):
    rows = []
    for i in range(30):
        peaks = [(100.0 + i, 1.0)]
        if 10 <= i <= 14:
            peaks += [(m, 1000.0 / (1 + abs(i - 12))) for m in ions("PEPTIDEK")]
        rows.append((i, float(i), mz("PEPTIDEK") - 5, mz("PEPTIDEK") + 5, sorted(peaks)))
    return spark.createDataFrame(rows, f"scan long, rt double, low double, high double, peaks {PEAKS}")


def test_fasta_search(spark, scans):
    proteins = spark.createDataFrame([("P1", "MAAAAAAKPEPTIDEKGGGGGGGK")], "accession string, sequence string")
    out = flows.fasta_search(scans, proteins, enzyme="trypsin/p", k=2, zone=2).orderBy("candidate", "rank").collect()
    best = [r for r in out if r.candidate == "target|PEPTIDEK"]
    assert best[0].scan == 12 and best[0].matches == 14
    assert all(r.score < best[0].score for r in out if r.candidate != "target|PEPTIDEK")


def test_spectrum_search(spark):
    s = spark.createDataFrame([(1, 500.0, [1.0, 2.0, 3.0])], "id long, precursor_mz double, vector array<double>")
    lib = spark.createDataFrame([(1, 500.001, [1.0, 2.0, 3.1]), (2, 500.002, [3.0, 2.0, 1.0]), (3, 510.0, [1.0, 2.0, 3.0])], "id long, precursor_mz double, vector array<double>")
    rows = flows.spectrum_search(s, lib).orderBy("rank").collect()
    assert [r.entry for r in rows] == [1, 2] and rows[0].delta == pytest.approx(rows[0].score - rows[1].score)


def test_rescore(spark):
    df = spark.range(4000).select("id", (F.col("id") % 2 == 1).alias("decoy"), (F.randn(1) + F.when((F.col("id") % 4 == 0), 4.0).otherwise(0.0)).alias("a"), F.randn(2).alias("b"), F.floor(F.col("id") / 2).alias("pep"))
    out = flows.rescore(df, ["a", "b"], "decoy", "id", ["pep", "decoy"], 0.05)
    r = out.agg(F.count_if("passes").alias("n"), F.count_if(F.col("passes") & (F.col("id") % 4 == 0)).alias("good")).first()
    assert 800 < r.n <= 1150 and r.good > 0.9 * r.n


def test_quant_report(spark):
    run = "file string, modseq string, seq string, charge int, intensity double"
    a = spark.createDataFrame([("f1", "AA", "AA", 2, 10.0), ("f1", "AA", "AA", 3, 10.0), ("f1", "BB", "BB", 2, 20.0)], run)
    b = spark.createDataFrame([("f2", "AA", "AA", 2, 40.0), ("f2", "BB", "BB", 2, 40.0), ("f2", "CC", "CC", 2, 99.0)], run)
    passing = spark.createDataFrame([("AA", 2), ("AA", 3), ("BB", 2), ("BB", 2)], "modseq string, charge int")
    bridge = spark.createDataFrame([("AA", "P1"), ("BB", "P1"), ("BB", "P2")], "seq string, accession string")
    pep, prot = flows.quant_report([a, b], passing, bridge, ["f1", "f2"])
    assert {r.seq: (r.f1, r.f2) for r in pep.collect()} == {"AA": (30.0, 30.0), "BB": (30.0, 30.0)}
    assert {r.accession: (r.f1, r.f2) for r in prot.collect()} == {"P1": (30.0, 30.0)}


def test_integrate_and_refine(spark):
    pts = [("p", t, float(i), v * (0.0 if i < 5 or i > 15 else 10.0 - abs(i - 10))) for t, v in (("a", 1.0), ("b", 2.0)) for i in range(21)] + [("p", "bad", float(i), float((i * 7) % 5)) for i in range(21)]
    df = spark.createDataFrame(pts, "pep string, ion string, rt double, intensity double")
    area = {r.ion: r.area for r in flows.integrate(df.where("ion <> 'bad'"), ["pep", "ion"]).collect()}
    assert area["b"] == pytest.approx(2 * area["a"], rel=1e-6) and area["a"] > 50
    tiers = {r.ion: r.quantitative for r in flows.refine_transitions(df, ["pep"], "ion").collect()}
    assert tiers["a"] and tiers["b"] and not tiers["bad"]


def test_localize(spark):
    peptides = spark.createDataFrame([(1, "PEPSAATK")], "candidate long, sequence string")
    site = 3
    s = "PEPSAATK"
    peaks = [sum(RESIDUES[a] for a in s[:n]) + PROTON + (79.966331 if n > site else 0) for n in range(1, 8)]
    ev = spark.createDataFrame([(1, m, 0.001) for m in peaks], "candidate long, mz double, frequency double")
    r = flows.localize(peptides, ev, "ST", 1).collect()
    assert [x.form for x in r] == ["3"] and r[0].fdr < 0.01


def test_protein_groups(spark):
    bridge = spark.createDataFrame([("a", "P1"), ("b", "P1"), ("b", "P2"), ("c", "P3"), ("c", "P4"), ("d", "DECOY_P5")], "seq string, accession string")
    scores = spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.001), ("d", 0.5)], "seq string, pep double")
    g = flows.protein_groups(bridge, scores)
    assert {r.members for r in g.collect()} == {"P1", "P3;P4", "DECOY_P5"}
    assert {r.members: r.q for r in flows.protein_q_values(g).collect()} == {"P3;P4": 0.0, "P1": 0.0, "DECOY_P5": 0.5}


def test_protein_groups_of_a_long_path(spark):
    """100 proteins, each sharing a peptide with the next, are one component."""
    pairs = [(f"s{i:03d}", f"P{j:03d}") for i in range(99) for j in (i, i + 1)]
    bridge = spark.createDataFrame(pairs, "seq string, accession string")
    scores = spark.createDataFrame([(f"s{i:03d}", 0.01) for i in range(99)], "seq string, pep double")
    g = flows.protein_groups(bridge, scores).collect()
    assert {r.component for r in g} == {"P000"} and sum(r.n_items for r in g) == 99
    # By ties the last protein with two peptides claims both: 98, 96, ..., 2, and what is left goes to the end.
    assert sorted(r.members for r in g) == sorted([f"P{i:03d}" for i in range(2, 99, 2)] + ["P001"])


def test_library_upkeep(spark):
    lib = spark.createDataFrame([("s1", 500.0, 2, "PEPTIDEK", "PEPTIDEK", 1.0, [(m, 1.0) for m in sorted(ions("PEPTIDEK"))]), ("s2", 500.0, 2, "PEPTIDEK", "PEPTIDEK", 3.0, [(1.0, 1.0)]), ("s1", 400.0, 2, "NOTHEREK", "NOTHEREK", 1.0, [(1.0, 1.0)])], f"source string, precursor_mz double, charge int, modseq string, seq string, score double, peaks {PEAKS}")
    proteins = spark.createDataFrame([("P1", "MKPEPTIDEKAA"), ("P2", "GGPEPTIDEK")], "accession string, sequence string")
    c = flows.clean_library(lib, proteins).collect()
    assert [(r.source, r.accessions) for r in c] == [("s2", "P1;P2")]
    cov = {r.accession: (r.pieces, r.unique_pieces, round(r.coverage, 3)) for r in flows.coverage(lib, proteins).collect()}
    assert cov == {"P1": (1, 0, round(8 / 12, 3)), "P2": (1, 0, 0.8)}
    m = flows.modify_library(lib.where("source = 's2'"), "T", 79.97)
    assert {(r.modseq, r.precursor_mz) for r in m.collect()} == {("PEPTIDEK", 500.0), ("PEPT[+79.97]IDEK", 500 + 79.97 / 2)}
    d = flows.decoy_library(lib.where("seq = 'PEPTIDEK' and source = 's1'"))
    assert {(r.modseq, r.decoy) for r in d.collect()} == {("PEPTIDEK", False), ("PEDITPEK", True)}
    t = flows.consensus_times([spark.createDataFrame([(str(i), float(i)) for i in range(9)], "k string, rt double"), spark.createDataFrame([(str(i), 10 + 2.0 * i) for i in range(5)], "k string, rt double")], ["k"], "rt")
    assert all(r.rt == pytest.approx(float(r.k)) for r in t.collect())
    e = flows.encode_sequences(spark.createDataFrame([("AC[+57]DX",)], "s string"), "s", 6).first()
    assert e.codes == [1, 2, 3, 0, 0, 0]
    assert flows.bootstrap_targets(lib, "modseq", 1).count() == 2
