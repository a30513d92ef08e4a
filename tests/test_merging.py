"""Merged spectra, combined peaks and report files."""

import random

import pytest

from peakfold.operators import merging
from peakfold.sources import sinks


def near(a, b, ppm):
    return abs(a - b) <= max(a, b) * ppm * 1e-6


def plain_merge(rows, ppm):
    """rows: (rt, spectrum, mz, intensity); masses as first seen."""
    held = []
    for _, _, m, y in sorted(rows):
        ok = [h for h in held if near(h[0], m, ppm)]
        if ok:
            min(ok, key=lambda h: (abs(h[0] - m), h[0]))[1] += y
        else:
            held.append([m, y])
    return sorted((m, round(y, 6)) for m, y in held)


@pytest.mark.parametrize("ppm", [10.0, 3000.0])
def test_spectra_are_merged(spark, ppm):
    rng = random.Random(1)
    rows = [(k, s, 100.0 - s, round(rng.uniform(100, 110), 3), round(rng.random(), 3)) for k, n in ((1, 3), (2, 50), (3, 51), (4, 1)) for s in range(n) for _ in range(rng.randint(1, 12))]
    df = spark.createDataFrame([*rows, (5, 1, None, 1.0, 1.0), (5, 2, 1.0, None, 1.0)], "k int, s int, rt double, mz double, y double").repartition(3)
    got = {}
    for r in merging.merged_spectra(df, ["k"], "s", "rt", "mz", "y", ppm).collect():
        got.setdefault(r["k"], []).append(r)
    assert got.keys() == {1, 2, 3, 4}
    for k, n in ((1, 3), (2, 50), (3, 51), (4, 1)):
        own = [r for r in rows if r[0] == k]
        assert {r["n_spectra"] for r in got[k]} == {n} and {round(r["rt"], 6) for r in got[k]} == {round(min(r[2] for r in own) if n > 50 else sum(100.0 - s for s in range(n)) / n, 6)}
        have = sorted((round(r["mz"], 6), round(r["intensity"], 6)) for r in got[k])
        if n <= 50:
            assert have == plain_merge([(r[2], r[1], r[3], r[4]) for r in own], ppm)
        else:
            bins = {}
            for r in own:
                b = int(r[3] / 0.1 + 0.5)
                bins[b] = bins.get(b, 0) + r[4]
            assert have == sorted((round(b * 0.1, 6), round(y, 6)) for b, y in bins.items() if y > 0)


def test_peaks_are_combined_most_intense_first(spark):
    rng = random.Random(2)
    rows = [(k, round(rng.uniform(100, 104), 3), round(rng.random() * 10, 2)) for k in range(6) for _ in range(40)]
    got = {}
    for r in merging.combined_peaks(spark.createDataFrame(rows, "k int, mz double, y double"), ["k"], "mz", "y", 2000.0).collect():
        got.setdefault(r["k"], []).append((round(r["mz"], 6), round(r["y"], 6)))
    for k in range(6):
        held = []
        for _, m, y in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2], r[1])):
            below, above = [h for h in held if h[0] < m], [h for h in held if h[0] >= m]
            ok = [h for h in ([max(below)] if below else []) + ([min(above)] if above else []) if near(h[0], m, 2000.0)]
            if ok:
                best = max(ok, key=lambda h: h[1])
                held.remove(best)
                m, y = (best[0] * best[1] + m * y) / (best[1] + y), best[1] + y
            held.append((m, y))
        assert sorted(got[k]) == sorted((round(m, 6), round(y, 6)) for m, y in held) and len(got[k]) < 40


def test_reports_of_quantities(spark, tmp_path):
    peptides = spark.createDataFrame([("A[+1]K", "AK", "p1", "r1", 10.0, 3), ("A[+1]K", "AK", "p1", "r2", 30.0, 4), ("CK", "CK", "p1;p2", "r2", 5.0, 2)], "modseq string, seq string, accessions string, run string, intensity double, n_ions int")
    proteins = spark.createDataFrame([("p1", "r1", 10.0, 1, "AK"), ("p1", "r2", 35.0, 2, "AK;CK")], "accessions string, run string, intensity double, n_peptides int, sequences string")
    sinks.write_quant_reports(peptides, proteins, str(tmp_path / "q"))
    read = lambda name, **how: [tuple(r) for r in spark.read.csv(str(tmp_path / "q" / name), **{"header": True, "sep": "\t"} | how).collect()]
    assert read("peptides") == [("A[+1]K", "p1", "4", "10.0", "30.0"), ("CK", "p1;p2", "2", "0.0", "5.0")]
    assert read("proteins") == [("p1", "2", "AK;CK", "10.0", "35.0")]
    assert read("diffacto", sep=",") == [("AK", "p1", "10.0", "30.0"), ("CK", "p1;p2", None, "5.0")]
    assert read("diffacto_samples", header=False) == [("r1", "S1"), ("r2", "S2")]
    assert read("variation") == [("A[+1]K", "2", "20.0", "10.0", "0.5"), ("CK", "1", "5.0", "0.0", "0.0")]


def test_localizations_are_written(spark, tmp_path):
    row = ("S[+80]K", "S(1)K", 12.5, 20.0, 5, 1, True, True, "b1;y2", 3.0, 9.0)
    df = spark.createDataFrame([row], "modseq string, annotation string, rt double, score double, n_ions int, n_mods int, site_specific boolean, localized boolean, ions string, localizing_intensity double, total_intensity double")
    sinks.write_localizations(df, str(tmp_path / "l"))
    got = spark.read.csv(str(tmp_path / "l"), sep="\t", header=True)
    assert got.columns[:4] == ["peptideModSeq", "localizationPeptideModSeq", "retentionTimeApexInSeconds", "localizationScore"] and got.first()["localizingIons"] == "b1;y2"
