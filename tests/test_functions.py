"""Expressions against plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from peakfold.functions import arrays as A
from peakfold.functions import chemistry as chem
from peakfold.functions import distributions as dist
from peakfold.functions import sequences as seq


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def arr(v):
    return F.array(*[F.lit(float(x)) for x in v])


def test_vectors(spark):
    a, b = [1.0, 2.0, 3.0, 4.0], [2.0, 1.0, 4.0, 3.0]
    r = one(spark, A.dot(arr(a), arr(b)), A.pearson(arr(a), arr(b)), A.spearman(arr([1, 1, 2, 3]), arr([2, 2, 1, 5])), A.variance(arr(a)), A.quantile(arr([3, 1, 2, 10]), 0.5), A.top_sum(arr(a), 2), A.cosine(arr([0, 0]), arr([1, 1])))
    assert r[0] == 28 and r[1] == pytest.approx(0.6) and r[3] == pytest.approx(1.25) and r[4] == 2.5 and r[5] == 7 and r[6] == 0
    assert -1 <= r[2] <= 1


def test_empty_arrays(spark):
    e = F.array().cast("array<double>")
    r = one(spark, A.total(e), A.mean(e), A.stdev(e), A.quantile(e, 0.5), A.top_sum(e, 3), A.cosine(e, e), A.normalize_sum(e))
    assert r[0] == 0 and r[1] == 0 and r[2] == 0 and r[3] is None and r[4] == 0 and r[5] == 0 and r[6] == []


def test_peaks(spark):
    p = A.peaks(arr([100, 200, 300, 300.0005]), arr([9, -4, 16, 1]))
    r = one(spark, A.sqrt_intensity(p), A.top_peaks(p, 2), A.intensity_near(p, F.lit(300.0), 5), A.max_intensity_near(p, F.lit(50.0), 5), A.trim(p, 150, 250), A.base_peak_filter(p, 0.5))
    assert [x["intensity"] for x in r[0]] == [3, 0, 4, 1] and [x["mz"] for x in r[1]] == [100, 300] and r[2] == 17 and r[3] == 0
    assert [x["mz"] for x in r[4]] == [200] and [x["mz"] for x in r[5]] == [100, 300]


def test_logs_and_tolerances(spark):
    r = one(spark, A.protected_log(F.lit(-1.0)), A.log10_factorial(F.lit(25)), A.within_ppm(F.lit(1000.0), F.lit(1000.009), 10), A.delta_ppm(F.lit(1000.01), F.lit(1000.0)), A.interpolate(F.lit(1.5), F.lit(1.0), F.lit(2.0), F.lit(2.0), F.lit(4.0)))
    assert r[0] == 0 and r[1] == pytest.approx(math.log10(math.factorial(25))) and r[2] and r[3] == pytest.approx(10) and r[4] == 3


def test_distributions(spark):
    x = F.lit(1.3)
    r = one(spark, dist.gaussian_sf(x), dist.gaussian_cdf(F.lit(-1.3)), dist.laplace_cdf(x), dist.cauchy_cdf(x), dist.gumbel_cdf(x), dist.gamma_pdf(x, 2.0), dist.cosine_gaussian_cdf(F.lit(5.0)), dist.uniform_cdf(F.lit(0.25)))
    assert r[0] == pytest.approx(0.0968004846, abs=1e-6) and r[1] == pytest.approx(r[0], abs=1e-6)
    assert r[2] == pytest.approx(1 - 0.5 * math.exp(-1.3)) and r[3] == pytest.approx(math.atan(1.3) / math.pi + 0.5) and r[4] == pytest.approx(math.exp(-math.exp(-1.3)))
    assert r[5] == pytest.approx(1.3 * math.exp(-1.3)) and r[6] == 1 and r[7] == 0.25
    assert dist.binomial_tail(10, 0.5, -1) == 1 and dist.binomial_tail(10, 0.5, 10) == 0
    assert dist.binomial_tail(10, 0.3, 4) == pytest.approx(sum(math.comb(10, k) * 0.3**k * 0.7 ** (10 - k) for k in range(5, 11)))


def test_sequences(spark):
    m = F.lit("[+42.01]PEC[+57.02]TIDEK")
    r = one(spark, seq.tokens(m), seq.strip_modifications(m), seq.count_modifications(m), seq.modification_positions(m), seq.modification_mass(m), seq.reverse_inside(F.lit("PEC[+57.02]TK")), seq.expected_charge(F.lit("PEKHR")))
    assert r[0] == ["[+42.01]P", "E", "C[+57.02]", "T", "I", "D", "E", "K"] and r[1] == "PECTIDEK" and r[2] == 2 and r[3] == [0, 2] and r[4] == pytest.approx(99.03)
    assert r[5] == "PTC[+57.02]EK" and r[6] == 4
    r = one(spark, seq.mismatches(F.lit("PEPTIDE"), F.lit("PEPTLNK")), seq.mismatches(F.lit("AB"), F.lit("ABC")), seq.common_prefix(F.lit("abcd"), F.lit("abxd")), seq.accessions(F.lit("b;a;;b")))
    assert r[0] == 0 and r[1] is None and r[2] == "ab" and r[3] == ["a", "b"]
    rows = spark.createDataFrame([("f10",), ("f9",), ("f1b2",), ("f1b10",)], "n string").orderBy(seq.natural_key(F.col("n"))).collect()
    assert [x.n for x in rows] == ["f1b2", "f1b10", "f9", "f10"]


def test_psm_id(spark):
    i = seq.psm_id(F.lit("C:\\x:run"), F.lit(12.5), F.lit("PEP[+1]K"), F.lit(2), F.lit(True))
    r = one(spark, seq.parse_psm_id(i))[0]
    assert (r.source, r.rt, r.decoy, r.sequence, r.charge) == ("C:\\x:run", 12.5, True, "PEP[+1]K", 2)


def test_lcg(spark):
    def c_rand(x):
        x = (x * 1103515245 + 12345 + (1 << 31)) % (1 << 32) - (1 << 31)
        return int(math.fmod(x, 2147483647))

    rows = spark.createDataFrame([(v,) for v in (1, 42, -7, 2147483647, -2147483648)], "s int").select("s", seq.lcg(F.col("s")).alias("r"), seq.unit_interval(seq.lcg(F.col("s"))).alias("u")).collect()
    assert all(r.r == c_rand(r.s) and 0 <= r.u <= 1 for r in rows)


def test_chemistry(spark):
    r = one(spark, chem.sequence_mass(F.lit("PEPTIDE")), chem.missed_cleavages(F.lit("AKRPK")), chem.pieces(F.lit("AKRPKM")), chem.missed_cleavages(F.lit("")), chem.b_ions(chem.residue_masses(F.lit("PEP"))), chem.y_ions(chem.residue_masses(F.lit("PEP"))))
    assert r[0] == pytest.approx(799.359967, abs=1e-3) and r[1] == 1 and r[2] == ["AK", "RPK", "M"] and r[3] == 0
    assert r[4] == pytest.approx([98.060, 227.103], abs=1e-2) and r[5] == pytest.approx([116.071, 245.113], abs=1e-2)
    assert all(a < b for a, b in chem.windows(400, 1000, 12)) and len(chem.windows(400, 1000, 12, overlap=True)) > 50


def test_enzymes_cut_where_they_should(spark):
    r = one(spark, chem.pieces(F.lit("MADEKFP"), "asp-n"), chem.pieces(F.lit("MADEKFP"), "lys-n"), chem.pieces(F.lit("MADEKFP"), "none"), chem.pieces(F.lit("MAD"), "nonspecific"), chem.pieces(F.lit("AFPFA"), "chymotrypsin"))
    assert r[0] == ["MA", "D", "EKFP"] and r[1] == ["MADE", "KFP"] and r[2] == ["MADEKFP"] and r[3] == ["M", "A", "D"] and r[4] == ["AFPF", "A"]
