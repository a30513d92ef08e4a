"""The default search against loops over its own scores, and its feature vector."""

import math
import random

import pytest
from pyspark.sql import functions as F

from peakfold.operators import features, kernels, tracescore

WIDTH = 4


@pytest.fixture(scope="module")
def matches(spark):
    """Twelve candidates of six groups, five ions, sixty scans, one or two peaks each."""
    rng = random.Random(7)
    rows = []
    for c in range(12):
        tops = [(rng.randint(8, 52), rng.uniform(50, 400)) for _ in range(rng.randint(1, 2))]
        for i in range(5):
            for at in range(60):
                y = sum(h * (i + 1) * math.exp(-(((at - t) / 1.5) ** 2)) for t, h in tops) * (1 if c % 2 == 0 or i < 2 else 0.1) + (rng.random() * 3 if rng.random() < 0.5 else 0)
                rows.append((c, c // 2, c % 2 == 1, at, at, at * 0.5, i, "by"[i % 2], i + 1, float(i + 1), math.sqrt(y), rng.uniform(-5, 5), 1000.0, sum(h * math.exp(-(((at - t) / 1.5) ** 2)) for t, h in tops)))
    names = "candidate int, group int, decoy boolean, scan int, at int, rt double, ion int, ion_type string, ion_index int, predicted double, intensity double, delta double, tic double, precursor double"
    return spark.createDataFrame(rows, names).repartition(3).cache()


def separate(scores, k, zone):
    """scores: {at: score}; the k best, each further than zone from better ones."""
    taken = []
    for at in sorted(scores, key=lambda a: (-scores[a], a)):
        if len(taken) < k and all(abs(at - b) > zone for b in taken):
            taken.append(at)
    return taken


def test_default_search_against_loops(spark, matches):
    scores = {}
    for r in tracescore.scan_scores(matches, WIDTH).collect():
        scores.setdefault(r["candidate"], {})[r["at"]] = r["score"]
    best = {}
    for c, s in scores.items():
        live = {a: v for a, v in s.items() if v > 0}
        # Zones count scans with a score.
        place = {a: i for i, a in enumerate(sorted(live))}
        picked = separate({place[a]: v for a, v in live.items()}, 5, WIDTH)
        back = {i: a for a, i in place.items()}
        best.setdefault(c // 2, []).extend((live[back[i]], -c, -back[i]) for i in picked)
    got = {r["group"]: r for r in tracescore.default_search(matches, WIDTH).collect()}
    assert got.keys() == best.keys()
    for g, rows in best.items():
        rows.sort(reverse=True)
        top = rows[0]
        assert (got[g]["score"], got[g]["candidate"], got[g]["scan"]) == (pytest.approx(top[0]), -top[1], -top[2])
        assert got[g]["margin"] == pytest.approx(top[0] - (rows[1][0] if len(rows) > 1 else 0))


def test_feature_vectors(spark, matches):
    scans = matches.where("ion = 0").select("candidate", "scan", F.lit(0.25).alias("xcorr_lib"), F.lit(0.5).alias("xcorr_model"), F.lit(0.9).alias("isotope_dot"), F.lit(1.5).alias("parent_delta")).where("candidate <> 3")
    out = tracescore.feature_search(matches, scans, WIDTH, 4.0)
    assert tuple(out.columns[5:]) == tracescore.FEATURES and len(tracescore.FEATURES) == 18
    rows = out.collect()
    scores = {}
    for r in tracescore.scan_scores(matches, WIDTH).collect():
        scores.setdefault(r["candidate"], {})[r["at"]] = r["score"]
    by = {}
    for r in rows:
        by.setdefault(r["candidate"], []).append(r)
        assert r["primary"] == pytest.approx(scores[r["candidate"]][r["scan"]]) and r["scan"] in separate(scores[r["candidate"]], 3, 2 * WIDTH)
        assert r["n_matched"] <= 5 and -1 <= r["correlation_to_gaussian"] <= 1
        want = (10.0, 0.0) if r["candidate"] == 3 else (1.5, 0.25)
        assert (r["parent_delta"], r["xcorr_lib"]) == want
    assert by.keys() == set(range(12))
    for c, own in by.items():
        enough = [r["n_good_correlation"] >= 3 for r in own]
        assert all(enough) or (len(own) == 1 and own[0]["rank"] == 1)
        if c % 2 == 0:
            top = min(own, key=lambda r: r["rank"])
            assert top["is_integrated_signal"] == 1 and top["is_integrated_precursor"] == 1 and top["correlation_to_precursor"] > 0.5 and top["n_good_correlation"] >= 3


def test_xcorr_pair(spark):
    peaks = [(150.1, 10.0), (275.2, 5.0), (400.3, 80.0), (512.7, 3.0)]
    library = [(150.1, 9.0), (400.3, 4.0), (700.0, 1.0)]
    row = spark.createDataFrame([(peaks, library, [150.1, 275.2]), ([], [], [])], "peaks array<struct<mz:double,intensity:double>>, library array<struct<mz:double,intensity:double>>, ions array<double>")
    a, b = features.xcorr_pair(row).collect()
    import numpy as np

    v = kernels.xcorr_vector(np.array([p[0] for p in peaks]), np.array([p[1] for p in peaks]))
    bin_of = lambda m: int(m / 1.0005079 + 0.4)
    assert a["xcorr_model"] == pytest.approx((v[bin_of(150.1)] + v[bin_of(275.2)]) * 50 / 1e4)
    high = sum(v[bin_of(m)] * math.sqrt(y / 9.0) for m, y in library if bin_of(m) < len(v))
    assert a["xcorr_lib"] == pytest.approx(high * 50 / 1e4) and (b["xcorr_lib"], b["xcorr_model"]) == (0.0, 0.0)


def test_rounding_is_no_error_of_the_fit(spark):
    """Six equal ions: their unit lengths differ by rounding only, which is a perfect fit and scores 0."""
    rows = [(1, "b", 3, 48.0, 68301.45, 0.5, 1e5)] * 6
    ions = spark.createDataFrame(rows, "k int, ion_type string, ion_index int, predicted double, intensity double, delta double, tic double")
    assert tracescore.match_features(ions, ["k"]).first().fit_score == 0
