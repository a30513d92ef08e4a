"""Densities on a rectangle, ridges, corrected errors and the empirical mixture against plain loops and planted drifts."""

import math
import random
import statistics

import numpy as np
import pytest

from peakfold.operators import alignment as al


def plain_density(points, nx, ny):
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    at = [(int((x - min(xs)) / (max(xs) - min(xs)) * (nx - 1) + 0.5) if max(xs) > min(xs) else 0, int((y - min(ys)) / (max(ys) - min(ys)) * (ny - 1) + 0.5) if max(ys) > min(ys) else 0) for x, y in points]
    n = len(points)
    dev = [min(c / 40, n ** (-1 / 6) * statistics.pstdev(v) / (2 * math.sqrt(2 * math.log(2)))) for c, v in ((nx, [a for a, _ in at]), (ny, [b for _, b in at]))]

    def bell(k, d):
        if d == 0:
            return float(k == 0)
        return math.sqrt(max(math.cos(abs(k) * math.pi / (4 * d)), 0) * math.pi / (8 * d)) if abs(k) <= 2 * d else 0.0

    out = {}
    for i, j in at:
        for a in range(-int(2 * dev[0] + 0.5), int(2 * dev[0] + 0.5) + 1):
            for b in range(-int(2 * dev[1] + 0.5), int(2 * dev[1] + 0.5) + 1):
                w = bell(a, dev[0]) * bell(b, dev[1])
                if w > 0 and 0 <= i + a < nx and 0 <= j + b < ny:
                    out[i + a, j + b] = out.get((i + a, j + b), 0) + w
    return out


def test_density_against_loops(spark):
    rng = random.Random(1)
    made = {"a": [(rng.gauss(0, 1), rng.random()) for _ in range(120)], "line": [(float(k), 3.0) for k in range(30)], "dot": [(1.0, 1.0)] * 5, "two": [(0.0, 0.0), (1.0, 2.0)]}
    df = spark.createDataFrame([(k, *p) for k, v in made.items() for p in v] + [("a", None, 1.0), ("a", 1.0, None)], "k string, x double, y double").repartition(3)
    grid, ranges = al.rectangle_density(df, ["k"], "x", "y", 200, 120)
    got = {}
    for r in grid.collect():
        got.setdefault(r["k"], {})[r["i"], r["j"]] = r["weight"]
    assert {r["k"]: r["n"] for r in ranges.collect()} == {k: len(v) for k, v in made.items()}
    for k, v in made.items():
        want = {c: w for c, w in plain_density(v, 200, 120).items() if w > 5e-9}
        assert got[k].keys() >= want.keys() and all(got[k][c] == pytest.approx(w, abs=2e-9) for c, w in want.items())


def test_the_ridge_is_walked():
    rng = np.random.default_rng(2)
    for _ in range(30):
        g = np.round(rng.random((12, 9)), 1)
        i0, j0 = next((i, j) for i in range(12) for j in range(9) if g[i, j] == g.max())
        want = {i0: j0}
        for step in (1, -1):
            i, j = i0, j0
            while 0 <= i + step < 12:
                j = 1 if j <= 0 else 7 if j >= 8 else j
                same, up, down = g[i + step, j], g[i + step, j + 1], g[i + step, j - 1]
                top = max(same, up, down)
                j += 0 if same == top or up == down else 1 if up == top else -1
                i += step
                want[i] = j
        assert al.walk_ridge(g).tolist() == [want[i] for i in range(12)]


def test_errors_lose_their_drift(spark):
    """A drift over time is taken off, outliers stay far off and are unlikely; few points get a line, one point nothing."""
    rng = random.Random(3)
    drift = lambda t: 3 * math.sin(t / 15)
    rows = [("run", i, t, drift(t) + rng.gauss(0, 0.2)) for i, t in enumerate(rng.uniform(0, 60) for _ in range(1500))]
    rows += [("run", 5000 + i, t, drift(t) + rng.choice([-1, 1]) * rng.uniform(4, 9)) for i, t in enumerate(rng.uniform(0, 60) for _ in range(60))]
    rows += [("few", k, float(k), 2.0 * k + 1) for k in range(10)] + [("one", 1, 3.0, 7.0)] + [("still", k, 4.0, 1.0 + (k % 3) / 10) for k in range(40)]
    df = spark.createDataFrame([*rows, ("run", 9, None, 1.0)], "k string, id int, t double, e double").repartition(3)
    got = {}
    for r in al.corrected_errors(df, ["k"], "t", "e", "id", 300, 200).collect():
        got.setdefault(r["k"], {})[r["id"]] = r
    assert {k: len(v) for k, v in got.items()} == {"run": 1560, "few": 10, "one": 1, "still": 40}
    own = [r["corrected"] for i, r in got["run"].items() if i < 5000]
    assert statistics.pstdev(own) < 0.6 and abs(statistics.median(own)) < 0.2
    good = statistics.median(r["probability"] for i, r in got["run"].items() if i < 5000)
    bad = statistics.median(r["probability"] for i, r in got["run"].items() if i >= 5000)
    assert good > 0.9 and bad < 0.2
    assert all(abs(r["corrected"]) < 1e-9 for r in got["few"].values()) and got["one"][1]["corrected"] == 7.0
    assert abs(statistics.fmean(r["corrected"] for r in got["still"].values())) < 1e-9  # one time only: the mean is taken off
    assert al.corrected_errors(df.where("1 = 0"), ["k"], "t", "e", "id").count() == 0


def test_empirical_mixture_tells_matches_apart(spark):
    rng = np.random.default_rng(4)
    delta = np.concatenate([rng.laplace(0.5, 0.2, 800), rng.uniform(-10, 10, 200)])
    p = al.empirical_posterior(delta)
    assert p[:800].mean() > 0.9 and p[800:][np.abs(delta[800:] - 0.5) > 3].mean() < 0.1 and ((p >= 0) & (p <= 1)).all()
    assert al.empirical_posterior(np.array([1.0])).tolist() == [1.0] and al.empirical_posterior(np.full(5, 2.0)).tolist() == [1.0] * 5
    x = np.sort(rng.uniform(0, 100, 300))
    y = 1.05 * x + rng.normal(0, 0.1, 300)
    y[::10] += rng.uniform(10, 20, 30)
    rows = [("r", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    got = al.empirical_alignment(spark.createDataFrame(rows, "k string, id int, x double, y double"), ["k"], "x", "y", "id").collect()
    near = [r["probability"] for r in got if r["id"] % 10]
    far = [r["probability"] for r in got if r["id"] % 10 == 0]
    assert len(got) == 300 and statistics.median(near) > 0.8 and statistics.median(far) < 0.3
