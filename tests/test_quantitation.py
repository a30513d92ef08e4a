"""Quantification against plain loops."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakfold.operators import quantitation as q

WIDTH = 5.0


def plain_range(x, y, width=WIDTH, least=3, near=None):
    n = len(y)

    def around(apex):
        diffs = [b - a for a, b in zip(x, x[1:])]
        limit = max(0.2 * width, 2.1 * statistics.median(diffs) if diffs else 0)
        ends = []
        for step in (-1, 1):
            low, i, end = apex, apex + step, None
            while 0 <= i < n:
                if y[i] < y[low]:
                    low = i
                if abs(x[i] - x[low]) > limit and 2 * y[low] < y[apex]:
                    end = low
                    break
                if y[i] < 0.01 * y[apex]:
                    end = i + step
                    break
                i += step
            ends.append(min(max(low if end is None else end, 0), n - 1))
        a, z = ends
        stopped = True
        while z - a < least - 1:
            left, right = (y[a - 1] if a else -1), (y[z + 1] if z < n - 1 else -1)
            if left == right == -1:
                break
            if left > right:
                a, stopped = a - 1, False
            elif left < right:
                z += 1
            elif stopped:
                a, stopped = a - 1, False
            else:
                z, stopped = z + 1, True
        return a, z, apex

    middle = (n - 1) // 2
    top = max(y)
    out = around(middle if y[middle] == top else y.index(top))
    if near is not None and not x[out[0]] <= near <= x[out[1]]:
        out = around(min([i for i in range(n) if x[i] >= near] or [n - 1]))
    return out


def shares(traces, a, z):
    out = []
    for v in traces:
        s = sum(v[a : z + 1])
        out.append([k / s if s else 0.0 for k in v])
    return out


def medians(traces):
    return [round(statistics.median(c), 12) for c in zip(*traces)]


def local(x, traces, near):
    a, z, _ = plain_range(x, medians(shares(traces, 0, len(x))), near=near)
    n = shares(traces, a, z)
    m = medians(n)
    a, z, _ = plain_range(x, m)
    return n, m, a, z


def pearson(a, b):
    ma, mb = statistics.fmean(a), statistics.fmean(b)
    va, vb = sum((k - ma) ** 2 for k in a), sum((k - mb) ** 2 for k in b)
    return min(1.0, sum((i - ma) * (j - mb) for i, j in zip(a, b)) / (va * vb) ** 0.5) if va > 1e-12 * sum(k * k for k in a) and vb > 1e-12 * sum(k * k for k in b) else 0.0


def areas(x, v, a, z):
    base = min(v[a], v[z])
    area = sum((x[i] - x[i - 1]) * (v[i] + v[i - 1]) / 2 for i in range(a + 1, z + 1))
    under = sum((x[i] - x[i - 1]) * (min(base, v[i]) + min(base, v[i - 1])) / 2 for i in range(a + 1, z + 1))
    return area, under


def plain_refine(x, traces, near=None, most=5, fewest=3):
    n, m, a, z = local(x, traces, near)
    r = [pearson(k[a : z + 1], m[a : z + 1]) for k in n]
    order = sorted(range(len(r)), key=lambda i: (-round(r[i], 9), i))
    taken = [i for p, i in enumerate(order) if p < most and (round(r[i], 9) >= 0.5 or p < fewest)]
    least = min(round(r[i], 9) for i in taken)
    chosen = [i for i in range(len(r)) if round(r[i], 9) >= least]
    _, _, s, e = local(x, [traces[i] for i in chosen], near)
    return [(r[i], round(r[i], 9) >= 0.9, *areas(x, traces[i], a, z), i in chosen) for i in range(len(r))], x[s], x[e]


def peaks(rng, n, ions):
    """Traces of one peak and noise, on an uneven grid."""
    x = sorted(rng.sample(range(10 * n), n))
    x = [k / 4 for k in x]
    at = rng.uniform(x[0], x[-1])
    out = []
    for k in range(ions):
        tall, noise = rng.choice([0, 5, 100, 1000]), rng.choice([0, 1, 20])
        out.append([round(tall * max(0.0, 1 - abs(t - at) / (3 + k % 2)) + (rng.random() * noise if rng.random() < 0.6 else 0), 3) for t in x])
    return x, out


@pytest.fixture(scope="module")
def candidates():
    rng = random.Random(4)
    out = {f"c{k}": (*peaks(rng, rng.choice([1, 2, 3, 8, 30]), rng.choice([1, 2, 4, 9])), rng.choice([None, None, 1.0, 20.0, 1e6])) for k in range(60)}
    out["flat"] = ([1.0, 2.0, 3.0, 4.0], [[0.0] * 4, [0.0] * 4], None)
    out["even"] = ([1.0, 2.0, 3.0, 4.0, 5.0], [[7.0] * 5, [7.0] * 5, [7.0] * 5], 4.0)
    return out


def test_peak_range(spark, candidates):
    rows = [(f"{c}-{i}", t, v, near) for c, (x, traces, near) in candidates.items() for i, y in enumerate(traces) for t, v in zip(x, y)]
    df = spark.createDataFrame(rows, "k string, x double, y double, near double").repartition(5)
    for near in (None, "near"):
        got = {r["k"]: (r["start"], r["stop"], r["apex"], r["points"]) for r in q.peak_ranges(df, ["k"], "x", "y", WIDTH, near=near).collect()}
        for c, (x, traces, hint) in candidates.items():
            for i, y in enumerate(traces):
                a, z, apex = plain_range(x, y, near=hint if near else None)
                assert got.pop(f"{c}-{i}") == (x[a], x[z], x[apex], z - a + 1)
        assert not got


def test_transitions_are_refined(spark, candidates):
    rows = [(c, i, t, v, near) for c, (x, traces, near) in candidates.items() for i, y in enumerate(traces) for t, v in zip(x, y)]
    df = spark.createDataFrame(rows, "k string, ion int, x double, y double, near double").repartition(3)
    got = {}
    for r in q.refine_transitions(df, ["k"], "ion", "x", "y", WIDTH, near="near").collect():
        got.setdefault(r["k"], {})[r["ion"]] = r
    assert got.keys() == candidates.keys()
    for c, (x, traces, near) in candidates.items():
        want, start, stop = plain_refine(x, traces, near)
        for i, (r, good, area, under, chosen) in enumerate(want):
            g = got[c][i]
            assert (g["correlation"], g["area"], g["background"], g["net"]) == pytest.approx((r, area, under, area - under), abs=1e-6)
            assert (g["quantitative"], g["selected"], g["start"], g["stop"]) == (good, chosen, start, stop)


def test_refining_shuffles_once(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 2.0)], "k string, ion int, x double, y double")
    plan = q.refine_transitions(df, ["k"], "ion", "x", "y", WIDTH)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_quantities(spark):
    rows = [("a", "y1", 0.95, True, 5.0, True), ("a", "y2", 0.99, True, -2.0, True), ("a", "y3", 0.6, False, 9.0, True), ("b", "y1", 0.6, False, 3.0, True), ("b", "y2", 0.1, False, 8.0, False)]
    df = spark.createDataFrame([(*r, 1.0, 2.0) for r in rows], "k string, ion string, correlation double, quantitative boolean, net double, selected boolean, start double, stop double")
    got = {r["k"]: (r["intensity"], r["n_ions"], r["ions"]) for r in q.quantified(df, ["k"], "ion").collect()}
    assert got == {"a": (5.0, 2, "y2,y1"), "b": (3.0, 1, "y1")}


def plain_precursors(x, traces, shares_, low, high):
    """traces: {(charge, isotope): values}, isotopes from 0."""
    def smooth(v):
        c = (-21, 14, 39, 54, 59, 54, 39, 14, -21)
        return v if len(v) < 9 else [max(0.0, sum(c[k + 4] * v[i + k] for k in range(-4, 5) if 0 <= i + k < len(v)) / 231) for i in range(len(v))]

    pure = {}
    for (z, i), v in traces.items():
        out = []
        for p in range(len(x)):
            scale = [traces[z, j][p] / s for j, s in shares_.items() if s > 0.5 and (z, j) in traces]
            out.append(min(v[p], min(scale) * shares_.get(i, 0.0)) if scale else v[p])
        pure[z, i] = smooth(out)
    some = any(k > 0 for v in pure.values() for k in v)
    use = pure if some else {k: v for k, v in traces.items() if k[1] <= 1}
    m = medians([[k / max(v) if max(v) > 0 else 0.0 for k in v] for v in use.values()])
    a, z, _ = plain_range(x, m)
    start, stop = min([x[a]] + ([low] if low is not None else [])), max([x[z]] + ([high] if high is not None else []))
    at = [p for p in range(len(x)) if start <= x[p] <= stop]
    return {k: (pearson([v[p] for p in at], [m[p] for p in at]), *areas(x, v, at[0], at[-1]), some, start, stop) for k, v in use.items()}


def test_precursors(spark):
    rng = random.Random(8)
    made, rows, dist = {}, [], []
    for k in range(40):
        x, base = peaks(rng, rng.choice([3, 12, 30]), 1)
        given = {0: 1.0, 1: rng.uniform(0.2, 1), 2: rng.uniform(0.1, 0.6)} if k % 7 else {}
        low, high = rng.choice([(None, None), (x[0] + 1, x[0] + 4)])
        traces = {(z, i): [round(v * given.get(i, 0.5) * z + (rng.random() * 3 if k % 5 else 0), 3) for v in base[0]] for z in (2, 3) for i in (0, 1, 2)}
        if k % 9 == 1:
            traces = {t: v if t[1] else [0.0] * len(x) for t, v in traces.items()}  # no first isotope: nothing is the candidate's
        made[f"p{k}"] = (x, traces, given, low, high)
        rows += [(f"p{k}", z, i, t, v, low, high) for (z, i), y in traces.items() for t, v in zip(x, y)] + [(f"p{k}", 2, -1, t, 5.0, low, high) for t in x]
        dist += [(f"p{k}", i, s) for i, s in given.items()]
    df = spark.createDataFrame(rows, "k string, charge int, isotope int, x double, y double, low double, high double").repartition(3)
    expected = spark.createDataFrame(dist, "k string, isotope int, share double")
    got = {}
    for r in q.integrate_precursors(df, expected, ["k"], "charge", "isotope", "x", "y", WIDTH, "low", "high").collect():
        got.setdefault(r["k"], {})[r["charge"], r["isotope"]] = r
    for k, case in made.items():
        want = plain_precursors(*case)
        assert got[k].keys() == want.keys()
        for t, (r, area, under, some, start, stop) in want.items():
            g = got[k][t]
            assert (g["correlation"], g["area"], g["background"]) == pytest.approx((r, area, under), abs=1e-6), (k, t)
            assert (g["capped"], g["start"], g["stop"], g["quantitative"]) == (some, start, stop, round(r, 9) > 0.9)
    assert q.refine_transitions(df.where("1 = 0"), ["k"], "isotope", "x", "y").count() == 0


def test_splines_against_a_dense_solve():
    rng = np.random.default_rng(3)
    for n in (2, 3, 4, 17):
        x, y = np.sort(rng.random(n) * 10), rng.random(n)
        a, b = np.zeros((n, n)), np.zeros(n)
        a[0, 0] = a[-1, -1] = 1
        for i in range(1, n - 1):
            h, k = x[i] - x[i - 1], x[i + 1] - x[i]
            a[i, i - 1 : i + 2] = h, 2 * (h + k), k
            b[i] = 6 * ((y[i + 1] - y[i]) / k - (y[i] - y[i - 1]) / h)
        m = q.natural_spline(x, y)
        assert np.allclose(m, np.linalg.solve(a, b))
        assert np.allclose(q.spline_at(x, y, m, x), y) and q.spline_at(x, y, m, np.array([x[0] - 1, x[-1] + 1])).tolist() == [0, 0]
        # Between knots the second derivative is linear.
        for i in range(n - 1):
            t = np.linspace(x[i], x[i + 1], 5)
            cubic = np.polyfit(t, q.spline_at(x, y + 100, m, t), 3)
            assert np.allclose(np.polyval(np.polyder(cubic, 2), [x[i], x[i + 1]]), m[i : i + 2], atol=1e-4 * (1 + abs(m).max()))


def test_apex_times(spark):
    x = [float(k) for k in range(21)]
    bell = lambda c: [round(100 * math.exp(-(((t - c) / 2) ** 2)), 6) for t in x]
    made = {"a": bell(9.3), "b": bell(11.8), "none": [0.0] * 21, "edge": bell(0.0)}
    df = spark.createDataFrame([(k, t, y) for k, v in made.items() for t, y in zip(x, v)] + [("one", 4.0, 7.0), ("twice", 1.0, 2.0), ("twice", 1.0, 5.0)], "k string, x double, y double")
    got = {r["k"]: r for r in q.apex_times(df, ["k"], "x", "y", 5.0).collect()}
    for k, c in (("a", 9.3), ("b", 11.8)):
        assert abs(got[k]["apex"] - c) < 0.15 and got[k]["height"] == pytest.approx(100, rel=0.02) and got[k]["start"] < c < got[k]["stop"]
    assert got["none"]["apex"] is None and got["edge"]["apex"] < 0.5 and (got["one"]["apex"], got["one"]["height"]) == (4.0, 7.0) and got["twice"]["height"] == 5.0
    s = df.where("k = 'a'").withColumns({"low": F.lit(2.0), "high": F.lit(18.0)})
    r = q.resampled(s, ["k"], "x", "y", 50, "low", "high").orderBy("place").collect()
    assert len(r) == 50 and max(r, key=lambda p: p["value"])["x"] == pytest.approx(9.3, abs=0.3) and all(abs(p["value"] - 100 * math.exp(-(((p["x"] - 9.3) / 2) ** 2))) < 1 for p in r)


def test_shapes_of_a_peak(spark):
    """One clean peak with its precursor, one of noise, one without signal."""
    x = [float(k) for k in range(25)]
    rng = random.Random(1)
    bell = [math.exp(-(((t - 12) / 2) ** 2)) for t in x]
    rows = [("peak", i, t, 10 * (i + 1) * b, 5 * b, 12.0) for i in range(4) for t, b in zip(x, bell)]
    rows += [("noise", i, t, rng.random() * 10, rng.random(), 12.0) for i in range(4) for t in x] + [("none", 0, t, 0.0, 1.0, 12.0) for t in x]
    got = {r["k"]: r for r in q.shape_features(spark.createDataFrame(rows, "k string, ion int, x double, y double, p double, c double"), ["k"], "ion", "x", "y", "p", "c", 6.0).collect()}
    p = got["peak"]
    assert (p["n_good"], p["is_integrated_signal"], p["is_integrated_precursor"]) == (4, 1, 1) and p["correlation_to_gaussian"] > 0.8 and p["correlation_to_precursor"] > 0.95 and p["start"] < 12 < p["stop"]
    assert got["noise"]["correlation_to_gaussian"] < 0.8 and tuple(got["none"])[1:6] == (0, 0, 0, 0.0, 0.0)
