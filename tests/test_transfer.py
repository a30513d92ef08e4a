"""Times and peaks carried from run to run."""

import math
import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakfold.operators import kernels
from peakfold.plans import transfer


def made_runs():
    """Five runs at paces of their own; the last shares nothing with the first but much with the middle ones."""
    rng = random.Random(3)
    true = {f"s{k:03d}": 5 + k * 0.4 for k in range(150)}
    pace = {"r1": lambda t: t, "r2": lambda t: 1.1 * t + 2, "r3": lambda t: 0.9 * t - 1, "r4": lambda t: 1.2 * t + 5, "r5": lambda t: 0.8 * t + 9}
    span = {"r1": (0, 90), "r2": (20, 100), "r3": (50, 120), "r4": (80, 150), "r5": (95, 150)}
    rows = [(r, s, pace[r](t) + rng.uniform(-0.02, 0.02)) for r, (a, z) in span.items() for s, t in list(true.items())[a:z]]
    return true, pace, rows


def test_tree_and_counts(spark):
    true, pace, rows = made_runs()
    df = spark.createDataFrame([*rows, ("alone", "x", 1.0), ("r1", "s000", 99.0), (None, "s001", 1.0), ("r1", None, 1.0)], "run string, modseq string, rt double")
    held = {}
    for r, s, _ in rows:
        held.setdefault(r, set()).add(s)
    want = {(a, b): len(held[a] & held[b]) for a in held for b in held if a < b and held[a] & held[b]}
    assert {(r["a"], r["b"]): r["n"] for r in transfer.shared_counts(df).collect()} == want
    tree = transfer.run_tree(df)
    # Brute force: no spanning tree shares more.
    best = 0
    import itertools

    for edges in itertools.combinations(want, 4):
        part = {r: r for r in held}
        for a, b in edges:
            part = {r: part[b] if p == part[a] else p for r, p in part.items()}
        if len(set(part.values())) == 1:
            best = max(best, sum(want[e] for e in edges))
    assert sum(want[min(r, p), max(r, p)] for r, p, _ in tree if p) == best
    assert tree[0] == ("r1", None, 0) and ("alone", None, 0) in tree and len(tree) == 6


def test_times_through_the_tree(spark):
    true, pace, rows = made_runs()
    df = spark.createDataFrame([*rows, ("alone", "x", 1.0)], "run string, modseq string, rt double").repartition(3)
    got = transfer.tree_alignment(df).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if r["run"] == "alone":
            assert (r["aligned"], r["root"]) == (1.0, "alone")
        else:
            assert r["root"] == "r1" and abs(r["aligned"] - true[r["modseq"]]) < 4, r  # times beyond what two runs share keep their pace
    assert transfer.tree_alignment(df.where("1 = 0")).count() == 0


def test_every_sequence_has_a_place_in_every_run(spark):
    true, pace, rows = made_runs()
    rows = [r for r in rows if r[0] in ("r1", "r2", "r3")]
    df = spark.createDataFrame(rows, "run string, modseq string, rt double")
    got = {(r["run"], r["modseq"]): r for r in transfer.all_peak_locations(df).collect()}
    seen = {(r, s): t for r, s, t in rows}
    names = {s for _, s, _ in rows}
    assert got.keys() == {(r, s) for r in ("r1", "r2", "r3") for s in names}
    for (run, s), r in got.items():
        assert r["observed"] == ((run, s) in seen)
        assert abs(r["rt"] - pace[run](true[s])) < (1e-9 + 0.03 if r["observed"] else 2.5), r


def test_boundaries_are_transferred(spark):
    xs = [float(k) for k in range(100)]
    bell = lambda c, w=3.0: [1000 * math.exp(-(((t - c) / w) ** 2)) for t in xs]
    ref = spark.createDataFrame([(m, t, y) for m, c in (("p", 30), ("q", 60)) for t, y in zip(xs, bell(c))], "modseq string, rt double, intensity double")
    bounds = transfer.reference_shapes(ref, 12.0)
    got = {r["modseq"]: r for r in bounds.collect()}
    assert abs(got["p"]["apex"] - 30) < 0.5 and got["p"]["start"] < 30 < got["p"]["stop"] and len(got["p"]["shape"]) == 20
    pairs = spark.createDataFrame([("a", float(t), t + 10.0) for t in range(0, 90, 2)], "run string, reference_rt double, rt double")
    rows = [("a", "p", t, y) for t, y in zip(xs, bell(40))] + [("a", "q", t, y) for t, y in zip(xs, bell(78))]  # q lies 8 off
    out = {r["modseq"]: r for r in transfer.transferred_peaks(bounds, pairs, spark.createDataFrame(rows, "run string, modseq string, rt double, intensity double"), 12.0).collect()}
    p, q = out["p"], out["q"]
    assert p["transferred"] and p["correlation"] > 0.95 and p["start"] < 40 < p["stop"] and p["net"] == pytest.approx(1000 * 3 * math.sqrt(math.pi), rel=0.05)
    assert not q["transferred"] and q["correlation"] > 0.75 and q["start"] < 78 < q["stop"] and q["area"] == pytest.approx(1000 * 3 * math.sqrt(math.pi), rel=0.05)


def test_times_of_a_librarys_sources(spark, tmp_path):
    """Three sources at paces of their own; the third meets the first only through the second."""
    true = {k: 10 + k * 0.5 for k in range(120)}
    pace = {1: lambda t: t, 2: lambda t: 1.1 * t + 1, 3: lambda t: 0.95 * t - 3}
    rows = [(k, pace[s](true[k]), s, int(best)) for s, (a, z) in {1: (0, 60), 2: (30, 89), 3: (65, 120)}.items() for k in range(a, z) for best in [s == (1 if k < 60 else 2 if k < 89 else 3)]]
    rows += [(5, pace[1](true[5]) + 0.4, 1, 0), (5, pace[1](true[5]) - 0.4, 1, 0)]
    con = sqlite3.connect(tmp_path / "a.blib")
    con.execute("CREATE TABLE RetentionTimes (RefSpectraID INTEGER, retentionTime REAL, spectrumSourceID INTEGER, bestSpectrum INTEGER)")
    con.executemany("INSERT INTO RetentionTimes VALUES (?, ?, ?, ?)", [(i, t / 60, s, b) for i, t, s, b in rows])
    con.commit()
    con.close()
    got = {r["id"]: r["rt"] for r in transfer.blib_times(spark, str(tmp_path / "a.blib")).collect()}
    assert got.keys() == true.keys()
    assert all(got[k] == pytest.approx(true[k]) for k in range(60))
    assert max(abs(got[k] - true[k]) for k in range(60, 120)) < 3
    assert transfer.source_times(spark.createDataFrame([], "k string, id long, rt double, source long, best int"), ["k"]).where(F.lit(True)).count() == 0


def test_models_come_from_counts(spark, monkeypatch):
    """No task sees all pairs of a run (before, a run was one group), and the models are those of `kernels.align`."""
    rng = np.random.default_rng(4)
    rows = [("big", float(v), float(v + np.sin(v / 9) + rng.normal(0, 0.2))) for v in rng.uniform(0, 60, 500)]
    rows += [("line", float(v), 2.0 * v + 1) for v in range(9)] + [("flat", float(v), 3.0) for v in range(30)] + [("two", 0.0, 1.0), ("two", 1.0, 5.0)] + [(None, float(v), v / 2) for v in range(40)]
    pairs = spark.createDataFrame(rows, "run string, x double, y double").repartition(4)
    asked = [(r, v, k) for r in ("big", "line", "flat", "two", "none", None) for k, v in enumerate((-5.0, 3.25, 41.5, 80.0, None))]
    sizes = []
    monkeypatch.setattr(transfer, "per_group", lambda df, *rest: sizes.append(df.count()) or kernels.per_group(df, *rest))
    got = {(r["run"], r["k"]): r for r in transfer.warped_by(pairs, spark.createDataFrame(asked, "run string, x double, k int"), ["run"], "x", "y").collect()}
    assert len(got) == len(asked) and max(sizes) < len(rows)
    for run, v, k in asked:
        own = sorted((x, y) for r, x, y in rows if r == run)
        model = kernels.align(*map(np.array, zip(*own))) if own else lambda u: u
        assert got[run, k]["x"] == v and (got[run, k]["warped"] is None if v is None else got[run, k]["warped"] == pytest.approx(float(model(np.array([v]))[0]), abs=1e-9)), (run, v)
    none = pairs.where("1 = 0")
    assert transfer.warped_by(none, none, ["run"], "x", "y").count() == 0
