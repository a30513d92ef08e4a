"""Kernels against brute force or what they must recover."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from peakfold.operators import kernels as k


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=30), st.integers(1, 4), st.integers(0, 4))
def test_exclusive_top(values, n, zone):
    got = k.exclusive_top(np.array(values, float), n, zone)
    want, order = [], sorted(range(len(values)), key=lambda i: (-values[i], i))
    for i in order:
        if len(want) < n and all(abs(i - j) > zone for j in want):
            want.append(i)
    assert got.tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-20, 20), min_size=1, max_size=12))
def test_pava(values):
    y = np.array(values, float)
    got = k.pava(y)
    assert (np.diff(got) >= -1e-9).all() and got.mean() == pytest.approx(y.mean())
    want = [max(min(y[a : b + 1].mean() for b in range(i, len(y))) for a in range(i + 1)) for i in range(len(y))]
    assert got == pytest.approx(want)


def test_peak_bounds():
    y = np.array([0, 1, 5, 20, 50, 20, 5, 1, 0, 30, 60, 30.0])
    assert k.peak_bounds(y, apex=4) == (1, 7) or k.peak_bounds(y, apex=4) == (1, 8)
    assert k.peak_bounds(np.array([3.0])) == (0, 0) and k.peak_bounds(np.zeros(0)) == (0, -1)


def test_savitzky_golay_matches_fixed_filter():
    assert k.savitzky_golay_coefficients(5, 2) * 35 == pytest.approx([-3, 12, 17, 12, -3])


def test_modes_and_alignment():
    rng = np.random.default_rng(1)
    assert k.mode(np.concatenate([rng.normal(5, 0.1, 300), rng.uniform(0, 20, 50)])) == pytest.approx(5, abs=0.4)
    x = np.sort(rng.uniform(0, 100, 2000))
    y = 10 + 0.8 * x + rng.normal(0, 0.5, 2000)
    y[::10] = rng.uniform(0, 100, 200)
    assert np.median(np.abs(k.align(x, y)(x) - (10 + 0.8 * x))) < 1.5
    assert k.align(np.array([1.0]), np.array([5.0]))(np.array([3.0]))[0] == 3
    mean, sd, share, post = k.mixture(np.concatenate([rng.normal(0, 1, 900), rng.uniform(-50, 50, 100)]))
    assert abs(mean) < 0.3 and 0.7 < sd < 1.5 and share > 0.8 and post[:900].mean() > 0.9


def test_local_fdr_is_monotone():
    rng = np.random.default_rng(2)
    p = np.concatenate([rng.uniform(0, 1, 800), rng.beta(0.2, 8, 200)])
    f = k.local_fdr(p)
    o = np.argsort(p)
    assert (np.diff(f[o]) >= 0).all() and f[o[:20]].mean() < 0.5 < f[o[-100:]].mean() <= 1


def test_discriminant_separates():
    rng = np.random.default_rng(3)
    decoy = np.arange(4000) % 2 == 1
    true = ~decoy & (rng.random(4000) < 0.6)
    x = rng.normal(0, 1, (4000, 3))
    x[true, 0] += 3
    x[true, 1] -= 2
    c, b = k.semi_supervised(x, decoy)
    s = x @ c + b
    assert c[0] > 0 > c[1] and s[true].mean() > s[~true].mean() + 2 * s[~true].std()
    pep = k.posterior_error(s, decoy)
    assert pep[true].mean() < 0.2 and pep[decoy].mean() > 0.5 and (np.diff(pep[np.argsort(-s)]) >= -1e-9).all()


def test_parsimony():
    error = {i: 0.01 for i in "abcdef"}
    got = k.parsimony({"P1": set("abc"), "P2": set("bc"), "P3": set("d"), "P4": set("d"), "P5": set("ef")}, error)
    assert sorted(tuple(sorted(g)) for g, _, _ in got) == [("P1",), ("P3", "P4"), ("P5",)]
    assert set().union(*[s for _, s, _ in got]) == set("abcdef")


def test_isotopes_and_xcorr():
    d = k.isotope_distribution(np.array([120, 60, 20, 16, 1]))
    assert d.sum() == pytest.approx(1) and d[0] > d[1] > d[2]
    mz = np.array([200.1, 300.2, 400.3])
    assert k.xcorr(mz, mz, np.array([10.0, 20, 30])) > k.xcorr(mz + 31, mz, np.array([10.0, 20, 30]))


def test_transitions_and_dilution():
    m = np.outer([1, 2, 4, 8.0], [10, 20, 30, 5])
    m[:, 3] = [5, 90, 1, 60]
    assert 3 not in k.select_transitions(m, least=2)
    x = np.array([0.1, 0.3, 1, 3, 10, 30, 100])
    noise, factor, lod, loq = k.dilution_fit(x, np.maximum(2.0 * x, 5))
    assert factor == pytest.approx(2, rel=0.1) and 1 < lod <= loq < 6


def test_schedule_keeps_the_cap():
    rng = np.random.default_rng(4)
    a = rng.uniform(0, 50, 200)
    z = a + rng.uniform(1, 5, 200)
    t = k.schedule(a, z, rng.random(200), 5, 0.5)
    assert t.sum() > 20 and max(sum(1 for i in np.flatnonzero(t) if a[i] <= q <= z[i]) for q in np.arange(0, 55, 0.5)) <= 5


def test_monotone_cubic():
    x, y = np.array([0, 1, 2, 3.0]), np.array([0, 1, 1, 5.0])
    v = k.monotone_cubic(x, y, np.linspace(0, 3, 50))
    assert (np.diff(v) >= -1e-9).all() and v[0] == 0 and v[-1] == 5


def test_sigmoid():
    x = np.linspace(-5, 5, 200)
    slope, mid = k.sigmoid_fit(x, 1 / (1 + np.exp(-2 * (x - 1))))
    assert mid == pytest.approx(1, abs=0.2) and slope > 1


def test_hysteresis_query(spark):
    """The declared order decides; a fold in Python gives the same rows."""
    from peakfold.plans import catalog
    from tests.conftest import SF

    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/lineitem.parquet").collect()]
    best = {}
    for key, group in itertools.groupby(sorted(rows, key=lambda r: (r["l_partkey"], r["l_orderkey"], r["l_linenumber"], r["l_extendedprice"], r["l_discount"])), key=lambda r: r["l_partkey"]):
        b = None
        for r in group:
            if b is None or b["l_extendedprice"] < 0.9 * r["l_extendedprice"] or (r["l_extendedprice"] >= 0.9 * b["l_extendedprice"] and abs(r["l_discount"]) < abs(b["l_discount"])):
                b = r
        best[key] = (b["l_orderkey"], b["l_extendedprice"])
    got = {r.l_partkey: (r.l_orderkey, r.l_extendedprice) for r in catalog.queries()["best_with_hysteresis"](spark, SF).collect()}
    assert got == best


@pytest.mark.parametrize("ranges", [1, 5])
@pytest.mark.parametrize("descending", [False, True])
def test_running_in_ranges(spark, ranges, descending):
    from pyspark.sql import functions as F

    from peakfold.operators.running import running

    rng = np.random.default_rng(5)
    rows = [(int(g), float(v), int(a)) for g, v, a in zip(rng.integers(0, 3, 300), rng.integers(0, 40, 300), rng.integers(-5, 9, 300))]
    df = spark.createDataFrame(rows, "g int, v double, a int")
    got = running(df, ["g"], "v", {"s": ("sum", F.col("a")), "m": ("min", F.col("a"))}, descending, ranges).collect()
    for r in got:
        live = [a for g, v, a in rows if g == r.g and (v >= r.v if descending else v <= r.v)]
        assert (r.s, r.m) == (sum(live), min(live))
    assert len(got) == len(rows)


def test_folds_are_equal(spark):
    import collections

    from peakfold.operators import statistics as st

    for n, k, buckets in ((300, 5, 1024), (20_000, 5, 1024), (103, 4, 2), (3, 5, 8)):
        rows = st.k_fold(spark.range(n), ["id"], k, buckets=buckets).collect()
        sizes = collections.Counter(r.fold for r in rows)
        assert len(rows) == n and max(sizes.values()) - min(sizes.get(f, 0) for f in range(k)) <= 1
    assert sorted(st.k_fold(spark.range(500).repartition(7), ["id"], 3).collect()) == sorted(st.k_fold(spark.range(500), ["id"], 3).collect())


def test_ranges_change_nothing(spark):
    """Ranged plans, as large tables have them, against plans in one range."""
    from pyspark.sql import functions as F

    from peakfold.operators import aggregates as agg
    from peakfold.operators import statistics as st
    from peakfold.plans import catalog, flows

    x = spark.range(3000).select("id", (F.pmod(F.xxhash64("id"), F.lit(700)) / 7.0).alias("s"), (F.pmod(F.hash("id"), F.lit(3)) == 0).alias("decoy"), (F.col("id") % 3).cast("string").alias("g"))
    for ranges in (2, 5):
        assert agg.roc_auc(x, "s", ~F.col("decoy"), ranges).first() == agg.roc_auc(x, "s", ~F.col("decoy")).first()
        one, many = (sorted((r.id, round(r.q, 12)) for r in st.tdc_q_values(x, ["g"], "s", F.col("decoy"), ranges=k).collect()) for k in (1, ranges))
        assert one == many
        one, many = (sorted((r.id, round(r.fdr, 12)) for r in st.localization_fdr(x, "s", 0.5, k).collect()) for k in (1, ranges))
        assert one == many and one
        groups = x.select(F.when(F.col("decoy"), "DECOY_a").otherwise("b").alias("members"), F.col("s").alias("least_error"), "id")
        one, many = (sorted((r.id, round(r.q, 12)) for r in flows.protein_q_values(groups, k).collect()) for k in (1, ranges))
        assert one == many
    ranges_for = catalog.ranges_for
    plain = sorted(catalog.p_values(spark, "/root/testdata/sf0.001").collect())
    try:
        catalog.ranges_for = lambda df: 3
        assert sorted(catalog.p_values(spark, "/root/testdata/sf0.001").collect()) == plain
    finally:
        catalog.ranges_for = ranges_for


def test_modes_of_groups(spark):
    """The distributed density against the kernel's, a constant group and one value."""
    from peakfold.operators import statistics as st

    rng = np.random.default_rng(8)
    rows = [("a", float(x)) for x in np.concatenate([rng.normal(5, 1, 300), rng.normal(20, 4, 200)])] + [("b", 2.5)] * 7 + [("c", 1.0)] + [("d", float(x)) for x in rng.random(50)]
    got = {r.g: r.mode for r in st.kde_mode(spark.createDataFrame([*rows, ("a", None)], "g string, v double"), ["g"], "v").collect()}
    for g in "abcd":
        assert got[g] == pytest.approx(k.mode(np.array([v for h, v in rows if h == g])), abs=1e-9)


def test_groups_across_batches(spark):
    """Groups that lie across Arrow batches, a null key, keys of several columns, empty results, lists and missing numbers."""
    import random

    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b", "c"]), rng.choice([None, 1, 2]), i, None if i % 11 == 0 else float(rng.randint(0, 9))) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, m int, i int, v double").repartition(4)

    def kernel(i, v):
        if i[0] % 5 == 0:
            return {"n": np.zeros(0, np.int64), "s": [], "all": []}
        return {"n": np.array([len(i)]), "s": [float(np.nansum(v))], "all": [[int(x) for x in i]]}

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    want = {}
    for g, m, i, v in rows:
        want.setdefault((g, m), []).append((i, v))
    want = {g: (len(x), sum(v or 0 for _, v in x), sorted(i for i, _ in x)) for g, x in want.items() if min(i for i, _ in x) % 5}
    try:
        for batch in ("7", "1", "10000"):
            spark.conf.set(key, batch)
            got = {(r["k"], r["m"]): (r["n"], r["s"], r["all"]) for r in k.per_group(df, ["k", "m"], ["i"], ["i", "v"], "n long, s double, all array<int>", kernel).collect()}
            assert got == want
    finally:
        spark.conf.set(key, before)
    assert k.per_group(df.where("1 = 0"), ["k"], ["i"], ["i", "v"], "n long, s double, all array<int>", kernel).count() == 0
