"""Operator 7 against all pairs."""

import random
import re

import numpy as np
import pytest

from peakfold.llm import jaccard


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    part = list(range(len(rows)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                part[root(i)] = root(j)
    names = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            names[root(i)] = min(d, names.get(root(i), d))
    return sorted(((d, len(sets[i]), names.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        k = rng.randrange(len(w))
        w[k] = f"e{rng.randint(0, 10**6)}"
    return w


def near_copies(seed, groups=25, size=6):
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(40)]
    rows = []
    for g in range(groups):
        words = [f"w{rng.randint(0, 4000)}" for _ in range(rng.choice([3, 5, 6, 9, 30, 80, 200]))]
        if g % 3 == 0:
            words += common
        for _ in range(size):
            rows.append((len(rows), " ".join(edited(rng, words, rng.choice([0, 0, 1, 1, 2, 4]))).replace("w1", "W1")))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_all_pairs(spark, seed):
    rows = near_copies(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()), key=str)
    assert got == brute(rows)


def test_large_cells_in_blocks(spark, monkeypatch):
    """Cells cut into many tiles lose no link."""
    monkeypatch.setattr(jaccard, "BLOCK", 600)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(edited(rng, base, rng.randint(0, 5)))) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()), key=str)
    assert got == brute(rows)


def test_threshold_is_exact(spark):
    """Sets of 9 with 8 in common are at 0.8; of 8 with 7 in common, below."""
    w = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(w[:13])), (2, " ".join(w[:12] + ["x"])), (3, " ".join(w[20:32])), (4, " ".join(w[20:31] + ["y"]))]
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_bitmap_bound_never_drops_a_link():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 2**63, rng.integers(1, 80)).astype(np.uint64)
        for _ in range(3):
            sets.append(np.unique(np.where(rng.random(len(base)) < 0.05, rng.integers(0, 2**63, len(base)).astype(np.uint64), base)))
    label = np.arange(len(sets))
    jaccard.compare(sets, label, np.ones(len(sets), bool), 80)
    part = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            s = len(np.intersect1d(sets[i], sets[j]))
            if 100 * s >= 80 * (len(sets[i]) + len(sets[j]) - s):
                a, b = part[i], part[j]
                part = [b if p == a else p for p in part]
    assert len(set(part)) == len(set(label.tolist())) and all((part[i] == part[j]) == (label[i] == label[j]) for i in range(len(sets)) for j in range(i))


def test_bands_hold_every_pair():
    starts = jaccard.band_starts(80)
    band = lambda n: int(np.searchsorted(starts, n, "right")) - 1
    assert all(band(n * 100 // 80) - band(n) <= 1 for n in range(1, 5000))


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(odd).collect()), key=str)
    assert got == brute(rows)
    assert jaccard.near_duplicates(none).count() == 0
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    texts = [r.text for r in kept.collect()]
    assert len([t for t in texts if t and t.startswith(rows[0][1][:30])]) >= 1 and len(texts) < len(rows)
    assert jaccard.keep_one(none).count() == 0


def test_frequency_of_hot_shingles(spark, monkeypatch):
    """A shingle of very many nodes is counted by an aggregation: the same counts, in no plan's window."""
    import collections
    import random

    from pyspark.sql import functions as F

    from peakfold.llm.common import Scratch

    rng = random.Random(2)
    rows = [(i, 77) for i in range(3000)] + [(i, 1000 + rng.randint(0, 400)) for i in range(3000)] + [(i, 5000 + i) for i in range(500)]
    df = spark.createDataFrame(rows, "node long, h long")
    want = collections.Counter(h for _, h in rows)
    for hot in (10**9, 100):
        monkeypatch.setattr(jaccard, "HOT", hot)
        out = jaccard.with_frequency(df, Scratch(spark, "test"))
        assert sorted((r.node, r.h, r.df) for r in out.collect()) == sorted((i, h, want[h]) for i, h in rows)
    # With the hot one told apart, the window sees only the others.
    assert out.where("df < 1000").agg(F.max("df")).first()[0] == max(n for h, n in want.items() if h != 77)
