"""Operator 12 against a plain scorer that looks at every document."""

import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from peakfold.llm import ranking

TERM = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain(docs, items, k=10):
    held = [(d, terms(t)) for d, t in docs]
    held = [(d, w) for d, w in held if w]
    n, total = len(held), sum(len(w) for _, w in held)
    df = {}
    for _, w in held:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        found = []
        for d, w in held:
            m = 100 - 90 + (90 * len(w) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * w.count(t)) // (1000 * w.count(t) + 8 * m)) for t in set(terms(text)) if t in df)
            if s > 0:
                found.append((-s, d is None, d or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def ranked(spark, docs, items, files=3, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(files)
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted([tuple(r) for r in ranking.rank(d, i, **more).select("item_id", "rank", "doc_id", "score").collect()], key=str)


def some(seed, n, most=60):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)] + ["Der", "the", "ÉTÉ", "naïve", "x9", "日本語"]
    say = lambda m: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(m))
    return [(rng.randint(-500, 500), say(rng.randint(0, most))) for _ in range(n)], [(k, say(rng.randint(1, 25))) for k in range(12)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_plain_scorer(spark, seed):
    docs, items = some(seed, 400)
    assert ranked(spark, docs, items) == plain(docs, items)


def test_many_shards_and_blocks(spark, monkeypatch):
    """Small shards in one task share heaps; items in several blocks; results stay."""
    monkeypatch.setattr(ranking, "SHARD", 700)
    docs, items = some(3, 300)
    assert ranking.index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).where("term IS NULL").count() > 10
    assert ranked(spark, docs, items, block_bytes=200) == plain(docs, items)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " .,! "), (None, "alpha beta"), (None, "alpha beta"), (5, "alpha beta"), (5, "alpha beta"), (-7, "ALPHA beta"), (8, "gamma " * 4000), (2**62, "beta gamma"), (-(2**63), "beta é")]
    items = [(1, "alpha beta"), (1, "alpha beta"), (None, "gamma"), (2, None), (3, ""), (4, "unknown"), (5, "Alpha alpha ALPHA É é")]
    assert ranked(spark, docs, items) == plain(docs, items)
    assert ranked(spark, docs, items, k=2) == plain(docs, items, 2)


def test_empty_tables(spark):
    assert ranked(spark, [], [(1, "a")]) == [] == ranked(spark, [(1, "a")], []) == ranked(spark, [(1, None)], [(1, "a")])


def test_equal_scores_across_shards_go_to_the_smaller_id(spark, monkeypatch):
    monkeypatch.setattr(ranking, "SHARD", 50)
    docs = [(k, "one two three") for k in range(40, 0, -1)] + [(100 + k, "four") for k in range(50)]
    assert [r[2] for r in sorted(ranked(spark, docs, [(1, "two")], files=1), key=lambda r: r[1])] == list(range(1, 11))


def test_columns_of_clashing_names(spark):
    d = spark.createDataFrame([(1, "a b", "x", 1, 2, 3)], "doc_id long, text string, term string, shard long, df int, postings int")
    i = spark.createDataFrame([(9, "a", 1, "y")], "item_id long, text string, row int, terms string")
    assert [(r["item_id"], r["doc_id"]) for r in ranking.rank(d, i).collect()] == [(9, 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1)))
def test_packed_numbers_come_back(values):
    data, ends = ranking.pack(np.array(values, np.uint64))
    assert ranking.unpack(data.tobytes()).tolist() == values and len(ends) == len(values)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 60), st.integers(1, 50), min_size=1), min_size=1, max_size=6), st.integers(1, 4))
def test_merge_finds_the_best(lists, k):
    """Every list with its own gains; the heap holds what adding up everything gives."""
    made = []
    for x in lists:
        p = object.__new__(ranking.Postings)
        p.places, p.gains = sorted(x), [x[d] for d in sorted(x)]
        p.most, p.kth = max(p.gains), sorted(p.gains)[-k] if len(x) >= k else 0
        made.append(p)
    best = []
    ranking.merge(made, list(range(100, 200)), best, k)
    total = {}
    for x in lists:
        for d, g in x.items():
            total[d] = total.get(d, 0) + g
    assert sorted(best, reverse=True) == sorted(((s, -100 - d) for d, s in total.items()), reverse=True)[:k]
