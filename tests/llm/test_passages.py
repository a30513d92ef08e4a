"""Operator 13 against plain dictionaries of passages."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from peakfold.llm import passages

LEAST = 12  # of most tests here, so that small texts do


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def plain(rows, least):
    big = lambda d: passages.LAST if d is None else d
    first = {}
    for d, t in rows:
        w = words(t)
        for k in range(len(w) - least + 1):
            p = tuple(w[k : k + least])
            first[p] = min(first.get(p, passages.LAST), big(d))
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - least + 1):
            if first[tuple(w[k : k + least])] < big(d):
                gone[k : k + least] = [True] * least
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, least=LEAST, **more):
    got = passages.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), least, **more).collect()
    for r in got:
        spans = [tuple(map(int, s.split(":"))) for s in r["spans"].split(",") if s]
        assert sum(z - a for a, z in spans) == r["n_removed"]
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=str)


def some(seed, n, shared=6):
    """Texts with passages that several of them share, some with a word changed."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "a", "ü" * rng.randint(1, 3), "w%d" % rng.randint(0, 200)])
    said = [[word() for _ in range(rng.randint(8, 60))] for _ in range(shared)]
    rows = []
    for k in range(n):
        w = []
        for _ in range(rng.randint(0, 5)):
            p = list(rng.choice(said)) if rng.random() < 0.5 else [word() for _ in range(rng.randint(1, 40))]
            if p and rng.random() < 0.3:
                p[rng.randrange(len(p))] = word()
            w += p
        rows.append((rng.randint(0, 2 * n), "".join(x + rng.choice([" ", "\n", "  ", "\t"]) for x in w)))
    return rows


@pytest.mark.parametrize("most", [passages.LEAVES, 300, 1])
def test_against_plain_dictionaries(spark, most):
    """Groups of one word, of several, and of whole passages give the same."""
    rows = some(most % 7, 120)
    assert run(spark, rows, most=most) == plain(rows, LEAST)


def test_fifty_words(spark):
    rows = some(11, 60, 3) + [(500 + k, " ".join(f"c{j}" for j in range(k, k + 70))) for k in range(15)]
    assert run(spark, rows, 50) == plain(rows, 50)


def test_odd_rows(spark):
    base = " ".join(f"b{k}" for k in range(30))
    rows = [(1, base), (2, base), (2, base), (2, base + " x"), (3, None), (4, ""), (5, " \n\t "), (None, base), (None, base + " " + base), (6, "one two"), (7, "one two"), (-5, "z " * 400), (8, "z " * 500), (9, " " + base.replace(" ", "\r\n")), (10, "x" * 5000 + " " + base)]
    assert run(spark, rows) == plain(rows, LEAST)


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == []
    rows = spark.createDataFrame([(k, " ".join(f"b{j}" for j in range(20)), 1, 2, 3, "x", 4) for k in range(3)], "doc_id long, text string, d int, page int, key int, ctx string, g int")
    got = sorted((r["doc_id"], r["n_removed"]) for r in passages.dedup(rows, LEAST).collect())
    assert got == [(0, 0), (1, 20), (2, 20)]


def test_passages_dont_cross_documents(spark):
    a, b = " ".join(f"a{k}" for k in range(8)), " ".join(f"b{k}" for k in range(8))
    rows = [(1, a), (2, b), (3, a + " " + b), (4, b + " " + a), (5, a + " " + b + " c")]
    assert run(spark, rows) == plain(rows, LEAST)


def texts(data):
    ends = np.cumsum([len(t.encode()) for t in data]).astype(np.int64)
    return np.frombuffer("".join(data).encode(), np.uint8), ends


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet=" \n\x0b\x1cabé日", max_size=30), min_size=1, max_size=5))
def test_words_of_many_texts(data):
    raw, ends = texts(data)
    h, a, z, stop = passages.words_of(raw, ends)
    want = [words(t) for t in data]
    assert np.diff(np.concatenate([[0], stop])).tolist() == [len(w) for w in want]
    got = [raw[x:y].tobytes().decode() for x, y in zip(a.tolist(), z.tolist())]
    assert got == [x for w in want for x in w]
    assert len(set(h.tolist())) == len(set(got)) and len(set(zip(h.tolist(), got))) == len(set(got))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=10, max_size=80), st.integers(1, 10))
def test_run_hashes_name_runs(values, n):
    h = passages.mixed(np.array(values, np.uint64) + np.uint64(5))
    runs = [tuple(values[k : k + n]) for k in range(len(values) - n + 1)]
    got = passages.run_hashes(h, n).tolist()
    assert len(got) == len(runs) and len(set(zip(got, runs))) == len(set(runs)) == len(set(got))


def test_deep_nodes_are_the_repeats():
    """Leaves below one deep node share `least` words, leaves of different ones don't."""
    rng = np.random.default_rng(3)
    h = passages.mixed(rng.integers(0, 2, 600).astype(np.uint64))
    h[200:260] = h[40:100]
    at, _, first, last, _ = passages.anchors(h, np.array([600]), LEAST)
    rows = passages.contexts(h, at, first, last, LEAST)
    row, place, depth = passages.subtree(rows, LEAST)
    begin, end = passages.deep_nodes(depth, LEAST)
    says = [tuple(h[first[r] + o : first[r] + o + LEAST].tolist()) for r, o in zip(row, place)]
    kinds = [{says[i] for i in range(a, z)} for a, z in zip(begin, end)]
    assert all(len(k) == 1 for k in kinds) and len(set().union(*kinds)) == len(kinds)
    assert (end - begin).max() > 1
