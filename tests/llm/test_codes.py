"""Operator 11 against plain loops over Python's integers."""

import hashlib
import math
import random

import pytest

from peakfold.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, parts, entries, rounds):
    """(vec_id, code, error, label_error) sorted, and the digest."""
    kept = [(i, [math.floor(256 * x) if abs(x) < 1e15 else int(x) * 256 for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], None
    dim = max(len(v) for _, v, _ in kept)
    width = -(-dim // parts)
    cut = [[(v + [0] * (parts * width - len(v)))[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    first = sorted((i, k) for k, (i, _, _) in enumerate(kept) if i is not None)[:entries]
    books = [[cut[k][p] for _, k in first] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        after = [list(b) for b in books]
        for p in range(parts):
            own = {}
            for x in cut:
                own.setdefault(nearest(p, x[p])[1], []).append(x[p])
            for e, xs in own.items():
                after[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
        books = after
    best = [[nearest(p, x[p]) for p in range(parts)] for x in cut]
    error = [min(sum(d for d, _ in b), 2**63 - 1) for b in best]
    total = {}
    for (_, _, lab), e in zip(kept, error):
        total[lab] = min(total.get(lab, 0) + e, 2**63 - 1)
    out = [(i, "".join(f"{e:02x}" for _, e in b), e, total[lab]) for (i, _, lab), b, e in zip(kept, best, error)]
    return sorted(out, key=str), hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()


def run(spark, rows, parts=4, entries=8, rounds=2, schema=SCHEMA):
    got = codes.compress(spark.createDataFrame(rows, schema).repartition(3), parts, entries, rounds).collect()
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got), key=str), {r["codebooks_sha256"] for r in got}


def some(seed, n, dim, scale=1.0):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, scale) for _ in range(dim)], rng.choice([None, 1, 1, 1, 2])) for i in range(n)]


@pytest.mark.parametrize("dim", [8, 10, 3])
def test_against_plain_loops(spark, dim):
    rows = some(dim, 120, dim)
    want, sha = plain(rows, 4, 8, 2)
    assert run(spark, rows) == (want, {sha})


def test_ties_and_unused_entries(spark):
    """Many equal vectors: the first of equal entries takes them all, the others stay as they began."""
    rows = [(i, [1.0, 2.0, 3.0, 4.0], 7) for i in range(20)] + [(i, [-1.5, 0.25, -3.0, 4.0], None) for i in range(20, 30)]
    want, sha = plain(rows, 4, 12, 2)
    assert run(spark, rows, entries=12) == (want, {sha})


def test_odd_vectors(spark):
    """Null vectors, null and non-finite components, shorter vectors, no ident, equal idents of one vector."""
    rows = some(5, 40, 8) + [(100, None, 1), (101, [1.0] * 7 + [None], 1), (102, [math.nan] * 8, 1), (103, [math.inf] * 8, 1), (104, [0.5, -0.5], 1), (105, [], 2), (None, [0.1] * 8, 2), (106, [0.3] * 8, 2), (106, [0.3] * 8, 2)]
    want, sha = plain(rows, 4, 8, 2)
    assert run(spark, rows) == (want, {sha})
    assert len(want) == 45


def test_components_of_any_size(spark):
    """Exact beyond 64 bits; errors are cut to the largest 64-bit number."""
    rows = some(6, 30, 4, 1e7) + [(50, [1e30, -1e30, 3.0, 0.0], 1), (51, [1e30, -2e30, 3.0, 1e300], 1), (0, [5e8] * 4, 2)]
    rows = [(k, v, lab) for k, (_, v, lab) in enumerate(rows)]
    want, sha = plain(rows, 2, 4, 2)
    assert run(spark, rows, parts=2, entries=4) == (want, {sha})
    assert any(e == 2**63 - 1 for *_, e, _ in want)


def test_empty_only_and_none(spark):
    assert run(spark, []) == ([], set())
    assert run(spark, [(1, None, 1), (2, [math.nan], 1)]) == ([], set())
    want, sha = plain([(1, [], 1), (2, [], None)], 4, 8, 2)
    assert run(spark, [(1, [], 1), (2, [], None)]) == (want, {sha})


def test_clashing_columns_and_large_label(spark):
    df = spark.createDataFrame([(i, [float(i % 3)] * 4, 1 if i % 3 else None, "x", 1, 2) for i in range(30)], SCHEMA + ", code string, error long, v int")
    got = codes.compress(df, 4, 8, 2).collect()
    assert len(got) == 30 and got[0].asDict().keys() == {"vec_id", "code", "error", "label_error", "codebooks_sha256"}


def test_codes_restore_the_entries(spark):
    rows = some(9, 60, 8)
    kept = codes.keep(spark.createDataFrame(rows, SCHEMA))
    books = codes.train(kept, 4, 16, 2)
    coded = codes.encode(kept, books)
    error = {r["vec_id"]: r["error"] for r in coded.collect()}
    for r in codes.decode(coded, books).collect():
        x = [math.floor(256 * v) for v in rows[r["vec_id"]][1]]
        assert sum((a - round(256 * b)) ** 2 for a, b in zip(x, r["restored"])) == error[r["vec_id"]]
