"""Operator 8 against a table of all passages."""

import hashlib
import random

import numpy as np
import pytest

from peakfold.llm import repeats


def brute(rows, least):
    docs = [(2**63 - 1 if d is None else d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in docs:
        for k in range(len(b) - least + 1):
            first[b[k : k + least]] = min(d, first.get(b[k : k + least], d))
    out = []
    for (d, b), (name, _) in zip(docs, rows):
        m = bytearray(len(b))
        for k in range(len(b) - least + 1):
            if first[b[k : k + least]] < d:
                m[k : k + least] = b"\1" * least
        spans = sum(1 for k in range(len(m)) if m[k] and (k == 0 or not m[k - 1]))
        out.append((name, len(b), sum(m), spans, hashlib.sha256(bytes(x for x, y in zip(b, m) if not y)).hexdigest()))
    return sorted(out, key=str)


def result(df, least=50):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.dedup(df, least).collect()), key=str)


def passages(seed, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice(["ab", "c", "é", "the", "日本", "x" * 9]) + str(rng.randint(0, 99))
    pool = [" ".join(word() for _ in range(rng.randint(8, 40))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(pool)
            a = rng.randint(0, len(p) // 2)
            parts += [p[a : a + rng.randint(5, len(p))], " ".join(word() for _ in range(rng.randint(0, 5)))]
        rows.append((i, "".join(parts)))
    rows += [(n + 1, rows[3][1]), (n + 2, rows[3][1]), (n + 3, "a" * 200), (n + 4, "a" * 120), (n + 5, "abcdefg" * 40), (n + 6, "xx" + "abcdefg" * 30)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_all_passages(spark, seed):
    rows = passages(seed)
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows, 50)


def test_small_pages_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PAGE", 2000)
    monkeypatch.setattr(repeats, "BUCKET", 20)
    rows = passages(7)
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows, 50)


def test_other_lengths(spark):
    rows = passages(8, 30)
    assert result(spark.createDataFrame(rows, "doc_id long, text string"), least=64) == brute(rows, 64)


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert result(odd) == brute(rows, 50)
    assert repeats.dedup(none).count() == 0


def test_bucket_matches_spark(spark):
    ids = [0, 1, 5, 1 << 40, (7 << 40) + 123]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i long").selectExpr("pmod(hash(i), 17)").collect()]
    assert repeats.bucket_of(np.array(ids), 17).tolist() == got


def test_anchors_cover_every_passage():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 4, 3000).astype(np.uint8)
    ends = np.array([700, 720, 720, 1500, 3000])
    at, h, first, last, doc = repeats.anchors(data, ends, 50)
    starts = [t for a, z in zip(first, last) for t in range(a, z + 1)]
    assert sorted(starts) == [t for a, z in zip([0, 700, 720, 720, 1500], ends) for t in range(a, z - 49)]
    grams = repeats.gram_hashes(data)
    for p, a, z in zip(at, first, last):
        assert all((grams[t : t + 31] >> np.uint64(32)).min() == grams[p] >> np.uint64(32) and t <= p < t + 31 for t in range(a, z + 1))


def test_suffix_array_and_intervals():
    """Maximal repeats of the suffix array equal those of all pairs of substrings, up to the depth that is compared."""
    rng = random.Random(5)
    base = bytes(rng.choice(b"abcd") for _ in range(60))
    texts = [b"Q" + base[:56] + b"1" * 20, b"R" + base[:56] + b"2" * 20, b"R" + base[:53] + b"333" + b"4" * 20]
    rows = np.zeros((3, 90), np.uint8)
    for i, t in enumerate(texts):
        rows[i, 0], rows[i, 2] = 3, 1 + 2 * 6
        rows[i, 3 : 3 + len(t)] = np.frombuffer(t, np.uint8)
    row, o, lcp, left = repeats.suffix_array(rows, 50, 6)
    suffix = lambda k: texts[row[k]][1 + o[k] : 1 + o[k] + 56]
    got = [suffix(k) for k in range(len(row))]
    assert got == sorted(got)
    for k in range(1, len(row)):
        n = next((i for i, (x, y) in enumerate(zip(got[k - 1], got[k])) if x != y), 56)
        assert lcp[k] == (n if n >= 50 else 0)
    found = {(d, frozenset((int(row[k]), int(o[k])) for k in range(a, z))) for d, a, z in repeats.intervals(lcp, left, 50, 6)}
    assert (53, frozenset({(0, 0), (1, 0), (2, 0)})) in found and (56, frozenset({(0, 0), (1, 0)})) in found
    assert all(len({left[k] for k in range(a, z)}) > 1 or -1 in {left[k] for k in range(a, z)} for _, a, z in repeats.intervals(lcp, left, 50, 6))


def test_repeat_groups(spark):
    """Every pair of equal passages of 50 bytes in different places is in a group; groups hold equal bytes, all of them, and
    can't be extended to the left."""
    rows = passages(11, 25)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    least = {}
    for d, t in rows:
        least[t] = min(d, least.get(t, d))
    text = {d: t.encode() for t, d in least.items()}
    groups = {}
    for r in repeats.repeat_groups(df).collect():
        groups.setdefault((r.repeat, r.length), set()).add((r.doc_id, r.start))
    want = {}
    for d, b in text.items():
        for k in range(len(b) - 49):
            want.setdefault(b[k : k + 50], set()).add((d, k))
    covered = set()
    for (_, n), places in groups.items():
        said = {text[d][s : s + n] for d, s in places}
        assert len(said) == 1 and len(places) > 1 and len(next(iter(said))) == n >= 50
        before = {text[d][s - 1] if s else None for d, s in places}
        assert len(before) > 1 or None in before or n == 56
        if n < 56:
            whole = next(iter(said))
            assert places == {(d, k) for d, b in text.items() for k in range(len(b) - n + 1) if b[k : k + n] == whole}
        covered |= {(d, s + i) for d, s in places for i in range(n)}
    shared = {p for v in want.values() if len({d for d, _ in v}) > 1 for p in v}
    assert {(d, s) for d, s in shared if s == 0 or (d, s - 1) not in shared} <= covered


def maximal_repeats(text, least):
    """(length, places) of every pair of places with different bytes (or none) on both sides."""
    grams = {}
    for d, b in text.items():
        for k in range(len(b) - least + 1):
            grams.setdefault(b[k : k + least], []).append((d, k))
    found = set()
    for places in grams.values():
        for i, (d, s) in enumerate(places):
            for e, t in places[:i]:
                x, y = text[d], text[e]
                if s == 0 or t == 0 or x[s - 1] != y[t - 1]:
                    n = least
                    while s + n < len(x) and t + n < len(y) and x[s + n] == y[t + n]:
                        n += 1
                    found.add(x[s : s + n])
    return {(len(w), frozenset((d, k) for d, k in grams[w[:least]] if text[d][k : k + len(w)] == w)) for w in found}


@pytest.mark.parametrize("least", [50, 64])
def test_repeat_groups_have_no_longest_length(spark, monkeypatch, least):
    """Repeats of several hundred bytes, nested ones, ones within a text and ones at both ends of texts come out whole."""
    monkeypatch.setattr(repeats, "PAGE", 3000)
    monkeypatch.setattr(repeats, "BUCKET", 50)
    rng = random.Random(12)
    other = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    p, q = other(500), other(900)
    rows = [(1, other(40) + p + other(30)), (2, other(9) + p + other(50)), (3, p[100:400] + "!"), (4, "?" + p[:300]), (5, q), (6, "x" + q), (7, other(20) + q[:613] + "zz" + q[615:]), (8, other(7) + q[200:500] + "--" + q[200:500] + "+"), (9, "ab" * 90), (10, "c" * 130), (11, q)]
    groups = {}
    for r in repeats.repeat_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), least).collect():
        groups.setdefault((r.repeat, r.length), []).append((r.doc_id, r.start))
    got = [(n, frozenset(v)) for (_, n), v in groups.items()]
    want = maximal_repeats({d: t.encode() for d, t in rows[:-1]}, least)
    assert len({k for k, _ in groups}) == len(groups) == len(set(got)) and all(len(v) == len(set(v)) for v in groups.values())
    assert set(got) == want and max(n for n, _ in want) == 900
    assert (500, frozenset({(1, 40), (2, 9)})) in want


def test_clean_up(spark):
    from peakfold.llm.common import Scratch, clean_up

    assert repeats.dedup(spark.createDataFrame(passages(2, 10), "doc_id long, text string")).count() > 0
    assert Scratch.roots and any(t.name.startswith("pages_") for t in spark.catalog.listTables())
    clean_up(spark)
    assert not Scratch.roots and not any(t.name.startswith("pages_") for t in spark.catalog.listTables())


def test_messages_grow_with_the_text():
    """A row for each page and bundle: ten times the text makes about ten times the rows (with pages and buckets of one size: a hundred)."""
    rows = {}
    for total in (1 << 30, 10 << 30):
        page, buckets, per = repeats.layout(total, 200, 50)
        rows[total] = total // page * (buckets // per)
        assert total * 2 // 32 / buckets <= repeats.BUCKET
    assert rows[10 << 30] <= 12 * rows[1 << 30]


def test_a_task_writes_to_all_buckets_in_turn():
    """One large file is one task, whose pages are read by as many tasks as there are buckets."""
    ids = [i for _, i in zip(range(24), repeats.ids_in_bucket(5, 8, 3))]
    got = repeats.bucket_of(np.array(ids), 8).tolist()
    assert len(set(ids)) == 24 and sorted(got) == sorted(list(range(8)) * 3) and all(len(set(got[k : k + 3])) == 1 for k in range(0, 24, 3))


def test_buckets_of_a_bundle_are_decided_apart():
    rng = np.random.default_rng(9)
    data = rng.integers(97, 100, 4000).astype(np.uint8)
    data[2000:2300] = data[100:400]
    ends = np.array([1500, 4000])
    at, _, first, last, doc = repeats.anchors(data, ends, 50)
    rows = repeats.contexts(data, np.array([0, 1500]), ends, at, first, last, doc, 50, 6)
    own, low = rng.integers(0, 3, len(rows)), doc + 7
    runs, begin, sizes, said = repeats.answers_by_bucket(own, rows, low, 50, 6)
    for k in range(3):
        place = np.flatnonzero(own == k)
        _, want = repeats.least_documents(rows[place], low[place], 50, 6)
        got = np.concatenate([np.repeat(said[begin[i] : begin[i] + runs[i]], sizes[begin[i] : begin[i] + runs[i]]) for i in place])
        assert got.tolist() == want.tolist()
