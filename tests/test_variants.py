"""Codons, decoys, competing alleles and scores by chance against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from peakfold.operators import variants as v


def test_codons(spark):
    rows = [("ATGGCCTAA",), ("atgnncaaag",), ("AUGUUU",), ("A",), ("",), (None,), ("TGGTGTCGA",)]
    got = [(r[0], r[1]) for r in spark.createDataFrame(rows, "s string").select(v.translate(F.col("s")), v.translate(F.col("s"), 1)).collect()]
    assert got == [("MA*", "WP"), ("MXK", "XXK"), ("MF", "C"), ("", ""), ("", ""), (None, None), ("WCR", "GV")]
    assert len(v.CODE) == 64 and v.CODE.count("*") == 3 and set(v.CODE) - {"*"} == set("ACDEFGHIKLMNPQRSTVWY")


def test_one_base_changes(spark):
    t = v.one_base_changes()
    assert t["W"] == "CGLRS" and t["M"] == "IKLRTV" and all(a in t[b] for a in t for b in t[a]) and all("*" not in s for s in t.values())
    got = [tuple(r) for r in v.single_variants(spark.createDataFrame([("MW", 1), ("", 2), ("X", 3)], "s string, n int"), "s").collect()]
    assert sorted(got) == sorted([("MW", 1, 1, "M", x, x + "W") for x in "IKLRTV"] + [("MW", 1, 2, "W", x, "M" + x) for x in "CGLRS"])


def test_decoys_avoid_the_background(spark):
    rng = random.Random(2)
    targets = ["".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(rng.randint(1, 14))) for _ in range(200)] + ["PEPTIDEK", "PC[+57.02]AAK", "AAAAAA"]
    flip = lambda s: s if len(s) < 3 else s[0] + s[-2:0:-1] + s[-1]
    taken = [*targets, *[flip(s) for s in targets[:50] if len(s) > 5], "PEDITPEK"]
    df = spark.createDataFrame([(s, i) for i, s in enumerate(targets)], "s string, n int")
    got = v.checked_decoys(df, "s", spark.createDataFrame([(s,) for s in taken], "t string")).collect()
    assert sorted(r["n"] for r in got) == list(range(len(targets)))
    for r in got:
        plain = "[" not in r["s"]
        if plain:
            assert sorted(r["decoy"]) == sorted(r["s"]) and (len(r["s"]) < 3 or (r["decoy"][0], r["decoy"][-1]) == (r["s"][0], r["s"][-1]))
            assert (r["attempt"] == 0) == (flip(r["s"]) not in taken) and (r["attempt"] != 0 or r["decoy"] == flip(r["s"]))
        assert r["attempt"] == 4 or r["decoy"] not in taken
    by = {r["s"]: r for r in got}
    assert by["AAAAAA"]["attempt"] == 4 and by["PC[+57.02]AAK"]["decoy"] == "PAAC[+57.02]K"


def test_smart_decoys_share_few_ions(spark):
    df = spark.createDataFrame([("PEPTIDEPEPTIDEK",), ("AGGGGGGGGK",), ("ELVISLIVESK",)], "s string")
    got = {r["s"]: r for r in v.checked_decoys(df, "s", df.select("s"), tries=10, most_shared=0.4).collect()}

    def share(a, b):
        u = v._ions(a)
        return sum(any(abs(x - y) <= y * 1e-5 for x in u) for y in v._ions(b)) / len(v._ions(b))

    for s, r in got.items():
        assert (r["attempt"] == 11) == (share(s, r["decoy"]) > 0.4 or r["decoy"] == s)
    assert got["AGGGGGGGGK"]["attempt"] == 11 and got["ELVISLIVESK"]["attempt"] < 11
    x = spark.createDataFrame([(a, b) for a in got for b in got], "a string, b string").withColumn("s", v.shared_ions(F.col("a"), F.col("b"), 10.0)).collect()
    assert [r["s"] for r in x] == pytest.approx([share(r["a"], r["b"]) for r in x])


def plain_competition(primary, ions, peaks, width, scans, ppm, minimum, fewest):
    near = lambda a, b: abs(a - b) <= max(a, b) * ppm * 1e-6
    half, sd, out = (scans - 1) // 2, scans / 6, []
    for batch in sorted({k[0] for k in primary}):
        found = []
        for form in sorted(k[1] for k in primary if k[0] == batch):
            rows = sorted(primary[batch, form])
            avg = []
            for i in range(len(rows)):
                parts = [(math.exp(-0.5 * ((j - i) / sd) ** 2), rows[j][2]) for j in range(i - half, i + half + 1) if 0 <= j < len(rows)]
                avg.append(sum(g * x for g, x in parts) / sum(g for g, _ in parts))
            start = max(rows, key=lambda r: (r[2], -r[0]))
            mine = [(m, f) for m, f in set(ions.get((batch, form), [])) if not any(near(m, o) for (b, other), xs in ions.items() if b == batch and other != form for o, _ in xs)]
            best = None
            for (at, rt, p), a in zip(rows, avg):
                if abs(rt - start[1]) < width:
                    hit = [f for m, f in mine if any(near(m, x) for x in peaks.get((batch, at), []))]
                    score = sum(-math.log10(f) for f in hit)
                    row = (-round(score, 9), -round(a, 9), at, rt, p, score, len(hit))
                    best = min(best, row) if best else row
            _, _, at, rt, p, score, n = best
            found.append([batch, form, at, rt, p, score, n, round(score, 9) >= minimum and n >= fewest])
        some = any(f[-1] for f in found)
        top = min(found, key=lambda f: (-f[4], f[1]))
        out += [(*f, f[-1] if some else f is top) for f in found]
    return out


def test_alleles_compete(spark):
    rng = random.Random(5)
    primary, ions, peaks = {}, {}, {}
    for b in range(8):
        forms = rng.sample("abcd", rng.randint(1, 4))
        common = [rng.uniform(100, 900) for _ in range(5)]
        for f in forms:
            primary[b, f] = [(at, at * 1.5, round(rng.random() * 3, 1)) for at in range(20)]
            ions[b, f] = [(m, 0.1) for m in common] + [(rng.uniform(100, 900), rng.choice([0.01, 0.1])) for _ in range(6)]
        for at in range(20):
            peaks[b, at] = [m * (1 + rng.uniform(-8e-6, 8e-6)) for f in forms for m, _ in ions[b, f] if rng.random() < (0 if b == 7 else 0.7 if at % 5 == b % 5 else 0.1)]
    frames = [
        spark.createDataFrame([(b, f, *r) for (b, f), rows in primary.items() for r in rows], "b int, f string, at int, rt double, primary double").repartition(3),
        spark.createDataFrame([(b, f, *r) for (b, f), rows in ions.items() for r in rows], "b int, f string, mz double, frequency double"),
        spark.createDataFrame([(b, at, m) for (b, at), xs in peaks.items() for m in xs], "b int, at int, mz double"),
    ]
    got = sorted(tuple(r) for r in v.allele_competition(*frames, ["b"], "f", 8.0, 5, 10.0, 3.0, 3).collect())
    want = plain_competition(primary, ions, peaks, 8.0, 5, 10.0, 3.0, 3)
    assert [r[:4] + r[6:] for r in got] == [tuple(r[:4]) + tuple(r[6:]) for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want])
    assert any(r[7] for r in want) and any(not r[7] and r[8] for r in want)


def test_chance_scores(spark):
    rng = random.Random(6)
    rows = [(k, round(rng.uniform(100, 500), 2), rng.random(), rng.choice([0.0, 1.0, 5.0]), 7.0 if k % 3 else 0.0, 5 + k % 4, k % 2) for k in range(30) for _ in range(rng.randint(1, 9))]
    back = [(w, m, round(rng.random() / 3, 3)) for w in (0, 1) for m in sorted({r[1] for r in rows if rng.random() < 0.5})]
    df = spark.createDataFrame(rows, "k int, mz double, library double, intensity double, magnitude double, length int, window int")
    got = {r["k"]: r for r in v.chance_scores(df, ["k"], spark.createDataFrame(back, "window int, mass double, frequency double"), 10.0).collect()}
    for k in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == k]
        hit = [r for r in own if r[3] > 0]
        raw = sum(r[2] * r[3] for r in hit)
        expected = sum(min(1.0, sum(f for w, m, f in back if w == r[6] and abs(m - r[1]) <= max(m, r[1]) * 1e-5)) for r in own)
        g = got[k]
        assert (g["raw"], g["similarity"], g["weighted"], g["expected"]) == pytest.approx((raw, raw / 7 if k % 3 else 0.0, sum(r[2] * r[3] * r[1] for r in hit) / sum(r[1] for r in hit) if hit else 0.0, expected))
        assert (g["n_above"], g["n_matched"]) == (sum(r[2] * r[3] > raw / (r[5] + 1) for r in hit), len(hit)) and g["excess"] == pytest.approx(len(hit) - expected)


def test_decoys_are_tried_once_a_sequence(spark):
    """Rows that repeat a sequence add no tries: the rows that meet the background are as many as different sequences make."""
    few = spark.createDataFrame([(k, s) for k in range(4) for s in ("PEPTIDEK", "AAAAK", "LNDSTR", None)], "id int, s string")
    many = few.unionByName(few.withColumn("id", F.col("id") + 4))

    def asked(df):
        out = v.checked_decoys(df, "s", df.select("s"), tries=3)
        rows = {r["id"]: r for r in out.where("s = 'LNDSTR'").collect()}
        assert len({(r["decoy"], r["attempt"]) for r in rows.values()}) == 1 and out.count() == df.count()
        return out._jdf.queryExecution().optimizedPlan().toString()

    assert [asked(d).split("Generate explode")[1].count("Aggregate [s#") for d in (few, many)] == [1, 1]
