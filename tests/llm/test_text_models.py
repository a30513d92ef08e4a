"""Operators 1 to 4: held-out accuracy, brute force, odd rows."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from peakfold.llm import decontaminate, langid, pii, toxicity
from peakfold.llm.words import grams, split_words
from tests.llm.conftest import invented

EN, DE = ["the", "and", "tion", "er", "wh", "st"], ["ung", "sch", "ein", "ver", "keit", "ö"]
BAD = ["zorgle", "murkbat", "fuzzark"]


def test_words_are_runs_of_non_space():
    t = [" a  b\tc\n", "", "é x y\u0085z", "\x1c q"]
    codes, ends, words = split_words(pa.array(t, pa.large_string()))
    got = [[words[c] for c in codes[a:z]] for a, z in zip([0, *ends], ends)]
    assert got == [re.findall("[^\x20\x09-\x0d]+", x) for x in t]


def test_grams_of_long_words_and_chunks():
    who, where = grams(["ab", "x" * 100, "ab"], (3,), 1000)
    assert sorted(where[who == 0]) == sorted(where[who == 2]) and set(who) == {0, 1, 2} and (np.diff(who) >= 0).all()


# -- toxicity ----------------------------------------------------------------------------------------------------------


def toxic_corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = invented(rng, rng.choice([10, 60, 400]), EN).split()
        y = int(i % 5 == 0)
        for _ in range(2 * y):
            words[rng.randrange(len(words))] = rng.choice(BAD) + rng.choice(["", "s", "er", "ing", "z"])
        rows.append((i, " ".join(words), y))
    return rows


def test_toxicity_learns_and_generalises():
    rows, held = toxic_corpus(600, 1), toxic_corpus(300, 2)
    model = toxicity.train([t for _, t, _ in rows], np.array([y for *_, y in rows]), 0.2, buckets=1 << 15, steps=200)
    other = toxic_corpus(300, 3)
    seen = lambda rows: model.evidence(*split_words(pa.array([t for _, t, _ in rows], pa.large_string())))
    model = toxicity.calibrated(model, seen(other), np.array([y for *_, y in other]), 0.2, 0.7)
    s = model.scores(seen(held))
    y = np.array([y for *_, y in held])
    assert (s[y == 1] >= 0.7).mean() > 0.95 and (s[y == 0] >= 0.7).mean() < 0.03
    odd = model.scores(model.evidence(*split_words(pa.array(["the zorglez erst", "the wh erst", ""], pa.large_string()))))
    assert odd[0] > 0.7 > odd[1] and odd[2] < 0.5


def test_score_is_the_softmax_of_the_averaged_bag():
    """By loops: a word is the mean of its n-grams' values, a text its best window, the score a logistic curve of that."""
    rng = np.random.default_rng(5)
    model = toxicity.Model(rng.normal(size=512).astype(np.float32), 3, 0.7, -0.2)
    texts = ["ab zorgle, (murk) ab x", "one", "", "a b c d e f g h"]
    got = model.scores(model.evidence(*split_words(pa.array(texts, pa.large_string()))))
    for t, s in zip(texts, got):
        values = []
        for w in t.split():
            _, where = grams(toxicity.plain([w]), toxicity.SIZES, 512)
            values.append(sum(float(model.theta[k]) for k in where) / max(1, len(where)))
        best = max(sum(values[i : i + 3]) / 3 for i in range(max(1, len(values) - 2))) if values else -50
        assert s == pytest.approx(1 / (1 + np.exp(-(0.7 * best - 0.2))), rel=1e-5)


def test_cut_is_that_of_the_largest_f_score():
    e, y = np.array([5.0, 4, 3, 2, 1, 0]), np.array([1, 1, 0, 1, 0, 0])
    model = toxicity.calibrated(toxicity.Model(np.zeros(1, np.float32), 3, 1.0, 0.0), e, y, 0.5, 0.7)
    assert ((model.scores(e) >= 0.7) == (e >= 2)).all() and (np.diff(model.scores(e)) < 0).all()


def test_held_out_rows_teach_nothing(spark):
    """Flipped labels and languages of held-out rows, and other texts with their ids, change no score of the rest."""
    rows = [(i, t, ("en", "de")[i % 3 == 0], "s", y) for i, t, y in toxic_corpus(240, 4)]
    out = lambda i, m, k: zlib.crc32(str(i).encode()) % m == k
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    runs = []
    for poison in (False, True):
        docs = spark.createDataFrame([(i, t, "xx" if poison and out(i, 5, 0) else lang, s) for i, t, lang, s, _ in rows], "doc_id long, text string, lang string, source string")
        labels = spark.createDataFrame([(i, 0, 1 - y if poison and out(i, 3, 1) else y) for i, *_, y in rows], "doc_id long, quality int, toxic int")
        tox = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels, learn % 3 != 1).collect()}
        lang = {r.doc_id: (r.lang_pred, r.score) for r in langid.language_id(docs, learn % 5 != 0).collect()}
        runs.append((tox, lang))
    assert runs[0] == runs[1]


def test_training_rows_and_bytes_are_bounded(spark):
    """A labelled document that is there very often trains once; of each label no more than most_bytes of text do."""
    rows = toxic_corpus(60, 8)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(0, rows[0][1])] * 400 + [(5, "another text of a toxic id")] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    out, share = toxicity.taught(docs, labels, F.lit(True), 1000, 1 << 30)
    got = out.collect()
    assert sorted(r.doc_id for r in got) == list(range(60)) and share == 0.2
    out, _ = toxicity.taught(docs, labels, F.col("doc_id") % 2 == 0, 10, 3000)
    got = out.collect()
    for y in (0, 1):
        mine = [r for r in got if r.y == y]
        assert 0 < len(mine) <= 10 and sum(len(r.text) for r in mine) <= 3000 and all(r.doc_id % 2 == 0 for r in mine)


def test_best_window_is_the_best():
    rng = np.random.default_rng(1)
    v = rng.normal(size=200)
    ends = np.array([0, 3, 3, 50, 200])
    best, at = toxicity.best_windows(v, ends, 6)
    for k, (a, z) in enumerate(zip([0, 0, 3, 3, 50], ends)):
        if z - a > 6:
            want = max(v[i : i + 6].sum() / 6 for i in range(a, z - 5))
        else:
            want = v[a:z].sum() / 6
        assert best[k] == pytest.approx(want) and (at[k] >= 0) == (z > a)


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (3, 1, 0), (8, 0, None), (None, 0, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 5
    rows = toxicity.toxicity(odd, labels, learn).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert toxicity.toxicity(none, labels, learn).count() == 0
    assert toxicity.toxicity(odd, labels.where("1 = 0"), learn).count() == odd.count()


# -- decontamination ---------------------------------------------------------------------------------------------------


def brute_tiles(doc, item, least):
    """Greedy string tiling by looking at every pair of positions."""
    out, fi, fd = [], [True] * len(item), [True] * len(doc)
    while True:
        best, found = least - 1, []
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and fi[i + n] and fd[d + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, d)]
                elif n == best and n >= least:
                    found.append((i, d))
        if best < least:
            return out
        for i, d in found:
            if all(fi[i : i + best]) and all(fd[d : d + best]):
                out.append((i, d, best))
                fi[i : i + best] = [False] * best
                fd[d : d + best] = [False] * best


@pytest.mark.parametrize("seed", range(8))
def test_tiling_matches_brute_force(seed):
    rng = random.Random(seed)
    item = [rng.randint(0, 3) for _ in range(rng.randint(5, 25))]
    doc = [rng.randint(0, 3) for _ in range(30)] + item[5:] + [9] + item[:5]
    assert sorted(decontaminate.tiles(np.array(doc), np.array(item), 3)) == sorted(brute_tiles(doc, item, 3))


def test_one_repeated_word_takes_linear_time():
    import time

    began = time.time()
    for n, m in ((6000, 800), (20_000, 3000)):
        index = decontaminate.index_items([1], ["w " * m], 5)
        (t, i, share, got), = decontaminate.matches(index, *split_words(pa.array(["w " * n], pa.large_string())), 0.5)
        assert (t, i, share, got) == (0, 0, 1.0, [(0, 0, m)])
    doc, item = np.array(([1] * 70 + [2]) * 300), np.array([1] * 500)
    assert sum(x[2] for x in decontaminate.tiles(doc, item, 5)) == 500 and time.time() - began < 5


def test_matches_are_those_of_plain_tiling():
    """Many items and texts at once, against tiling each pair by looking at every pair of places."""
    rng = random.Random(21)
    say = lambda n: [f"w{rng.randint(0, 6)}" for _ in range(n)]
    items = [say(rng.randint(1, 14)) for _ in range(12)] + [["a passage without any spaces"[::1].replace(" ", "")]]
    docs = [say(rng.randint(0, 30)) + rng.choice(items)[rng.randint(0, 3) :] for _ in range(40)] + [["x", "apassagewithoutanyspaces,"], []]
    index = decontaminate.index_items(list(range(len(items))), [" ".join(x) for x in items], 3)
    got = {(t, index.names[i]): (round(c, 9), sorted(g)) for t, i, c, g in decontaminate.matches(index, *split_words(pa.array([" ".join(d) for d in docs], pa.large_string())), 0.6)}
    want = {}
    for t, d in enumerate(docs):
        d = [decontaminate.bare(w) for w in d]
        for i, x in enumerate(items):
            least = min(3, len(x))
            if len(x) >= 3 or sum(map(len, x)) >= decontaminate.SHORT:
                g = brute_tiles(d, x, least)
                if g and sum(k for *_, k in g) >= 0.6 * len(x):
                    want[t, i] = (round(sum(k for *_, k in g) / len(x), 9), sorted(g))
    assert got == want and len(want) > 20


def test_contamination(spark, odd, none):
    rng = random.Random(3)
    item = " ".join(f"b{i}" for i in range(40))
    other = " ".join(f"o{i}" for i in range(30))
    w = item.split()
    docs = spark.createDataFrame([(1, invented(rng, 50, EN) + " " + item.upper() + ". " + invented(rng, 9, EN)), (2, " ".join(w[20:] + ["x"] + w[:20])), (3, " ".join(w[:15])), (4, invented(rng, 80, EN)), (5, None), (6, ""), (7, item + " " + other), (7, item + " " + other)], "doc_id long, text string")
    bench = spark.createDataFrame([(0, item), (1, other), (2, "too short"), (3, None), (4, ""), (None, other)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (round(r.coverage, 3), r.n_tiles) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1, 0): (1.0, 1), (2, 0): (1.0, 2), (7, 0): (1.0, 1), (7, 1): (1.0, 1), (7, None): (1.0, 1)}
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()) == [3, 4, 5, 6]
    assert decontaminate.decontaminate(odd, bench).count() == odd.count() and decontaminate.decontaminate(odd, bench).columns == odd.columns
    assert decontaminate.contaminated(none, bench).count() == 0 and decontaminate.decontaminate(docs, bench.where("1 = 0")).count() == 8


def test_benchmark_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    items = [(i, " ".join(f"i{i}w{k}" for k in range(12))) for i in range(20)]
    docs = spark.createDataFrame([(i, "x " + t + " y") for i, t in items] + [(99, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == {(i, i) for i in range(20)}
    assert [r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()] == [99]


# -- personal data -----------------------------------------------------------------------------------------------------

BASE = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(text):
    out = []
    for k, p in enumerate(BASE):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            if (k == 1 and any(int(x) > 255 for x in m.group().split("."))) or (k == 2 and not (16 <= len(d) <= 19 and pii.luhn(d))) or (k == 3 and not 8 <= len(d) <= 15):
                continue
            out.append((k, *m.span()))
    return sorted(out)


def test_base_spans_match_the_patterns():
    rng = random.Random(2)
    bits = ["1", "25", "4111111111111111", "4111 1111-1111 1111", ".", "@", "a", "b.c", "+", "-", " ", "(", ")", "1.2.3.4", "256.1.1.1", "é", "+1 (5", "555-1234", "0", "@x.y"]
    for _ in range(20000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        assert sorted(pii.base_spans(t)) == plain_spans(t), t


def test_long_texts_take_linear_time():
    import time

    began = time.time()
    for t in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+1(" * 100_000, "a@" * 150_000, "1 " * 150_000):
        pii.base_spans(t)
    assert time.time() - began < 5


def test_field_adds_repeated_mentions(spark, odd, none):
    rng = random.Random(4)
    texts = [f"{invented(rng, 9, EN)} u{i}.{i}@mail.com +1 (555) {200 + i}-{1000 + i} {invented(rng, 9, EN)} 10.0.{i % 250}.7" for i in range(120)]
    crf = pii.train(texts)
    t = "Call +1 (644) 555-7859 or 16445557859 now; mail jo.smith7@x.org, not the tion 42 of contact@x.com or contact."
    base = pii.base_spans(t)
    more = [(pii.KINDS[k], t[a:b]) for k, a, b in pii.added_spans(t, base, crf, 0.9)]
    assert ("phone", "16445557859") in more and not any("contact" in s or s == "42" for _, s in more)
    rows = pii.find(odd, crf).collect()
    assert len(rows) == odd.count()
    r = next(r for r in rows if r.doc_id == 12)
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 0, 1) and r.spans == "email:26:32,ip:0:7,phone:8:25"
    assert pii.personal_data(none).count() == 0


def test_field_finds_planted_mentions():
    """What no pattern finds, planted beside a base mention of the same person or repeated; and what must not be marked."""
    rng = random.Random(9)
    said = lambda n: invented(rng, n, EN)
    person = lambda i: (f"{rng.choice(EN)}.{rng.choice(EN)}{i}", f"{rng.choice(EN)}{i}", rng.choice(["com", "org"]))
    phone = lambda: (rng.randint(200, 999), rng.randint(200, 999), rng.randint(1000, 9999))
    train = []
    for i in range(400):
        (u, h, z), (a, b, c) = person(i), phone()
        train.append(f"{said(8)} {u}@{h}.{z} {said(5)} +1 {a}-{b}-{c} {said(3)} 10.0.{i % 250}.7 in {rng.randint(1900, 2030)} no {rng.randint(1, 99)} {said(4)} {a}.{c} x{i} {rng.randint(10**5, 10**6)}")
    crf = pii.train(train)
    found = missed = false = 0
    for i in range(300):
        (u, h, z), (a, b, c) = person(i), phone()
        base = f"{u}@{h}.{z} {said(3)} +1 {a}-{b}-{c}"
        planted = [f"{u} at {h} dot {z}", f"{u}[at]{h}[dot]{z}", f"1{a}{b}{c}", f"{a} {b} {c}", f"({a}) {b}-{c}"]
        t = f"{said(5)} {base} {said(9)} " + f" {said(4)} ".join(planted) + f" {said(3)} in {rng.randint(1900, 2030)} no {rng.randint(1, 99)} v{i}.2 {rng.randint(10**5, 10**6)} look at it on dot two"
        want = set(planted)
        got = {t[x:y] for _, x, y in pii.added_spans(t, pii.base_spans(t), crf, 0.8)}
        found += len(want & got)
        missed += len(want - got)
        false += len(got - want)
    assert found >= 0.9 * (found + missed) and false <= 0.02 * found, (found, missed, false)


def test_message_passing_on_a_tree_is_exact():
    rng = np.random.default_rng(1)
    n = 5
    f = pii.Field(rng.normal(size=(pii.FEATURES, pii.LABELS)), np.zeros((pii.LABELS, pii.LABELS)), 1.3)
    f.chain = (lambda m: m + m.T)(rng.normal(size=(pii.LABELS, pii.LABELS)))
    edges, kinds = np.array([[0, 1], [1, 2], [1, 3], [3, 4]]), np.array([0, 1, 1, 0])
    nodes = [[int(x)] for x in rng.integers(0, pii.FEATURES, n)]
    clamped = np.array([-1, -1, 2, -1, -1])
    beside = np.array([0, 2, 0, 1, 0])
    got = f.posterior(nodes, beside, clamped, edges, kinds, rounds=200)
    want = np.zeros((n, pii.LABELS))
    for y in np.ndindex(*[pii.LABELS] * n):
        if y[2] == 2:
            e = sum(f.unary[nodes[i][0], y[i]] + beside[i] * f.chain[0, y[i]] for i in range(n)) + sum(f.chain[y[a], y[b]] if k == 0 else f.agree * (y[a] == y[b]) for (a, b), k in zip(edges, kinds))
            for i in range(n):
                want[i, y[i]] += np.exp(e)
    assert np.allclose(got, want / want.sum(1, keepdims=True), atol=1e-3)


def test_language_training_is_bounded(spark):
    """Rows of one doc_id count once, and long texts stop at the bytes that are given; the model is that of what is left."""
    rows = [(7, "the cat sat on the mat " * 5, "en")] * 3000 + [(7, "another text", "en")] + [(k, f"der hund und die katze {k} " * 400, "de") for k in range(100, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = langid.fit(docs, F.lit(True), most=8000, most_bytes=200_000)
    hashed = {r[1]: r[0] for r in docs.where("lang = 'de'").select(F.xxhash64("doc_id"), "doc_id").distinct().collect()}
    size, left = 0, []
    for k in sorted(hashed, key=lambda d: (hashed[d], d)):
        if size < 100_000:
            left.append(k)
        size += len(f"der hund und die katze {k} " * 400)
    assert 5 < len(left) < 15
    want = langid.train([f"der hund und die katze {k} " * 400 for k in sorted(left)] + ["another text"], ["de"] * len(left) + ["en"])
    assert m.langs == want.langs and all(np.array_equal(a, b) for a, b in zip(vars(m).values(), vars(want).values()) if isinstance(a, np.ndarray))


def test_short_items_are_whole_runs_of_words(spark):
    """With no least length of items, items of one to four words are found between word boundaries, in any number of documents."""
    bench = spark.createDataFrame([(1, "alpha"), (2, "beta, gamma"), (3, "x y z"), (4, " .\n"), (5, ""), (6, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "an Alpha b"), (2, "alphabet"), (3, "beta gamma"), (4, "beta x gamma"), (5, "w x y z"), (6, "x y"), (7, "gamma beta"), (8, None), (9, "beta") ], "doc_id long, text string")
    got = decontaminate.contaminated(docs, bench, seed=5, threshold=0.5, short=0).select("doc_id", "item_id").collect()
    assert sorted(map(tuple, got)) == [(1, 1), (3, 2), (5, 3)]
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench, short=0).collect()) == [2, 4, 6, 7, 8, 9]
    assert decontaminate.contaminated(docs, bench).count() == 0


def test_added_spans_pass_the_checks_of_their_kind():
    """Numbers of 16 digits that fail the check digit, repeated and side by side, are never added, whatever the field says; a
    valid one beside another is."""
    rng = random.Random(7)
    number = lambda ok: next(d for d in ("".join(rng.choice("0123456789") for _ in range(16)) for _ in range(10_000)) if pii.luhn(d) == ok)
    unary = np.zeros((pii.FEATURES, pii.LABELS))
    for kind in range(4):
        unary[:] = 0
        unary[0, 1 + kind] = 9.0  # a field that takes every node for this kind
        f = pii.Field(unary, np.zeros((pii.LABELS, pii.LABELS)), 3.0)
        bad, good = number(False), number(True)
        t = f"no {bad} and {bad} {bad}, {bad[:4]}-{bad[4:8]}-{bad[8:12]}-{bad[12:]} x{bad} 1.2.3.400 1.2.3 {good} {good} 12 1234567890123456789012 a@b jo at x dot org 644-555-7859"
        got = [t[a:b] for _, a, b in pii.added_spans(t, pii.base_spans(t), f, 0.5)]
        assert not [x for x in got if bad in x.replace("-", "")]
        assert got == {0: ["jo at x dot org"], 1: [], 2: got, 3: ["644-555-7859"]}[kind]
        assert all(pii.luhn("".join(c for c in x if c.isdigit())) for x in got if kind == 2)


def test_field_covers_the_text():
    """Nodes without any base span; words are observed; repeated tokens share an edge; a number in several tokens is one node."""
    t = "Call 644-555-7859 then (644-555-7859), or 644 555 7859; x7 a1, jo at x dot org 7"
    assert pii.base_spans(t) == []
    spans, labels, edges, kinds, beside = pii.graph(t, [])
    said = [t[a:b] for a, b in spans]
    assert said == ["644-555-7859", "644-555-7859", "644 555 7859", "x7", "a1", "jo at x dot org", "7"]
    assert {tuple(e) for e, k in zip(edges.tolist(), kinds) if k == 1} == {(0, 1), (1, 2)}
    assert {tuple(e) for e, k in zip(edges.tolist(), kinds) if k == 0} == {(2, 3), (3, 4), (4, 5), (5, 6)} and (labels == 0).all()
    assert beside.tolist() == [2, 2, 1, 0, 0, 0, 0]
    assert pii.traits("jo.smith at x dot org") == pii.traits("jo.smith@x.org") == pii.traits("jo.smith [at] x[dot]org") and pii.traits("at dot") == pii.traits("at dot")


    unary = np.zeros((pii.FEATURES, pii.LABELS))
    unary[0, 0], unary[11, 4] = 4.0, 5.0  # ten digits speak for a phone number, not enough alone
    alone, together = "tell 644-555-7859 now", "tell 644-555-7859 now 644-555-7859 and 644 555 7859"
    f = pii.Field(unary, np.zeros((pii.LABELS, pii.LABELS)), 3.0)
    assert pii.added_spans(alone, [], f, 0.9) == []
    assert [together[a:b] for k, a, b in pii.added_spans(together, [], f, 0.9) if k == 3] == ["644-555-7859", "644-555-7859", "644 555 7859"]
    assert list(pii.all_added_spans([(alone, []), ("", []), (together, [])], f, 0.9, most=1)) == list(pii.all_added_spans([(alone, []), ("", []), (together, [])], f, 0.9))


def test_messages_reach_far_mentions():
    n, agree = 120, 8.0
    f = pii.Field(np.zeros((pii.FEATURES, pii.LABELS)), np.zeros((pii.LABELS, pii.LABELS)), agree)
    edges = np.array([[i, i + 1] for i in range(n)])
    p = f.posterior([[0]] * (n + 1), np.zeros(n + 1, int), np.array([4] + [-1] * n), edges, np.ones(n, int))
    keep = (np.exp(agree) - 1) / (np.exp(agree) + pii.LABELS - 1)
    assert np.allclose(p[:, 4], [1 / pii.LABELS + (1 - 1 / pii.LABELS) * keep**k for k in range(n + 1)], atol=1e-3)


# -- languages ---------------------------------------------------------------------------------------------------------


def brute_viterbi(score, penalty):
    best = (-1e18, None)
    for y in np.ndindex(*[score.shape[1]] * len(score)):
        v = sum(score[i, s] for i, s in enumerate(y)) - penalty * sum(a != b for a, b in zip(y, y[1:]))
        if v > best[0] + 1e-9:
            best = (v, y)
    return best[0]


def test_viterbi_is_optimal():
    rng = np.random.default_rng(2)
    ends = np.array([0, 6, 6, 7, 12])
    score = rng.normal(size=(12, 3)) * 3
    label = langid.viterbi(score.astype(np.float32), ends, 2.0)
    for a, z in zip([0, 0, 6, 6, 7], ends):
        if z > a:
            y = label[a:z]
            v = sum(score[a + i, s] for i, s in enumerate(y)) - 2.0 * (y[1:] != y[:-1]).sum()
            assert v == pytest.approx(brute_viterbi(score[a:z], 2.0), abs=1e-4)


@pytest.fixture(scope="module")
def model():
    rng = random.Random(6)
    texts = [(invented(rng, 50, EN), "en") for _ in range(60)] + [(invented(rng, 50, DE), "de") for _ in range(60)] + [(invented(rng, 50, ["да", "нет", "при", "вет"]), "ru") for _ in range(20)]
    return langid.train([t for t, _ in texts], [k for _, k in texts])


def test_languages_and_spans(model):
    rng = random.Random(7)
    texts = [invented(rng, 30, EN), invented(rng, 30, DE), invented(rng, 30, ["да", "нет", "при"]), "", "123 !!", invented(rng, 20, EN) + " " + invented(rng, 40, DE)]
    lang, score, _ = langid.predict(model, pa.array(texts, pa.large_string()))
    assert lang == ["en", "de", "ru", "und", "und", "de"] and (score[:3] > 0.95).all() and score[3] == score[4] == 0 and 0.5 < score[5] < 0.9
    s = langid.spans(model, texts[5])
    assert [x[0] for x in s] == ["en", "de"] and 17 <= s[0][2] <= 23
    assert langid.spans(model, None) == []


def test_other_languages_and_noise_go(spark):
    """Clean texts of two languages, mixed ones too, stay; planted texts of another language, another script and noise go."""
    rng = random.Random(11)
    other = ["zi", "ocz", "nik", "wsk", "ła", "prz", "ow"]
    noise = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 9))) for _ in range(n))
    clean = [(invented(rng, rng.choice([4, 20, 200]), stems), k) for k, stems in (("en", EN), ("de", DE)) for _ in range(400)]
    clean += [(invented(rng, 20, EN) + " " + invented(rng, 30, DE), "de") for _ in range(20)]
    bad = [invented(rng, 20, other) for _ in range(30)] + [noise(20) for _ in range(30)] + [invented(rng, 20, ["да", "нет", "при"]) for _ in range(20)] + ["".join(rng.choice("0123456789abcdef") for _ in range(400)) for _ in range(10)] + ["12 !!", ""]
    rows = [(i, t, k) for i, (t, k) in enumerate(clean)] + [(10_000 + i, t, None) for i, t in enumerate(bad)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    kept = {r.doc_id for r in langid.keep_identified(df, langid.fit(df, F.lit(True), 4000, normal=True)).collect()}
    assert len([i for i in kept if i < 10_000]) >= len(clean) - 1
    # Noise of hexadecimal digits is one word, too little to tell.
    gone = [t for i, t, _ in rows if i >= 10_000 and i not in kept]
    assert len(gone) >= len(bad) - 10 and {t for i, t, _ in rows if i >= 10_000 and i in kept} <= set(bad[80:90])


def test_many_languages_keep_a_bounded_table():
    rng = random.Random(12)
    langs = [f"l{k:03d}" for k in range(130)]
    m = langid.train([invented(rng, 5, [k, "a", "b"]) for k in langs], langs)
    assert m.score.nbytes <= 32 << 20 and langid.predict(m, pa.array(["l007l007 l007a"], pa.large_string()))[0] == ["l007"]
    assert langid.train([], []).langs == []


def test_language_of_odd_rows(spark, odd, none):
    rows = langid.language_id(odd, F.lit(True)).collect()
    assert len(rows) == odd.count() and {r.lang_pred for r in rows} <= {"en", "de", "fr", "und"} and all(0 <= r.score <= 1 for r in rows)
    assert all((r.lang_pred == "und") == (r.score == 0) for r in rows)
    assert langid.language_id(none, F.lit(True)).count() == 0
    assert {r.lang_pred for r in langid.language_id(odd.withColumn("lang", F.lit(None).cast("string")), F.lit(True)).collect()} == {"und"}
    kept = langid.keep_identified(odd, langid.fit(odd, F.lit(True), 100, normal=True))
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {1, 2, 3, 8, 10, 11} and kept.where("text is null or trim(text) = ''").count() == 0
