"""Components of a bridge against union-find, and the parsimony of a whole bridge against brute force."""

import random
import resource

import pyarrow as pa
import pytest

from peakfold.operators import components, kernels
from peakfold.operators.components import bridge_components
from peakfold.plans import catalog


def least_reached(pairs):
    root = {g: g for _, g in pairs}

    def find(g):
        while root[g] != g:
            g = root[g]
        return g

    first = {}
    for i, g in pairs:
        if i is not None:
            a, b = find(first.setdefault(i, g)), find(g)
            root[max(a, b)] = min(a, b)
    return {g: find(g) for g in root}


@pytest.mark.parametrize("n", [15, 45, 90])
def test_components(spark, n):
    rng = random.Random(n)
    pairs = [(rng.randrange(60), rng.randrange(50)) for _ in range(n)] + [(None, 7), (None, 8), (200, 99)]
    pairs += [(1000 + i, 1000 + j) for i in range(70) for j in (i, i + 1)]
    got = bridge_components(spark.createDataFrame(pairs, "item int, grp int"), "item", "grp").collect()
    assert len(got) == len({r.grp for r in got}) and {r.grp: r.component for r in got} == least_reached(pairs)


def test_components_in_many_steps(spark, monkeypatch):
    """Tasks link a few pairs at once; an item goes on in the next step."""
    rng = random.Random(7)
    pairs = [(f"i{rng.randrange(300)}", f"g{rng.randrange(200):03d}") for _ in range(200)] + [("long", f"h{j:03d}") for j in range(60)] + [(None, "h007"), (None, "k")]
    df = spark.createDataFrame(pairs, "item string, grp string").coalesce(1)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    monkeypatch.setattr(components, "LINKED", 3)
    spark.conf.set(key, "2")
    try:
        got = components.bridge_components(df, "item", "grp").collect()
        links = components._linked(df.selectExpr("item as i", "grp as a")).collect()
    finally:
        spark.conf.set(key, before)
    assert len(got) == len({r.grp for r in got}) and {r.grp: r.component for r in got} == least_reached(pairs)
    assert len(links) > len(got) and all(r.b <= r.a for r in links)


def test_no_pairs(spark):
    assert bridge_components(spark.createDataFrame([], "item int, grp int"), "item", "grp").count() == 0


def greedy(pairs, error):
    sets = {}
    for i, g in pairs:
        sets.setdefault(g, set()).add(i)
    same = {}
    for g in sorted(sets, key=str):
        same.setdefault(frozenset(sets[g]), []).append(str(g))
    left, out = {tuple(v): set(k) for k, v in same.items()}, []
    while True:
        live = [(min(error[i] for i in s), -round(sum(1 - error[i] for i in s), 9), g) for g, s in left.items() if s]
        if not live:
            return sorted(out)
        e, n, _ = min(live, key=lambda x: x[:2])
        g = max(x[2] for x in live if x[:2] == (e, n))
        claimed = left.pop(g)
        out.append((";".join(g), len(claimed), e))
        for s in left.values():
            s -= claimed


def test_parsimony_of_the_whole_bridge(spark, tmp_path):
    """Every order and quantity takes part, and no item is claimed twice, however many orders it is in."""
    rng = random.Random(4)
    rows = [(order, part, 10 * (part // 10) + rng.randrange(8), float(rng.randrange(1, 51)), rng.randrange(0, 11) / 128) for order in range(300) for part in [rng.randrange(40)]]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalog.queries()["parsimony_groups"](spark, str(tmp_path)).collect()
    error = {}
    for _, part, _, _, e in rows:
        error[part] = min(e, error.get(part, e))
    pairs = {(part, supplier) for _, part, supplier, _, _ in rows}
    assert sorted((r.members, r.n_items, r.least_error) for r in got) == greedy(pairs, error)
    assert sum(r.n_items for r in got) == len({part for part, _ in pairs})
    component = least_reached(sorted(pairs))
    assert all({component[int(m)] for m in r.members.split(";")} == {r.component} for r in got)


def worker_mb(spark):
    """The most that any idle Python worker ever held."""

    def most(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"mb": [resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024]})

    return max(r.mb for r in spark.range(0, 64, 1, 64).mapInArrow(most, "mb double").collect())


def test_one_large_component_stays_out_of_memory(spark):
    """A million pairs in one component: the worker that meets it holds numbers for its items and groups, not the pairs."""
    before = worker_mb(spark)
    pairs = spark.range(1_000_000).selectExpr("id div 25 as item", "id * 48271 % 1999 as grp", "id * 7919 % 11 / 128 as error", "0 as component")
    got = kernels.parsimony_groups(pairs, "item", "grp", "error", "component").collect()
    assert sum(r.n_items for r in got) == 40_000
    assert worker_mb(spark) < max(before, 150) + 100


@pytest.mark.parametrize("text", [False, True])
def test_parsimony_of_odd_bridges(spark, text):
    """Pairs that repeat with other errors, items of many groups, equal groups, errors of 1 and above, names whose order isn't that of
    numbers, several components in one task; an item of no known error counts as one of error 1, and null items aren't shared."""
    rng = random.Random(11)
    rows = [(part, rng.randrange(30) + 100 * (part % 3), rng.randrange(0, 11) / 128, part % 3) for part in range(120) for _ in range(8)]
    rows += rows[:100] + [(p, g, 1.5, c) for p, g, _, c in rows[100:200]] + [(p, g, None, c) for p, g, _, c in rows[200:300]]
    rows += [(1000, g, 0.25, 3) for g in range(1000, 2300)] + [(1001, g, 0.125, 3) for g in range(1100, 1900)]
    rows += [(2000, 9000, 1.0, 4), (2001, 9001, 1.0, 5), (2002, 9001, 0.5, 5), (2003, 9002, None, 6), (2004, 9003, None, 7), (2004, 9003, 0.75, 7)]
    nulls = [(None, 9100, 0.5, 8), (None, 9101, 0.5, 9), (2100, 9101, 0.25, 9), (None, 3, 0.125, 0)]
    df = spark.createDataFrame(rows + nulls, "item int, grp int, error double, component int").repartition(7)
    if text:
        df = df.selectExpr("concat('i', item) as item", "concat('g', grp) as grp", "error", "concat('c', component) as component")
    got = kernels.parsimony_groups(df, "item", "grp", "error", "component").collect()
    error, pairs = {}, set()
    for n, (p, g, e, c) in enumerate(rows + nulls):
        key = (c, -n if p is None else p)
        error[key] = min(1.0 if e is None else e, error.get(key, 1.0))
        pairs.add((key, f"g{g}" if text else g))
    want = [x for x in greedy(pairs, error) if x[2] < 1]
    assert sorted((r.members, r.n_items, r.least_error) for r in got) == want
    at = {str(g): c for (c, _), g in pairs}
    assert all({at[m] for m in r.members.split(";")} == {int(str(r.component).lstrip("c"))} for r in got)
    assert [f.name for f in df.schema if f.name == "component"] == [got[0].__fields__[0]]


def test_parsimony_in_many_steps(monkeypatch):
    """Pairs go through files in parts; any size of the parts gives the same groups."""
    rng = random.Random(12)
    pairs = {(rng.randrange(150), f"P{rng.randrange(80)}") for _ in range(900)}
    error = {i: rng.choice([0.0, 0.125, 0.25, -3.5, -1e12]) for i in range(150)}
    members = {}
    for i, g in sorted(pairs):
        members.setdefault(g, set()).add(i)
    for most in (1, 37, 1 << 20):
        monkeypatch.setattr(kernels, "PAIRS", most)
        got = kernels.parsimony(members, error)
        assert sorted((";".join(g), len(s), e) for g, s, e in got) == greedy(pairs, error)
        assert sorted(i for _, s, _ in got for i in s) == sorted({i for i, _ in pairs})
