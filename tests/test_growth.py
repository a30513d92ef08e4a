"""Steps whose work must grow no faster than their input."""

import random

from pyspark.sql import functions as F

from peakfold.operators import joins
from peakfold.operators import kernels as k
from peakfold.plans import catalog
from tests.conftest import SF


def built(df):
    """Sides of the plan's broadcast joins."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [side for side in ("BuildLeft", "BuildRight") for _ in range(plan.count(side))]


def test_kmers_are_not_broadcast(spark):
    pieces = spark.range(1000).select(F.concat(F.lit("abcde"), "id").alias("piece"), *[F.repeat(F.lit("x"), F.col("id").cast("int")).alias(f"c{i}") for i in range(9)])
    whole = spark.range(200).select(F.concat(F.lit("zabcde"), "id").alias("whole"))
    got = joins.substring_join(pieces, whole, "piece", "whole")
    assert built(got) == ["BuildLeft"]
    assert sorted((r.piece, r.whole, r.position) for r in got.collect()) == sorted((f"abcde{p}", f"zabcde{w}", 1) for p in range(1000) for w in range(200) if str(w).startswith(str(p)))


def test_far_texts_do_not_meet(spark):
    """Rows of equal and of near texts, all alike in their first half: what a plan's joins give is not much more than the pairs."""
    rng = random.Random(3)
    rows = [(i, f"000{rng.randrange(10000):04d}") for i in range(1500)] + [(1500 + i, "0007777") for i in range(30)] + [(2000, None), (2001, "77")]
    got = joins.similar_sequences(spark.createDataFrame(rows, "id long, x string"), "id", "x", 1, 2)
    pairs = sorted(tuple(r) for r in got.collect())
    near = lambda a, b: sum(p != q for p, q in zip(a, b))
    live = [r for r in rows if r[1]]
    assert pairs == sorted((a, b, near(x, y)) for a, x in live for b, y in live if a < b and len(x) == len(y) and near(x, y) <= 1)
    keys = joins.near_keys(spark.createDataFrame(sorted({r[1] for r in live}), "string").withColumnRenamed("value", "__c"), 1, 2)
    met = keys.groupBy("__len", "__k", "__rest").count().agg(F.sum(F.expr("count * (count - 1) / 2"))).first()[0]
    assert met == len({(x, y) for _, x in live for _, y in live if x < y and len(x) == len(y) and near(x, y) == 1})


def test_many_pairs_are_dealt_out(spark, tmp_path):
    """Tasks follow the rows, though the rows' bytes would fit in one."""
    spark.range(45_000).select(F.col("id").alias("p_partkey"), (900 + F.col("id") % 1000 / 10).alias("p_retailprice"), (F.col("id") % 50).cast("int").alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    got = catalog.queries()["band_join"](spark, str(tmp_path))
    assert got.rdd.getNumPartitions() == 5
    assert built(got) == []


def test_parsimony_looks_at_an_item_a_few_times():
    class Counted(dict):
        looks = 0

        def __getitem__(self, key):
            Counted.looks += 1
            return dict.__getitem__(self, key)

    rng = random.Random(5)
    error = Counted({i: rng.randrange(11) / 100 for i in range(2000)})
    members = {str(g): set(rng.sample(range(2000), 20)) for g in range(400)}
    got = k.parsimony(members, error)
    assert sorted(i for _, s, _ in got for i in s) == sorted(set().union(*members.values()))
    assert Counted.looks < 10 * 400 * 20


def test_equal_values_are_ordered_once(spark):
    """Windows of the error rates see different values, not rows."""
    from peakfold.operators import statistics as st

    df = spark.range(20_000).select((F.col("id") % 2).alias("g"), (F.col("id") % 7 / 8).alias("p"), (F.col("id") % 3 == 0).alias("decoy"))
    for got in (st.benjamini_hochberg(df, ["g"], "p"), st.tdc_q_values(df, ["g"], "p", F.col("decoy"))):
        assert got.count() == 20_000
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate [g#" in plan.rsplit("Window [", 1)[1]


def test_streams_hold_no_result_on_the_driver(spark):
    """Rows come from files, not from a table in the driver's memory."""
    for name in ("stream_session", "stream_cycles", "stream_window_agg"):
        plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "MemoryPlan" not in plan and "parquet" in plan, name


def test_dense_tables_are_not_broadcast(spark):
    """Users times days times types are laid out from a small table, and no join builds them on the driver."""
    assert built(catalog.queries()["allele_competition"](spark, SF)) == []
