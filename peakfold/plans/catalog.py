"""Named queries over the test tables, each with the SQL that gives the same rows.

`query(sql)` registers a function under its name.  Float results are rounded on both sides, since sums add up in another
order.  Events stand in for scans (ts as time, value as intensity, user as trace), parts and orders for precursors and
windows, lineitem's part-supplier pairs for the member-group bridge, embeddings for spectra.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakfold.functions import arrays as A
from peakfold.functions import chemistry as chem
from peakfold.functions import sequences as seq
from peakfold.operators import aggregates as agg
from peakfold.operators import generators as gen
from peakfold.operators import joins, kernels, scans, setops
from peakfold.operators import statistics as st
from peakfold.operators import windows as win
from peakfold.operators.components import bridge_components
from peakfold.operators.running import ranges_for, running

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from peakfold.plans import catalog_more, catalog_quant  # noqa: F401
    from peakfold.streaming import queries as streaming

    return QUERIES | streaming.QUERIES


def oracle_sql() -> dict[str, str]:
    from peakfold.plans import catalog_more, catalog_quant  # noqa: F401
    from peakfold.streaming import queries as streaming

    return SQL | streaming.SQL


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def seconds(c="ts"):
    """Microsecond time stamps as whole seconds since 1970."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})")


def micros(c="ts"):
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})") / 1e6


# -- 1 scans, filters, projections -------------------------------------------------------------------------------------


@query("""
SELECT event_id, user_id, value FROM events WHERE value - 5 <= 100 AND value + 5 >= 100
""")
def window_scan(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", "value", (F.col("value") - 5).alias("lo"), (F.col("value") + 5).alias("hi"))
    return scans.covering(e, 100.0, "lo", "hi").select("event_id", "user_id", "value")


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice <= 1000 AND p_retailprice + p_size >= 950")
def interval_overlap(spark, d):
    p = t(spark, d, "part").select("p_partkey", "p_retailprice", (F.col("p_retailprice") + F.col("p_size")).alias("hi"))
    return scans.overlapping(p, 950.0, 1000.0, "p_retailprice", "hi").drop("hi")


@query("SELECT event_id, user_id, event_type FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-06 00:00:00'")
def rt_slice(spark, d):
    lo, hi = (F.lit(x).cast("timestamp") for x in ("2024-01-05 00:00:00", "2024-01-06 00:00:00"))
    return scans.between(t(spark, d, "events"), "ts", lo, hi).select("event_id", "user_id", "event_type")


@query("SELECT p_partkey, p_brand, p_type FROM part WHERE p_brand IN ('Brand#1', 'Brand#2') OR p_type IN ('SMALL')")
def library_subset(spark, d):
    return scans.subset(t(spark, d, "part").select("p_partkey", "p_brand", "p_type"), p_brand=["Brand#1", "Brand#2"], p_type=["SMALL"])


@query("""
SELECT l_suppkey, bin, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM (
  SELECT l_suppkey, CAST(floor(l_quantity / 10) AS BIGINT) AS bin, l_extendedprice,
    row_number() OVER (PARTITION BY l_suppkey, floor(l_quantity / 10) ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS r
  FROM lineitem) WHERE r <= 10 GROUP BY 1, 2
""")
def topn_per_bin(spark, d):
    x = scans.top_per_bin(t(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice", 10, 10, ["l_orderkey", "l_linenumber", "l_partkey"])
    return x.groupBy("l_suppkey", F.floor(F.col("l_quantity") / 10).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("SELECT e.* FROM (SELECT event_id, user_id FROM events) e WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) >= 70)")
def window_guard(spark, d):
    return scans.enough_rows(t(spark, d, "events").select("event_id", "user_id"), ["user_id"], 70)


@query("""
SELECT count(*) AS scans, max(epoch_us(ts)) // 1000000 AS last_second, round(sum(value), 2) AS tic, min(value) AS least, max(value) AS most FROM events
""")
def file_totals(spark, d):
    return t(spark, d, "events").agg(F.count(F.lit(1)).alias("scans"), F.max(seconds()).alias("last_second"), F.round(F.sum("value"), 2).alias("tic"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("""
SELECT event_id, CASE WHEN value > 0 AND q / value < 0.25 THEN 0.0 ELSE value END AS gated FROM (
  SELECT event_id, value, CAST(event_id % 7 AS DOUBLE) AS q FROM events)
""")
def evidence_gate(spark, d):
    return t(spark, d, "events").select("event_id", scans.gate(F.col("value"), (F.col("event_id") % 7).cast("double")).alias("gated"))


@query("""
WITH x AS (SELECT user_id, event_id, value, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
c AS (SELECT user_id, count(*) / 2.0 AS centre FROM events GROUP BY 1),
r AS (SELECT x.*, c.centre, sum(CASE WHEN value < 20 THEN 1 ELSE 0 END) OVER (PARTITION BY x.user_id ORDER BY i) AS run FROM x JOIN c USING (user_id)),
n AS (SELECT user_id, arg_min(run, (abs(i - centre), i)) AS run, arg_min(value, (abs(i - centre), i)) AS v FROM r GROUP BY 1)
SELECT r.user_id, r.event_id FROM r JOIN n USING (user_id) WHERE r.value >= 20 AND n.v >= 20 AND r.run = n.run
""")
def rt_island(spark, d):
    from pyspark.sql import Window

    e = t(spark, d, "events").withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("ts"))).withColumn("centre", F.count(F.lit(1)).over(Window.partitionBy("user_id")) / 2)
    return scans.island_around(e, ["user_id"], "i", F.col("centre"), "value", 20).select("user_id", "event_id")


# -- 2 joins -----------------------------------------------------------------------------------------------------------


@query("""
SELECT w.start, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders o JOIN (SELECT CAST(i * 5000 AS DOUBLE) AS start, CAST(i * 5000 + 6000 AS DOUBLE) AS stop FROM range(0, 120) r(i)) w
ON o.o_totalprice >= w.start AND o.o_totalprice <= w.stop GROUP BY 1
""")
def range_join(spark, d):
    w = spark.range(120).select((F.col("id") * 5000).cast("double").alias("start"), (F.col("id") * 5000 + 6000).cast("double").alias("stop"))
    j = joins.range_join(t(spark, d, "orders").select("o_totalprice"), w, "o_totalprice", "start", "stop", 6000.0)
    return j.groupBy("start").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b
ON abs(a.p_retailprice - b.p_retailprice) <= greatest(a.p_retailprice, b.p_retailprice) * 150e-6 AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey
""")
def band_join(spark, d):
    p = t(spark, d, "part")
    a = p.select(F.col("p_partkey").alias("a"), F.col("p_retailprice").alias("pa"), F.col("p_size").alias("sa"))
    b = p.select(F.col("p_partkey").alias("b"), F.col("p_retailprice").alias("pb"), F.col("p_size").alias("sb"))
    return joins.band_join(a, b, "pa", "pb", 150, (F.col("sa") == F.col("sb")) & (F.col("a") < F.col("b")), deal=(ranges_for(p, 10_000), ["sa"], ["sb"])).select("a", "b")


@query("""
SELECT p_partkey FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size = 7 AND abs(a.p_retailprice - b.p_retailprice) <= greatest(a.p_retailprice, b.p_retailprice) * 200e-6)
""")
def anti_band(spark, d):
    p = t(spark, d, "part")
    return joins.band_anti(p.select("p_partkey", "p_retailprice"), p.where("p_size = 7").select(F.col("p_retailprice").alias("pb")), "p_retailprice", "pb", 200).select("p_partkey")


@query("""
WITH l AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS x FROM events WHERE event_type = 'purchase'),
r AS (SELECT event_id AS rid, user_id, epoch_us(ts) / 1e6 AS x FROM events WHERE event_type = 'click')
SELECT l.event_id, (SELECT r.rid FROM r WHERE r.user_id = l.user_id ORDER BY abs(r.x - l.x), r.x LIMIT 1) AS near_rid FROM l
""")
def nearest_asof_join(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", "event_type", micros().alias("x"))
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "x")
    right = e.where("event_type = 'click'").select(F.col("event_id").alias("rid"), "user_id", "x")
    return joins.asof_nearest(left, right, ["user_id"], "x", ["rid"]).select("event_id", "near_rid")


@query("""
SELECT p_partkey, string_agg(CAST(s AS VARCHAR), ';' ORDER BY CAST(s AS VARCHAR)) AS accessions FROM part
LEFT JOIN (SELECT DISTINCT l_partkey, l_suppkey AS s FROM lineitem WHERE l_returnflag <> 'R') ON p_partkey = l_partkey GROUP BY 1
""")
def left_accession_rollup(spark, d):
    b = t(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").cast("string").alias("s"), "l_returnflag")
    return joins.left_rollup(t(spark, d, "part").select("p_partkey"), b, ["p_partkey"], "p_partkey", "s", F.col("l_returnflag") != "R")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount >= 0.1)")
def semi_passing(spark, d):
    ids = t(spark, d, "lineitem").where("l_discount >= 0.1").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.passing(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), ids, ["o_orderkey"])


@query("""
WITH x AS (SELECT l_partkey, l_suppkey % 8 AS run, max(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2)
SELECT a.run AS run_a, b.run AS run_b, count(*) AS anchors, round(sum(b.v - a.v), 2) AS shift FROM x a JOIN x b USING (l_partkey) WHERE a.run < b.run GROUP BY 1, 2
""")
def anchor_self_join(spark, d):
    x = t(spark, d, "lineitem").groupBy("l_partkey", (F.col("l_suppkey") % 8).alias("run")).agg(F.max("l_extendedprice").alias("v"))
    return joins.anchors(x, "l_partkey", "run", "v").groupBy("run_a", "run_b").agg(F.count(F.lit(1)).alias("anchors"), F.round(F.sum(F.col("value_b") - F.col("value_a")), 2).alias("shift"))


@query("""
SELECT DISTINCT a.p_name AS piece, b.c_name AS whole FROM (SELECT DISTINCT substr(c_name, 10, 6) AS p_name FROM customer) a JOIN customer b ON contains(b.c_name, a.p_name) WHERE length(a.p_name) >= 6
""")
def substring_join(spark, d):
    c = t(spark, d, "customer")
    return joins.substring_join(c.select(F.substring("c_name", 10, 6).alias("piece")).distinct(), c.select(F.col("c_name").alias("whole")), "piece", "whole", 6).select("piece", "whole").distinct()


@query("""
WITH s AS (SELECT c_custkey AS id, substr(c_name, 12) AS x FROM customer)
SELECT a.id AS id_a, b.id AS id_b, CAST(hamming(a.x, b.x) AS INTEGER) AS mismatches FROM s a JOIN s b ON a.id < b.id AND length(a.x) = length(b.x) AND hamming(a.x, b.x) <= 1
""")
def similar_sequences(spark, d):
    s = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.substring("c_name", 12, 100).alias("x"))
    return joins.similar_sequences(s, "id", "x", most=1, blocks=2)


@query("""
SELECT o.o_orderkey, l.l_partkey FROM orders o JOIN (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem) l ON o.o_orderkey = l.l_orderkey AND r = 1
""")
def first_match(spark, d):
    look = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return joins.first_match(t(spark, d, "orders").select("o_orderkey"), look, ["o_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).select("o_orderkey", "l_partkey")


# -- 3 aggregates ------------------------------------------------------------------------------------------------------


@query("""
SELECT l_returnflag, count(l_extendedprice) AS n, round(sum(l_extendedprice), 2) AS total, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS stdev,
  round(var_pop(l_extendedprice) / 1e6, 4) AS variance, min(l_extendedprice) AS least, max(l_extendedprice) AS most FROM lineitem GROUP BY 1
""")
def summary_stats(spark, d):
    s = agg.summary(t(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return s.select("l_returnflag", "n", F.round("total", 2).alias("total"), F.round("mean", 4).alias("mean"), F.round("stdev", 4).alias("stdev"), F.round(F.col("variance") / 1e6, 4).alias("variance"), "least", "most")


@query("""
SELECT user_id, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, round(quantile_cont(value, 0.95) - quantile_cont(value, 0.05), 6) AS range90 FROM events GROUP BY 1
""")
def interp_quantiles(spark, d):
    return agg.quantiles(t(spark, d, "events"), ["user_id"], "value").select("user_id", *[F.round(c, 6).alias(c) for c in ("median", "iqr", "range90")])


@query("""
SELECT l_partkey, l_orderkey, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey) AS r FROM lineitem) WHERE r = 1
""")
def best_per_key(spark, d):
    return agg.best_per_key(t(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_extendedprice"), ["l_partkey"], "l_extendedprice", [F.col("l_orderkey")])


@query("""
SELECT p_brand, round(sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice ELSE 0 END), 2) AS A, round(sum(CASE WHEN l_returnflag = 'N' THEN l_extendedprice ELSE 0 END), 2) AS N,
  round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END), 2) AS R FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1
""")
def intensity_matrix(spark, d):
    x = t(spark, d, "lineitem").select("l_partkey", "l_returnflag", "l_extendedprice").join(t(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    m = agg.intensity_matrix(x, "p_brand", "l_returnflag", "l_extendedprice", ["A", "N", "R"])
    return m.select("p_brand", *[F.round(c, 2).alias(c) for c in "ANR"])


@query("""
WITH s AS (SELECT l_suppkey, sum(l_extendedprice) AS tic FROM lineitem GROUP BY 1), m AS (SELECT avg(tic) AS m FROM s)
SELECT l_suppkey, l_returnflag, round(sum(l_extendedprice / tic * m), 2) AS normalized FROM lineitem JOIN s USING (l_suppkey), m GROUP BY 1, 2
""")
def tic_normalize(spark, d):
    x = agg.tic_normalize(t(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_extendedprice"), "l_suppkey", "l_extendedprice")
    return x.groupBy("l_suppkey", "l_returnflag").agg(F.round(F.sum("normalized"), 2).alias("normalized"))


@query("""
WITH o AS (SELECT l_partkey, l_suppkey % 4 AS s, l_linenumber % 3 AS r, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3),
p AS (SELECT l_partkey, s, stddev_pop(v) / avg(v) AS cv, count(*) FILTER (v > 0) >= 3 AS f FROM o GROUP BY 1, 2)
SELECT l_partkey, round(avg(cv), 6) AS cv, bool_or(f) AS fully_measured, count(*) AS samples FROM p GROUP BY 1
""")
def replicate_cv(spark, d):
    x = t(spark, d, "lineitem").select("l_partkey", (F.col("l_suppkey") % 4).alias("s"), (F.col("l_linenumber") % 3).alias("r"), "l_quantity")
    return agg.replicate_cv(x, ["l_partkey"], "s", "r", "l_quantity", 3).withColumn("cv", F.round("cv", 6))


@query("""
WITH m AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), u AS (SELECT l_orderkey, min(l_suppkey) AS l_suppkey FROM m GROUP BY 1 HAVING count(*) = 1),
v AS (SELECT l_orderkey, sum(l_extendedprice) AS x FROM lineitem GROUP BY 1)
SELECT l_suppkey, round(sum(x), 2) AS total, count(*) AS members FROM u JOIN v USING (l_orderkey) GROUP BY 1
""")
def unique_rollup(spark, d):
    x = t(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    return agg.unique_rollup(x.select("l_orderkey", "l_suppkey"), x.select("l_orderkey", "l_extendedprice"), "l_orderkey", "l_suppkey", "l_extendedprice").withColumn("total", F.round("total", 2))


@query("""
WITH g AS (SELECT user_id, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events)
SELECT user_id, round(avg(gap), 3) AS duty_cycle, count(*) AS n FROM g GROUP BY 1 HAVING count(*) > 1
""")
def duty_cycle(spark, d):
    return agg.duty_cycle(t(spark, d, "events").select("user_id", micros().alias("x")), ["user_id"], "x").withColumn("duty_cycle", F.round("duty_cycle", 3))


@query("""
SELECT CAST(floor(value / 10) AS INTEGER) AS bin, count(*) AS n, floor(value / 10) * 10.0 AS start FROM events WHERE value >= 0 AND value < 500 GROUP BY ALL
""")
def histogram(spark, d):
    return agg.histogram(t(spark, d, "events"), "value", 0.0, 500.0, 50)


@query("""
WITH s AS (SELECT l_extendedprice AS s, count(*) FILTER (l_returnflag = 'R') AS p, count(*) FILTER (l_returnflag <> 'R') AS n FROM lineitem GROUP BY 1),
c AS (SELECT *, sum(n) OVER (ORDER BY s) - n AS below FROM s)
SELECT round(sum(p * (below + n / 2.0)) / (sum(p) * sum(n)), 8) AS auc, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives FROM c
""")
def roc_auc(spark, d):
    x = t(spark, d, "lineitem")
    return agg.roc_auc(x, "l_extendedprice", F.col("l_returnflag") == "R", ranges_for(x)).withColumn("auc", F.round("auc", 8))


@query("""
SELECT p_size AS charge, p_type, round(avg(p_retailprice), 4) AS bg_mean, round(stddev_pop(p_retailprice), 4) AS bg_stdev, count(*) AS bg_n FROM part GROUP BY 1, 2
""")
def score_background(spark, d):
    b = agg.background(t(spark, d, "part").withColumnRenamed("p_size", "charge"), ["charge", "p_type"], "p_retailprice")
    return b.select("charge", "p_type", F.round("bg_mean", 4).alias("bg_mean"), F.round("bg_stdev", 4).alias("bg_stdev"), "bg_n")


@query("""
WITH c AS (SELECT CAST(floor(value) AS INTEGER) AS bin, count(*) AS n FROM events WHERE floor(value) >= 0 AND floor(value) < 500 GROUP BY 1),
e AS (SELECT CAST(i AS INTEGER) AS bin, coalesce(n, 0) + 1.0 AS n FROM range(500) r(i) LEFT JOIN c ON bin = i)
SELECT bin, CAST(n AS DOUBLE) AS n, round(sum(n) OVER () / 500 / n, 6) AS weight FROM e
""")
def fragment_background(spark, d):
    return agg.fragment_frequency(t(spark, d, "events"), "value", 500).withColumn("weight", F.round("weight", 6))


@query("""
WITH RECURSIVE d AS MATERIALIZED (SELECT DISTINCT event_type, value FROM events),
a AS (SELECT event_type, min(value) AS m FROM d GROUP BY 1 UNION ALL SELECT a.event_type, min(d.value) AS m FROM a JOIN d ON d.event_type = a.event_type AND d.value - a.m > a.m * 2000e-6 GROUP BY 1)
SELECT event_type, round(avg(value), 6) AS mz, count(*) AS n FROM (SELECT e.event_type, e.value, a.m FROM events e ASOF JOIN a ON e.event_type = a.event_type AND e.value >= a.m) GROUP BY event_type, m
""")
def consensus_peaks(spark, d):
    e = t(spark, d, "events").select("event_type", "value", F.lit(1.0).alias("w"))
    return agg.consensus_peaks(e, ["event_type"], "value", "w", 2000).select("event_type", F.round("mz", 6).alias("mz"), "n")


@query("""
SELECT user_id, CAST(floor(value / 0.5) AS BIGINT) AS bin, round(sum(value * (event_id + 1)) / sum(event_id + 1), 6) AS mz, CAST(sum(event_id + 1) AS BIGINT) AS intensity FROM events GROUP BY 1, 2
""")
def merged_spectrum(spark, d):
    e = t(spark, d, "events").select("user_id", micros().alias("rt"), "value", (F.col("event_id") + 1).alias("w"))
    return agg.merge_spectra(e, ["user_id"], "rt", "value", "w", 0.5).select("user_id", "bin", F.round("mz", 6).alias("mz"), "intensity")


@query("""
SELECT count(*) FILTER (l_returnflag <> 'R' AND l_linestatus <> 'F') AS targets, count(*) FILTER (l_returnflag = 'R') AS decoys, count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'F') AS entrapments FROM lineitem
""")
def label_counts(spark, d):
    return agg.label_counts(t(spark, d, "lineitem"), F.col("l_returnflag") == "R", F.col("l_linestatus") == "F")


@query("""
WITH x AS (SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_extendedprice AS score, l_discount AS delta FROM lineitem),
m AS (SELECT l_partkey, l_suppkey, max(score) AS top FROM x GROUP BY 1, 2)
SELECT l_partkey, l_suppkey, top FROM m
""")
def best_integration(spark, d):
    """Keep the largest score per key on write."""
    return t(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max("l_extendedprice").alias("top"))


@query("""
WITH RECURSIVE r AS (SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice, l_discount, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_discount) AS i FROM lineitem),
b AS (
  SELECT *, i AS pos FROM r WHERE i = 1
  UNION ALL
  SELECT b.l_partkey, CASE WHEN x THEN r.l_orderkey ELSE b.l_orderkey END, CASE WHEN x THEN r.l_linenumber ELSE b.l_linenumber END, CASE WHEN x THEN r.l_extendedprice ELSE b.l_extendedprice END, CASE WHEN x THEN r.l_discount ELSE b.l_discount END, b.i, r.i
  FROM b JOIN r ON r.l_partkey = b.l_partkey AND r.i = b.pos + 1,
    LATERAL (SELECT b.l_extendedprice < 0.9 * r.l_extendedprice OR (r.l_extendedprice >= 0.9 * b.l_extendedprice AND abs(r.l_discount) < abs(b.l_discount)) AS x)
)
SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice, l_discount FROM b QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY pos DESC) = 1
""")
def best_with_hysteresis(spark, d):
    """Order-dependent fold, run in a declared order."""
    x = t(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    return agg.best_with_hysteresis(x, ["l_partkey"], "l_extendedprice", "l_discount", ["l_orderkey", "l_linenumber", "l_extendedprice"])


@query("""
WITH o AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_extendedprice FROM lineitem), s AS (SELECT l_suppkey, sum(l_extendedprice) AS tic FROM o GROUP BY 1), m AS (SELECT avg(tic) AS m FROM s),
n AS (SELECT o.*, CASE WHEN tic > 0 THEN l_extendedprice / tic * m ELSE l_extendedprice END AS x FROM o JOIN s USING (l_suppkey), m),
u AS (SELECT l_partkey FROM (SELECT DISTINCT l_partkey, l_suppkey FROM o) GROUP BY 1 HAVING count(*) <= 30)
SELECT p_brand, n_name, round(sum(x), 2) AS intensity, count(DISTINCT n.l_partkey) AS n_members
FROM n JOIN u USING (l_partkey) JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2
""")
def protein_matrix(spark, d):
    """Union, score join, total-intensity normalisation, members of few groups only, rollup to a matrix in long form."""
    o = t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice").distinct()
    n = agg.tic_normalize(o, "l_suppkey", "l_extendedprice")
    few = t(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct().groupBy("l_partkey").agg(F.count(F.lit(1)).alias("c")).where("c <= 30").select("l_partkey")
    s = t(spark, d, "supplier").join(joins.small_side(t(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "n_name")
    p = t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    x = n.join(few, "l_partkey", "left_semi").join(p, "l_partkey").join(s, "l_suppkey")
    return x.groupBy("p_brand", "n_name").agg(F.round(F.sum("normalized"), 2).alias("intensity"), F.countDistinct("l_partkey").alias("n_members"))


# -- 4 windows and chromatograms ---------------------------------------------------------------------------------------


@query("""
SELECT event_id, round(s, 6) AS moving_sum FROM (
  SELECT event_id, sum(value) OVER w AS s, count(*) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS ahead
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE ahead = 5
""")
def moving_sum_fwd(spark, d):
    return win.forward_sum(t(spark, d, "events"), ["user_id"], ["ts"], "value", 5).select("event_id", F.round("moving_sum", 6).alias("moving_sum"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7, 6) AS average FROM events")
def centered_avg(spark, d):
    w = win.over(["user_id"], ["ts"])
    return t(spark, d, "events").select("event_id", F.round(win.centred_average("value", w, 7), 6).alias("average"))


@query("""
WITH x AS (SELECT event_id, user_id, value, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, avg(value) OVER (PARTITION BY user_id) AS m,
  quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
e AS (SELECT *, max(CASE WHEN i = 4 THEN s END) OVER (PARTITION BY user_id) AS f, max(CASE WHEN i = n - 5 THEN s END) OVER (PARTITION BY user_id) AS l FROM x)
SELECT event_id, round(greatest(value - CASE WHEN n <= 9 THEN m WHEN i < 4 THEN f WHEN i > n - 5 THEN l ELSE s END, 0), 6) AS corrected FROM e
""")
def moving_median_baseline(spark, d):
    return win.subtract_baseline(t(spark, d, "events"), ["user_id"], ["ts"], "value", 9).select("event_id", F.round("corrected", 6).alias("corrected"))


@query("""
SELECT event_id, round(greatest((-3 * lag(value, 2, 0.0) OVER w + 12 * lag(value, 1, 0.0) OVER w + 17 * value + 12 * lead(value, 1, 0.0) OVER w - 3 * lead(value, 2, 0.0) OVER w) / 35, 0), 6) AS smoothed
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)
""")
def savgol5(spark, d):
    return win.savitzky_golay(t(spark, d, "events"), ["user_id"], ["ts"], "value", 5).select("event_id", F.round("smoothed", 6).alias("smoothed"))


@query("""
SELECT event_id, round(greatest((-21 * lag(value, 4, 0.0) OVER w + 14 * lag(value, 3, 0.0) OVER w + 39 * lag(value, 2, 0.0) OVER w + 54 * lag(value, 1, 0.0) OVER w + 59 * value
  + 54 * lead(value, 1, 0.0) OVER w + 39 * lead(value, 2, 0.0) OVER w + 14 * lead(value, 3, 0.0) OVER w - 21 * lead(value, 4, 0.0) OVER w) / 231, 0), 6) AS smoothed
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)
""")
def savgol9(spark, d):
    return win.savitzky_golay(t(spark, d, "events"), ["user_id"], ["ts"], "value", 9).select("event_id", F.round("smoothed", 6).alias("smoothed"))


@query("SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts), 6) AS slope FROM events")
def first_derivative(spark, d):
    return t(spark, d, "events").select("event_id", F.round(win.derivative("value", win.over(["user_id"], ["ts"])), 6).alias("slope"))


@query("""
WITH x AS (SELECT user_id, epoch_us(ts) / 1e6 / 3600 AS x, value AS y, least(first_value(value) OVER w, last_value(value) OVER w) AS low FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
s AS (SELECT user_id, (x - lag(x) OVER o) * (y + lag(y) OVER o) / 2 AS a, (x - lag(x) OVER o) * (least(y, low) + lag(least(y, low)) OVER o) / 2 AS b FROM x WINDOW o AS (PARTITION BY user_id ORDER BY x))
SELECT user_id, round(sum(a), 3) AS area, round(sum(b), 3) AS background, round(sum(a) - sum(b), 3) AS net FROM s GROUP BY 1
""")
def trapezoid_area(spark, d):
    x = t(spark, d, "events").select("user_id", (micros() / 3600).alias("x"), F.col("value").alias("y"))
    return win.trapezoid_area(x, ["user_id"], "x", "y").select("user_id", *[F.round(c, 3).alias(c) for c in ("area", "background", "net")])


@query("SELECT event_type, CAST(ts AS DATE) AS day, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY 1, 2")
def median_trace(spark, d):
    e = t(spark, d, "events").withColumn("day", F.to_date("ts"))
    return win.median_trace(e, ["event_type"], "day", "value").withColumn("median", F.round("median", 6))


@query("""
SELECT l_suppkey, round(least(1, corr(l_quantity, l_extendedprice)), 6) AS correlation, count(*) AS n FROM lineitem GROUP BY 1
""")
def trace_corr(spark, d):
    return win.trace_correlation(t(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice").withColumn("correlation", F.round("correlation", 6))


@query("""
WITH m AS (SELECT user_id, max(value) AS top FROM events GROUP BY 1)
SELECT user_id, round(sum(epoch_us(ts) / 1e6 * value) / sum(value) - 1704067200, 2) AS apex, top FROM events JOIN m USING (user_id) WHERE value >= 0.5 * top GROUP BY user_id, top
""")
def apex_centroid(spark, d):
    e = t(spark, d, "events").select("user_id", (micros() - 1704067200).alias("x"), "value")
    return win.apex_centroid(e, ["user_id"], "x", "value").select("user_id", F.round("apex", 2).alias("apex"), "top")


@query("SELECT event_id, CAST(rank() OVER (PARTITION BY user_id ORDER BY value DESC) AS INTEGER) AS rank FROM events")
def trace_rank(spark, d):
    return win.rank_in_trace(t(spark, d, "events"), ["user_id"], "value").select("event_id", "rank")


@query("SELECT event_id, round(value / sum(value) OVER (PARTITION BY user_id), 8) AS normalized FROM events")
def normalize_trace(spark, d):
    return win.normalize_trace(t(spark, d, "events"), ["user_id"], ["ts"], "value").select("event_id", F.round("normalized", 8).alias("normalized"))


@query("""
WITH c AS (SELECT event_id, user_id, ts, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS c FROM events)
SELECT event_id, CAST(max(c) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS BIGINT) AS coeluting FROM c
""")
def coeluting_ions(spark, d):
    e = t(spark, d, "events").withColumn("hit", (F.col("value") > 50).cast("int"))
    return win.coeluting(e, ["user_id"], ["ts"], "hit", 2).select("event_id", "coeluting")


@query("""
WITH k AS (SELECT user_id, epoch_us(ts) / 1e6 AS x, value AS y FROM events WHERE event_type = 'view'), q AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS x FROM events WHERE event_type = 'error'),
j AS (SELECT q.*, (SELECT (k.x, k.y) FROM k WHERE k.user_id = q.user_id AND k.x <= q.x ORDER BY k.x DESC LIMIT 1) AS a, (SELECT (k.x, k.y) FROM k WHERE k.user_id = q.user_id AND k.x >= q.x ORDER BY k.x LIMIT 1) AS b FROM q)
SELECT event_id, round(CASE WHEN a IS NULL THEN b[2] WHEN b IS NULL THEN a[2] WHEN a[1] = b[1] THEN b[2] ELSE a[2] + (b[2] - a[2]) * (x - a[1]) / (b[1] - a[1]) END, 5) AS value FROM j
""")
def interpolate_trace(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", "event_type", micros().alias("x"), F.col("value").alias("y"))
    knots, q = e.where("event_type = 'view'").select("user_id", "x", "y"), e.where("event_type = 'error'").select("event_id", "user_id", "x")
    return win.interpolate_at(knots, q, ["user_id"], "x", "y").select("event_id", F.round("value", 5).alias("value"))


# -- 5 statistics ------------------------------------------------------------------------------------------------------

P_VALUE = "CAST(rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC) AS DOUBLE) / (count(*) OVER (PARTITION BY l_returnflag) * 50)"


def p_values(spark, d, ranges=None):
    from pyspark.sql import Window

    x = t(spark, d, "lineitem")
    ranges = ranges or ranges_for(x)
    if ranges > 1:
        # Of the table's few groups none is ordered in one task.
        key = ["l_returnflag", "l_extendedprice"]
        per = running(x.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), ["l_returnflag"], "l_extendedprice", {"upto": ("sum", F.col("n"))}, descending=True, ranges=ranges)
        sizes = x.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("size"))
        return x.join(per, key).join(F.broadcast(sizes), "l_returnflag").select("l_returnflag", "l_orderkey", "l_extendedprice", ((F.col("upto") - F.col("n") + 1).cast("double") / (F.col("size") * 50)).alias("p"))  # a row a flag
    w = Window.partitionBy("l_returnflag")
    return x.select("l_returnflag", "l_orderkey", "l_extendedprice", (F.rank().over(w.orderBy(F.desc("l_extendedprice"))).cast("double") / (F.count(F.lit(1)).over(w) * 50)).alias("p"))


@query(f"""
WITH x AS (SELECT l_returnflag, l_orderkey, l_extendedprice, {P_VALUE} AS p FROM lineitem),
r AS (SELECT *, count(*) OVER (PARTITION BY l_returnflag ORDER BY p) AS rank, count(*) OVER (PARTITION BY l_returnflag) AS n FROM x)
SELECT l_returnflag, l_orderkey, l_extendedprice, round(least(1.0, min(n * p / rank) OVER (PARTITION BY l_returnflag ORDER BY p DESC)), 9) AS q FROM r
""")
def bh_adjust(spark, d):
    ranges = ranges_for(t(spark, d, "lineitem"))
    return st.benjamini_hochberg(p_values(spark, d, ranges), ["l_returnflag"], "p", ranges=ranges).select("l_returnflag", "l_orderkey", "l_extendedprice", F.round("q", 9).alias("q"))


@query("""
WITH x AS (SELECT event_type, value / 500 AS p FROM events), l AS (SELECT i / 10.0 AS s FROM range(1, 10) r(i)),
c AS (SELECT event_type, s, count(*) FILTER (p > s) / (count(*) * (1 - s)) AS v FROM x, l GROUP BY 1, 2)
SELECT event_type, round(greatest(0.05, least(1.0, quantile_disc(v, 0.5))), 8) AS pi0 FROM c GROUP BY 1
""")
def pi0(spark, d):
    x = t(spark, d, "events").select("event_type", (F.col("value") / 500).alias("p"))
    return st.pi0(x, ["event_type"], "p").withColumn("pi0", F.round("pi0", 8))


@query("""
WITH s AS (SELECT l_linestatus, l_extendedprice AS s, count(*) FILTER (l_returnflag = 'R') AS d, count(*) FILTER (l_returnflag <> 'R') AS t FROM lineitem GROUP BY 1, 2),
c AS (SELECT *, sum(d) OVER w AS dd, sum(t) OVER w AS tt FROM s WINDOW w AS (PARTITION BY l_linestatus ORDER BY s DESC)),
f AS (SELECT *, least(1.0, CASE WHEN tt = 0 THEN 1.0 ELSE CAST(dd AS DOUBLE) / CAST(tt AS DOUBLE) END) AS f FROM c)
SELECT l_linestatus, s AS l_extendedprice, round(min(f) OVER (PARTITION BY l_linestatus ORDER BY s), 9) AS q FROM f
""")
def tdc_qvalue(spark, d):
    x = t(spark, d, "lineitem").select("l_linestatus", "l_extendedprice", "l_returnflag")
    q = st.tdc_levels(x, ["l_linestatus"], "l_extendedprice", F.col("l_returnflag") == "R", ranges=ranges_for(x))
    return q.select("l_linestatus", "l_extendedprice", F.round("q", 9).alias("q"))


@query("""
SELECT l_orderkey, l_returnflag = 'R' AS decoy, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_returnflag = 'R') AS r FROM lineitem) WHERE r = 1
""")
def tdc_compete(spark, d):
    x = t(spark, d, "lineitem").select("l_orderkey", (F.col("l_returnflag") == "R").alias("decoy"), "l_extendedprice")
    return st.compete(x, ["l_orderkey"], "l_extendedprice", [F.col("decoy")])


@query("""
SELECT l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY 1
""")
def linreg(spark, d):
    f = st.linear_fit(t(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice")
    return f.select("l_suppkey", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r2", 6).alias("r2"), "n")


@query("""
WITH e AS (SELECT event_type, min(value) AS a, max(value) AS z FROM events GROUP BY 1),
h AS (SELECT event_type, least(floor((value - a) / ((z - a) / 50)), 49) AS k, count(*) AS n, max(a) AS a, max(z) AS z FROM events JOIN e USING (event_type) GROUP BY 1, 2),
s AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY k DESC) AS survive, a + k * ((z - a) / 50) AS loc FROM h),
f AS (SELECT event_type, regr_slope(ln(survive), loc) AS m, regr_intercept(ln(survive), loc) AS b FROM s WHERE k >= 25 AND survive > 3 GROUP BY 1)
SELECT event_type, round(coalesce(m, -0.25), 6) AS slope, round(CASE WHEN m IS NULL THEN 3.5 ELSE b END, 5) AS intercept FROM e LEFT JOIN f USING (event_type)
""")
def evalue_fit(spark, d):
    f = st.e_value_fit(t(spark, d, "events"), ["event_type"], "value")
    return f.select("event_type", F.round("slope", 6).alias("slope"), F.round("intercept", 5).alias("intercept"))


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 1")
def seed_pick(spark, d):
    return st.seed_run(t(spark, d, "lineitem"), "l_suppkey")


@query("""
WITH x AS (SELECT user_id, CAST(ts AS DATE) AS day, epoch_us(ts) / 1e6 / 3600 AS x, value AS y FROM events),
s AS (SELECT a.user_id, a.day, (b.y - a.y) / (b.x - a.x) AS s FROM x a JOIN x b ON a.user_id = b.user_id AND a.day = b.day AND b.x > a.x)
SELECT g.user_id, CAST(g.day AS VARCHAR) AS day, round(quantile_cont(s, 0.5), 4) AS slope FROM (SELECT DISTINCT user_id, day FROM x) g LEFT JOIN s USING (user_id, day) GROUP BY ALL
""")
def theil_sen(spark, d):
    """The bins are a user's days, which are small."""
    x = t(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), (micros() / 3600).alias("x"), F.col("value").alias("y"))
    return st.theil_sen(x, ["user_id", "day"], "x", "y").select("user_id", F.col("day").cast("string").alias("day"), F.round("slope", 4).alias("slope"))


@query("""
WITH b AS (SELECT *, ntile(20) OVER (PARTITION BY event_type ORDER BY ts, value) AS bin FROM (SELECT event_type, epoch_us(ts) / 1e6 - 1704067200 AS ts, value FROM events))
SELECT event_type, CAST(bin AS INTEGER) AS bin, round(quantile_cont(ts, 0.5), 3) AS x, round(quantile_cont(value, 0.5), 6) AS y, count(*) AS n FROM b GROUP BY 1, 2
""")
def running_reference(spark, d):
    e = t(spark, d, "events").select("event_type", (micros() - 1704067200).alias("x"), F.col("value").alias("y"))
    return st.binned_reference(e, ["event_type"], "x", "y", 20).select("event_type", "bin", F.round("x", 3).alias("x"), F.round("y", 6).alias("y"), "n")


@query("""
WITH n AS (SELECT l_linestatus, avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
z AS (SELECT l_orderkey, l_linenumber, l_extendedprice, (l_extendedprice - m) / s / sqrt(2) AS z FROM lineitem JOIN n USING (l_linestatus) WHERE l_returnflag <> 'R'),
u AS (SELECT *, 1 / (1 + 0.5 * abs(z)) AS u FROM z),
e AS (SELECT *, u * exp(-z * z - 1.26551223 + u * (1.00002368 + u * (0.37409196 + u * (0.09678418 + u * (-0.18628806 + u * (0.27886807 + u * (-1.13520398 + u * (1.48851587 + u * (-0.82215223 + u * 0.17087277))))))))) AS e FROM u)
SELECT l_orderkey, l_linenumber, l_extendedprice, round(0.5 * CASE WHEN z >= 0 THEN e ELSE 2 - e END, 9) AS p FROM e
""")
def decoy_null(spark, d):
    x = st.null_p_values(t(spark, d, "lineitem"), ["l_linestatus"], "l_extendedprice", F.col("l_returnflag") == "R")
    return x.where("l_returnflag <> 'R'").select("l_orderkey", "l_linenumber", "l_extendedprice", F.round("p", 9).alias("p"))


@query("""
SELECT l_returnflag = 'R' AS positive, count(*) AS n, round(sum(l_quantity), 2) AS s_0, round(sum(l_discount), 4) AS s_1, round(sum(l_quantity * l_quantity), 2) AS c_0_0, round(sum(l_quantity * l_discount), 3) AS c_0_1, round(sum(l_discount * l_discount), 4) AS c_1_1 FROM lineitem GROUP BY 1
""")
def lda_moments(spark, d):
    m = st.lda_moments(t(spark, d, "lineitem"), F.col("l_returnflag") == "R", ["l_quantity", "l_discount"])
    digits = {"s_0": 2, "s_1": 4, "c_0_0": 2, "c_0_1": 3, "c_1_1": 4}
    return m.select("positive", "n", *[F.round(c, k).alias(c) for c, k in digits.items()])


@query("""
WITH q AS (SELECT l_suppkey, quantile_cont(l_extendedprice, 0.9) AS c FROM lineitem GROUP BY 1)
SELECT l_suppkey, count(*) AS n, min(l_extendedprice) AS least FROM lineitem JOIN q USING (l_suppkey) WHERE l_extendedprice >= c GROUP BY 1
""")
def top_share(spark, d):
    return st.top_share(t(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", 0.1).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.min("l_extendedprice").alias("least"))


# -- 6 strings and generators ------------------------------------------------------------------------------------------

MODSEQ = "upper(translate(p_name, ' ', '')) || CASE WHEN p_partkey % 3 = 0 THEN 'C[+57.02]K' ELSE 'MK' END || CASE WHEN p_partkey % 5 = 0 THEN 'S[+79.97]R' ELSE 'SR' END"


def modseq():
    k = F.col("p_partkey")
    return F.concat(F.upper(F.translate("p_name", " ", "")), F.when(k % 3 == 0, F.lit("C[+57.02]K")).otherwise(F.lit("MK")), F.when(k % 5 == 0, F.lit("S[+79.97]R")).otherwise(F.lit("SR")))


@query(rf"""
SELECT p_partkey, array_to_string(regexp_extract_all({MODSEQ}, '[A-Z](\[[^\]]*\])?'), '|') AS tokens, regexp_replace({MODSEQ}, '\[[^\]]*\]', '', 'g') AS plain, CAST(len(regexp_extract_all({MODSEQ}, '\[[^\]]*\]')) AS INTEGER) AS mods FROM part
""")
def tokenize_mods(spark, d):
    m = modseq()
    return t(spark, d, "part").select("p_partkey", F.array_join(seq.tokens(m), "|").alias("tokens"), seq.strip_modifications(m).alias("plain"), seq.count_modifications(m).alias("mods"))


@query(rf"""
WITH t AS (SELECT p_partkey, regexp_extract_all({MODSEQ}, '[A-Z](\[[^\]]*\])?') AS t FROM part)
SELECT p_partkey, array_to_string(t[1:1] || list_reverse(t[2:len(t) - 1]) || t[len(t):len(t)], '') AS decoy FROM t
""")
def reverse_keep_termini(spark, d):
    return t(spark, d, "part").select("p_partkey", seq.reverse_inside(modseq()).alias("decoy"))


@query(r"""
WITH s AS (SELECT p_partkey, upper(translate(p_name, ' ', '')) || 'KRPRK' AS s FROM part), c AS (SELECT p_partkey, string_split(regexp_replace(s, '([KR])([^P])', '\1,\2', 'g'), ',') AS x FROM s),
d AS (SELECT p_partkey, string_split(regexp_replace(array_to_string(x, ','), '([KR])([^P,])', '\1,\2', 'g'), ',') AS x FROM c)
SELECT p_partkey, unnest(x) AS piece, CAST(len(x) - 1 AS INTEGER) AS missed FROM d
""")
def cleave(spark, d):
    s = F.concat(F.upper(F.translate("p_name", " ", "")), F.lit("KRPRK"))
    return t(spark, d, "part").select("p_partkey", F.explode(chem.pieces(s)).alias("piece"), chem.missed_cleavages(s).alias("missed"))


@query("""
WITH s AS (SELECT p_partkey, upper(translate(p_name, ' ', '')) AS s FROM part), i AS (SELECT p_partkey, unnest(range(length(s))) AS i, s FROM s), k AS (SELECT p_partkey, i FROM i WHERE s[i + 1] IN ('E', 'T'))
SELECT a.p_partkey, CAST(a.i AS VARCHAR) || ',' || CAST(b.i AS VARCHAR) AS sites FROM k a JOIN k b ON a.p_partkey = b.p_partkey AND a.i < b.i
""")
def site_pairs(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.upper(F.translate("p_name", " ", "")).alias("s"))
    return gen.site_choices(p, "s", "ET", 2).select("p_partkey", F.array_join(F.transform("sites", lambda i: i.cast("string")), ",").alias("sites"))


@query("SELECT p_partkey, CAST(unnest(range(1, CAST(1 + p_size % 4 AS BIGINT) + 1)) AS INTEGER) AS charge FROM part")
def charge_expand(spark, d):
    return gen.charge_states(t(spark, d, "part").select("p_partkey", "p_size"), F.lit(1), (1 + F.col("p_size") % 4).cast("int")).select("p_partkey", "charge")


@query("""
SELECT event_id, event_type AS source, CAST(event_id AS DOUBLE) / 4 AS rt, event_id % 2 = 0 AS decoy, 'PEPT[+1.5]IDE' AS sequence, CAST(1 + event_id % 3 AS INTEGER) AS charge FROM events
""")
def psm_id_roundtrip(spark, d):
    k = F.col("event_id")
    ident = seq.psm_id(F.col("event_type"), k.cast("double") / 4, F.lit("PEPT[+1.5]IDE"), 1 + k % 3, k % 2 == 0)
    p = seq.parse_psm_id(ident)
    return t(spark, d, "events").select("event_id", p["source"].alias("source"), p["rt"].alias("rt"), p["decoy"].alias("decoy"), p["sequence"].alias("sequence"), p["charge"].alias("charge"))


@query("SELECT p_brand, count(*) AS n, CAST(row_number() OVER (ORDER BY CAST(substr(p_brand, 7) AS INTEGER)) AS INTEGER) AS place FROM part GROUP BY 1")
def natural_sort_key(spark, d):
    from pyspark.sql import Window

    p = t(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    return p.withColumn("place", F.row_number().over(Window.orderBy(seq.natural_key(F.col("p_brand")))))


@query("""
SELECT p_partkey, CAST(1 + length(s) - length(replace(replace(replace(s, 'K', ''), 'R', ''), 'H', '')) AS INTEGER) AS charge FROM (SELECT p_partkey, upper(p_name) AS s FROM part)
""")
def expected_charge(spark, d):
    return t(spark, d, "part").select("p_partkey", seq.expected_charge(F.upper("p_name")).alias("charge"))


MASS_SUM = " + ".join(f"{m}::DOUBLE * (length(s) - length(replace(s, '{a}', '')))" for a, m in sorted(chem.RESIDUES.items()))


@query(f"""
WITH p AS (SELECT p_partkey, regexp_replace(upper(p_name || p_type || p_brand), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS s FROM part), m AS (SELECT p_partkey, {MASS_SUM} + 15.9949146195616::DOUBLE + 2 * 1.007825032071::DOUBLE AS m FROM p)
SELECT p_partkey, round(m, 5) AS mass, round((m + 2 * 1.00727646681290::DOUBLE) / 2, 5) AS mz2 FROM m
""")
def sequence_masses(spark, d):
    m = chem.sequence_mass(F.regexp_replace(F.upper(F.concat("p_name", "p_type", "p_brand")), "[^ACDEFGHIKLMNPQRSTVWY]", ""))
    return t(spark, d, "part").select("p_partkey", F.round(m, 5).alias("mass"), F.round(chem.charged_mass(m, F.lit(2)), 5).alias("mz2"))


# -- 7 array functions -------------------------------------------------------------------------------------------------


def spectra(spark, d):
    v = t(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    a = v.select(F.col("vec_id").alias("a"), F.col("e").alias("x"))
    return a.join(v.select((F.col("vec_id") - 1).alias("a"), F.col("e").alias("y")), "a")


PAIRS = "(SELECT p.vec_id AS a, list_transform(p.embedding, lambda v: CAST(v AS DOUBLE)) AS x, list_transform(q.embedding, lambda v: CAST(v AS DOUBLE)) AS y FROM embeddings p JOIN embeddings q ON q.vec_id = p.vec_id + 1)"


@query(f"SELECT a, round(list_dot_product(x, y), 9) AS dot, round(list_cosine_similarity(x, y), 9) AS cosine FROM {PAIRS}")
def cosine(spark, d):
    s = spectra(spark, d)
    return s.select("a", F.round(A.dot(F.col("x"), F.col("y")), 9).alias("dot"), F.round(A.cosine(F.col("x"), F.col("y")), 9).alias("cosine"))


@query(f"SELECT a, round(1 - 2 * acos(greatest(0.00001, least(0.99999, list_cosine_similarity(x, y)))) / pi(), 8) AS angle FROM {PAIRS}")
def spectral_angle(spark, d):
    return spectra(spark, d).select("a", F.round(A.spectral_angle(F.col("x"), F.col("y")), 8).alias("angle"))


@query(f"""
WITH u AS (SELECT a, unnest(x) AS x, unnest(y) AS y FROM {PAIRS}),
r AS (SELECT a, x, y, rank() OVER (PARTITION BY a ORDER BY x) + (count(*) OVER (PARTITION BY a, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY a ORDER BY y) + (count(*) OVER (PARTITION BY a, y) - 1) / 2.0 AS ry FROM u)
SELECT a, round(corr(x, y), 8) AS pearson, round(corr(rx, ry), 8) AS spearman FROM r GROUP BY 1
""")
def spearman(spark, d):
    s = spectra(spark, d)
    return s.select("a", F.round(A.pearson(F.col("x"), F.col("y")), 8).alias("pearson"), F.round(A.spearman(F.col("x"), F.col("y")), 8).alias("spearman"))


@query(f"""
WITH n AS (SELECT a, x, y, sqrt(list_dot_product(x, x)) AS nx, sqrt(list_dot_product(y, y)) AS ny FROM {PAIRS})
SELECT a, round(greatest(-ln(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] / nx - y[i] / ny) ** 2))), 0), 7) AS score FROM n
""")
def fit_error_score(spark, d):
    return spectra(spark, d).select("a", F.round(A.fit_error_score(F.col("x"), F.col("y")), 7).alias("score"))


@query(f"""
WITH m AS (SELECT a, list_dot_product(x, y) AS dot, CAST(len(list_filter(x, lambda v: v > 0.1)) AS INTEGER) AS n FROM {PAIRS})
SELECT a, n, round(CASE WHEN dot > 0 AND n > 0 THEN log10(dot) + lgamma(n + 1) / ln(10) ELSE 0 END, 6) AS score FROM m
""")
def log_factorial_score(spark, d):
    s = spectra(spark, d)
    n = F.size(F.filter("x", lambda v: v > 0.1))
    return s.select("a", n.alias("n"), F.round(A.xtandem_score(A.dot(F.col("x"), F.col("y")), n), 6).alias("score"))


@query("""
WITH u AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS r FROM u)
SELECT vec_id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS positions FROM r WHERE r <= 10 GROUP BY 1
""")
def topn_peaks(spark, d):
    e = t(spark, d, "embeddings")
    p = A.top_peaks(A.peaks(F.sequence(F.lit(1), F.size("embedding")), F.col("embedding")), 10)
    return e.select("vec_id", F.array_join(F.transform(p, lambda x: x["mz"].cast("int").cast("string")), ",").alias("positions"))


@query("""
SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN sqrt(CAST(x AS DOUBLE)) ELSE 0 END)), 8) AS root_sum, round(list_avg(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 9) AS mean,
  round(list_stddev_pop(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 9) AS stdev, round(list_sum(list_reverse_sort(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))[1:5]), 9) AS top5 FROM embeddings
""")
def array_statistics(spark, d):
    e = t(spark, d, "embeddings").withColumn("e", F.transform("embedding", lambda x: x.cast("double")))
    root = A.peak_total(A.sqrt_intensity(A.peaks(F.sequence(F.lit(1), F.size("e")), F.col("e"))))
    return e.select("vec_id", F.round(root, 8).alias("root_sum"), F.round(A.mean(F.col("e")), 9).alias("mean"), F.round(A.stdev(F.col("e")), 9).alias("stdev"), F.round(A.top_sum(F.col("e"), 5), 9).alias("top5"))


# -- 8 set operations --------------------------------------------------------------------------------------------------


@query("""
SELECT run, count(*) AS n, round(sum(v), 2) AS total FROM (SELECT 'orders' AS run, o_totalprice AS v FROM orders UNION ALL SELECT 'parts', p_retailprice FROM part UNION ALL SELECT 'customers', c_acctbal FROM customer) GROUP BY 1
""")
def union_all_runs(spark, d):
    parts = [t(spark, d, n).select(F.lit(r).alias("run"), F.col(c).alias("v")) for n, r, c in (("orders", "orders", "o_totalprice"), ("part", "parts", "p_retailprice"), ("customer", "customers", "c_acctbal"))]
    return setops.union_runs(parts).groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 2).alias("total"))


@query("""
WITH u AS (SELECT l_partkey, l_extendedprice, l_orderkey FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT l_partkey, l_extendedprice, l_orderkey FROM lineitem WHERE l_returnflag = 'N')
SELECT l_partkey, l_extendedprice, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey) AS r FROM u) WHERE r = 1
""")
def merge_dedupe(spark, d):
    x = t(spark, d, "lineitem").select("l_partkey", "l_extendedprice", "l_orderkey", "l_returnflag")
    return setops.merge_libraries([x.where(F.col("l_returnflag") == f).drop("l_returnflag") for f in "AN"], ["l_partkey"], "l_extendedprice", [F.col("l_orderkey")])


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem a WHERE l_returnflag = 'A' AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_returnflag = 'R' AND b.l_partkey = a.l_partkey AND b.l_suppkey = a.l_suppkey)")
def except_ions(spark, d):
    x, key = t(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag"), ["l_partkey", "l_suppkey"]
    return setops.new_items(x.where("l_returnflag = 'A'").select(*key).distinct(), x.where("l_returnflag = 'R'"), key)


@query("SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 INTERSECT SELECT l_suppkey FROM lineitem WHERE l_discount > 0.09")
def intersect_passing(spark, d):
    x = t(spark, d, "lineitem")
    return setops.common_items(x.where("l_quantity > 49"), x.where("l_discount > 0.09"), ["l_suppkey"])


@query("""
WITH c AS (SELECT user_id, event_type, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 / (count(*) - 1) AS dc FROM events GROUP BY 1, 2 HAVING count(*) > 1), m AS (SELECT quantile_cont(dc, 0.5) AS m FROM c)
SELECT e.event_id, CAST(dense_rank() OVER (ORDER BY e.user_id) - 1 AS INTEGER) AS fraction FROM events e LEFT JOIN (SELECT user_id, event_type, TRUE AS keep FROM c, m WHERE dc <= 1.5 * m) k USING (user_id, event_type) QUALIFY keep
""")
def merge_scans(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", "event_type", micros().alias("rt"))
    return setops.merge_scans(e, "user_id", ["event_type"], "rt").select("event_id", F.col("fraction").cast("int").alias("fraction"))


# -- 9 kernels (no exact SQL; brute force in the tests) ----------------------------------------------------------------


@query("""
WITH e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i FROM events),
a AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, i) = 1),
f AS (SELECT e.* FROM e JOIN a USING (user_id) WHERE abs(e.i - a.i) > 4), b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, i) = 1),
g AS (SELECT f.* FROM f JOIN b USING (user_id) WHERE abs(f.i - b.i) > 4), c AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, i) = 1)
SELECT user_id, event_id, value AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, 1 AS rank FROM a UNION ALL SELECT *, 2 AS rank FROM b UNION ALL SELECT *, 3 AS rank FROM c)
""")
def topk_exclusion(spark, d):
    return kernels.topk_exclusion(t(spark, d, "events"), ["user_id"], ["ts"], "event_id", "value", 3, 4)


@query("""
WITH e AS (SELECT user_id AS k, CAST(epoch_us(ts) AS DOUBLE) / 1e6 AS x, value AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
a AS (SELECT k, n, y AS top, i AS apex, x AS ax FROM e QUALIFY row_number() OVER (PARTITION BY k ORDER BY y DESC, i) = 1),
w AS (SELECT e.k, e.i, e.y, a.n, a.top, a.apex, sign(e.i - a.apex) AS side, abs(e.i - a.apex) AS far FROM e JOIN a USING (k) WHERE e.i <> a.apex),
l AS (SELECT *, least(top, coalesce(min(y) OVER (PARTITION BY k, side ORDER BY far ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), top)) AS low FROM w),
g AS (SELECT *, sum(CAST(y <= low AS INTEGER)) OVER (PARTITION BY k, side ORDER BY far) AS grp FROM l),
r AS (SELECT *, sum(CAST(y > low + 0.2 * top AS INTEGER)) OVER (PARTITION BY k, side, grp ORDER BY far) AS rises FROM g),
s AS (SELECT k, side, min(far) FILTER (y < 0.01 * top OR (y > low AND rises >= 2)) AS stop FROM r GROUP BY ALL),
b AS (SELECT r.k, r.side, max(far) FILTER (y <= low AND (stop IS NULL OR far < stop)) AS best FROM r JOIN s USING (k, side) GROUP BY ALL),
p AS (SELECT a.k, a.n, a.ax, a.apex - coalesce(max(best) FILTER (side < 0), 0) AS a, a.apex + coalesce(max(best) FILTER (side > 0), 0) AS z FROM a LEFT JOIN b USING (k) GROUP BY a.k, a.n, a.ax, a.apex),
q AS (SELECT k, n, ax, CASE WHEN z - a < 2 THEN greatest(0, a - 1) ELSE a END AS a, CASE WHEN z - a < 2 THEN least(n - 1, z + 1) ELSE z END AS z FROM p),
t AS (SELECT k, n, ax, CASE WHEN z - a < 2 THEN greatest(0, a - 1) ELSE a END AS a, CASE WHEN z - a < 2 THEN least(n - 1, z + 1) ELSE z END AS z FROM q)
SELECT t.k AS user_id, u.x AS start, v.x AS stop, ax AS apex, t.z - t.a + 1 AS points FROM t JOIN e u ON u.k = t.k AND u.i = t.a JOIN e v ON v.k = t.k AND v.i = t.z
""")
def peak_bounds(spark, d):
    return kernels.bounds(t(spark, d, "events").select("user_id", micros().alias("x"), "value"), ["user_id"], "x", "value")


@query("""
WITH s AS (SELECT event_type, min(value) AS a, max(value) AS z, count(*) AS n, greatest(1.06 * stddev_pop(value) * count(*) ** -0.2, 1e-9) AS h FROM events GROUP BY 1),
g AS (SELECT event_type, n, a + k * (z - a) / 99 AS x, k, sum(cos((a + k * (z - a) / 99 - value) * pi() / (4 * h))) AS y FROM events JOIN s USING (event_type), (SELECT range AS k FROM range(100)) WHERE abs(a + k * (z - a) / 99 - value) <= 2 * h GROUP BY ALL)
SELECT event_type, round(arg_min(x, (-round(y, 9), k)), 6) AS mode, any_value(n) AS n FROM g GROUP BY 1
""")
def kde_mode(spark, d):
    return st.kde_mode(t(spark, d, "events"), ["event_type"], "value").withColumn("mode", F.round("mode", 6))


@query()
def local_fdr(spark, d):
    e = t(spark, d, "events").select("event_type", "event_id", (F.col("value") / 500).alias("p"))
    return kernels.local_fdr_by(e, ["event_type"], "event_id", "p")


@query()
def lda_semisup(spark, d):
    x = t(spark, d, "lineitem").select(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate").alias("id"), (F.col("l_returnflag") == "R").alias("decoy"), "l_quantity", "l_extendedprice", "l_discount")
    return kernels.lda_semi_supervised(x, ["l_quantity", "l_extendedprice", "l_discount"], "decoy", "id", 20_000).select("id", "decoy", F.round("lda_score", 6).alias("lda_score"))


@query()
def parsimony_groups(spark, d):
    b = t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("grp")).agg(F.min("l_discount").alias("error"))
    return kernels.parsimony_groups(b.join(joins.small_side(bridge_components(b, "item", "grp")), "grp"), "item", "grp", "error", "component")


@query()
def rt_align(spark, d):
    x = t(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 8).alias("pair"), "l_partkey").agg(F.avg("l_quantity").alias("x"), F.avg(F.col("l_extendedprice") / 1000).alias("y"))
    return kernels.rt_align(x, ["pair"], "x", "y", "l_partkey")


@query()
def dilution_fit(spark, d):
    x = t(spark, d, "lineitem").groupBy((F.col("l_partkey") % 200).alias("curve"), F.col("l_quantity").alias("amount")).agg(F.avg("l_extendedprice").alias("signal"))
    return kernels.dilution(x, ["curve"], "amount", "signal")
