"""More named queries with their SQL: peak matching, traces, library upkeep, notation (see `catalog` for what stands in for what)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from peakfold.functions import arrays as A
from peakfold.functions import chemistry as chem
from peakfold.functions import notation
from peakfold.functions import sequences as seq
from peakfold.operators import aggregates as agg
from peakfold.operators import joins, scans, setops, tracescore
from peakfold.operators import statistics as st
from peakfold.operators import windows as win
from peakfold.operators.running import ranges_for
from peakfold.plans import flows, reports
from peakfold.plans.catalog import MODSEQ, micros, query, t

# -- matching ----------------------------------------------------------------------------------------------------------

PEAKS = """
a AS (SELECT p_size, p_retailprice AS a, count(*) * 1.0 AS x FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL),
b AS (SELECT p_size, p_retailprice AS b, max(p_partkey) * 1.0 AS y FROM part WHERE p_partkey % 2 = 1 GROUP BY ALL),
m AS (SELECT a.p_size, a, b, x, y FROM a JOIN b ON a.p_size = b.p_size AND abs(a - b) <= greatest(a, b) * 400e-6),
n AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY p_size, b ORDER BY abs(a - b), a) = 1),
h AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY p_size, a ORDER BY y DESC, b) = 1)
"""


def peak_tables(spark, d):
    p = t(spark, d, "part")
    a = p.where("p_partkey % 2 = 0").groupBy("p_size", F.col("p_retailprice").alias("a")).agg((F.count(F.lit(1)) * 1.0).cast("double").alias("x"))
    b = p.where("p_partkey % 2 = 1").groupBy("p_size", F.col("p_retailprice").alias("b")).agg(F.max("p_partkey").cast("double").alias("y"))
    return a, b


@query(f"WITH {PEAKS} SELECT p_size, a, b, CAST(y AS DOUBLE) AS y FROM h")
def match_once(spark, d):
    a, b = peak_tables(spark, d)
    return joins.match_once(a, b, ["p_size"], "a", "b", 400, "y").select("p_size", "a", "b", "y")


@query(f"""
WITH {PEAKS} SELECT p_size, a AS mz, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM h
UNION ALL SELECT p_size, a, CAST(x AS DOUBLE), CAST(0 AS DOUBLE) FROM a WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.p_size = a.p_size AND h.a = a.a)
UNION ALL SELECT p_size, b, CAST(0 AS DOUBLE), CAST(y AS DOUBLE) FROM b WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.p_size = b.p_size AND h.b = b.b)
""")
def outer_match(spark, d):
    a, b = peak_tables(spark, d)
    return joins.outer_match(a, b, ["p_size"], "a", "b", 400, "x", "y")


@query("""
SELECT p_partkey, abs(p_retailprice - 1000) <= greatest(p_retailprice, 1000) * 500e-6 AS same,
  abs(p_retailprice - 1000) <= greatest(p_retailprice, 1000) * 500e-6 OR abs(p_retailprice - (1000 + 1.0033548378 / 2)) <= greatest(p_retailprice, 1000 + 1.0033548378 / 2) * 500e-6 AS isotope FROM part
""")
def isotope_match(spark, d):
    mz = F.lit(1000.0)
    return t(spark, d, "part").select("p_partkey", reports.isotope_match(mz, F.lit(2), F.col("p_retailprice"), 500, 0).alias("same"), reports.isotope_match(mz, F.lit(2), F.col("p_retailprice"), 500, 1).alias("isotope"))


@query("""
SELECT CAST(ts AS DATE) - DATE '2024-01-01' AS cycle, CAST(floor(value / 100) AS INTEGER) AS "window", round(avg(user_id), 6) AS rt, CAST(count(*) * 0.5 AS DOUBLE) AS time, count(*) AS n
FROM events WHERE floor(value / 100) < 5 AND value + 5 <= (floor(value / 100) + 1) * 100 GROUP BY ALL
""")
def downsample_windows(spark, d):
    e = t(spark, d, "events").select(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("cycle"), F.col("value").alias("low"), (F.col("value") + 5).alias("high"), F.col("user_id").cast("double").alias("rt"), F.lit(0.5).cast("double").alias("time"))
    coarse = spark.range(5).select(F.col("id").cast("int").alias("window"), (F.col("id") * 100.0).alias("low"), (F.col("id") * 100.0 + 100).alias("high"))
    out = scans.downsample_windows(e, coarse)
    return out.select("cycle", "window", F.round("rt", 6).alias("rt"), "time", "n")


@query("""
SELECT p_partkey FROM part s WHERE EXISTS (SELECT 1 FROM part t WHERE t.p_size = 7 AND s.p_retailprice BETWEEN t.p_retailprice - 0.35 AND t.p_retailprice + 0.35 AND s.p_size BETWEEN 5 AND 5 + t.p_partkey % 30)
""")
def mask_by_targets(spark, d):
    p = t(spark, d, "part")
    targets = p.where("p_size = 7").select(F.col("p_retailprice").alias("mz"), F.lit(5).alias("start"), (5 + F.col("p_partkey") % 30).alias("stop"))
    return scans.mask_by_targets(p.select("p_partkey", F.col("p_retailprice").alias("mz"), F.col("p_size").alias("rt")), targets).select("p_partkey")


@query("""
SELECT p_partkey, len(w) > 0 AND len(list_filter(w, lambda x: NOT contains(x, 'a'))) = 0 AS entrapment, starts_with(p_brand, 'Brand#1') AS decoy FROM (SELECT *, list_filter(string_split(p_name, ' '), lambda x: x <> '') AS w FROM part)
""")
def accession_kinds(spark, d):
    w = F.filter(F.split("p_name", " "), lambda x: x != "")
    return t(spark, d, "part").select("p_partkey", seq.is_entrapment(w, "a").alias("entrapment"), seq.is_decoy(F.col("p_brand"), "Brand#1").alias("decoy"))


@query("""
SELECT l_partkey, array_to_string(list_sort(list(DISTINCT l_suppkey)), ';') AS suppliers FROM lineitem GROUP BY 1
""")
def upsert_sets(spark, d):
    x = t(spark, d, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.collect_list("l_suppkey").alias("s"))
    return setops.upsert_sets(x, "l_partkey", "s").select("l_partkey", F.array_join(F.transform("s", lambda v: v.cast("string")), ";").alias("suppliers"))


# -- numbers -----------------------------------------------------------------------------------------------------------


@query("""
WITH f AS (SELECT l_suppkey, l_suppkey % 7 AS sample, sum(l_extendedprice) AS tic FROM lineitem GROUP BY ALL), m AS (SELECT sample, avg(tic) AS mean FROM f GROUP BY 1)
SELECT l_suppkey, round(sum(l_quantity / tic * mean), 4) AS total FROM lineitem JOIN f USING (l_suppkey) JOIN m USING (sample) GROUP BY 1
""")
def replicate_normalize(spark, d):
    x = t(spark, d, "lineitem")
    x = x.join(x.groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("tic")), "l_suppkey").withColumn("sample", F.col("l_suppkey") % 7)
    return agg.replicate_normalize(x, "l_suppkey", "sample", "tic", "l_quantity").groupBy("l_suppkey").agg(F.round(F.sum("normalized"), 4).alias("total"))


@query("""
WITH x AS (SELECT event_type, value, (event_id % 101 - 20) / 79.3 AS c FROM events),
g AS (SELECT event_type, CAST(floor(value / 5) AS BIGINT) AS bin, sum(value * greatest(c, 0)) AS w, coalesce(sum(value) FILTER (c >= 0.75), 0) AS good, coalesce(sum(value) FILTER (c < 0.75), 0) AS bad FROM x GROUP BY ALL)
SELECT event_type, bin, round(w, 4) AS weighted, round(good, 4) AS good, round(bad, 4) AS bad FROM g WHERE bad <= 2.5 * good
""")
def weighted_consensus(spark, d):
    x = t(spark, d, "events").select("event_type", "value", ((F.col("event_id") % 101 - 20) / 79.3).alias("c"))
    out = agg.weighted_consensus(x, ["event_type"], "value", "value", "c", 5.0, most_bad=2.5)
    return out.select("event_type", "bin", *[F.round(c, 4).alias(c) for c in ("weighted", "good", "bad")])


@query("""
SELECT p_partkey, CASE WHEN (p_partkey % 1000) / 1e5 > 0.001 THEN p_retailprice ELSE CAST(p_size AS DOUBLE) END AS rt,
  CASE WHEN abs(p_retailprice - 1000) <= abs(p_size - 1000.0) THEN p_retailprice - 1000 ELSE p_size - 1000.0 END AS delta FROM part
""")
def inferred_times(spark, d):
    x = t(spark, d, "part")
    p = F.col("p_partkey") % 1000 / 1e5
    return x.select("p_partkey", st.infer_value(F.col("p_retailprice"), p, F.col("p_size").cast("double")).alias("rt"), st.symmetric_delta(F.col("p_retailprice") - 1000, F.col("p_size") - F.lit(1000.0).cast("double")).alias("delta"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(1.5 - 0.25 * l_quantity + 100 * l_discount, 6) AS score FROM lineitem")
def apply_model(spark, d):
    out = flows.apply_model(t(spark, d, "lineitem"), ["l_quantity", "l_discount"], {"l_quantity": -0.25, "l_discount": 100.0, "unknown": 5.0}, 1.5)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("score", 6).alias("score"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity * l_extendedprice * greatest(l_discount, 0.03), 4) AS weighted,
  round(CASE WHEN l_tax > 0 AND l_linenumber > 0 THEN greatest(log10(l_tax) + lgamma(l_linenumber + 1) / ln(10) + 2, 0) ELSE 2 END, 6) AS hyper FROM lineitem
""")
def peak_scores(spark, d):
    x = t(spark, d, "lineitem")
    return x.select("l_orderkey", "l_linenumber", "l_partkey", F.round(A.weighted_peak_score(F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount"), 0.03), 4).alias("weighted"), F.round(A.hyperscore(F.col("l_tax"), F.col("l_linenumber")), 6).alias("hyper"))


@query("SELECT p_partkey, round(ceil(p_retailprice / 1.00045475) * 1.00045475 + 0.25, 6) AS edge FROM part")
def window_edges(spark, d):
    return t(spark, d, "part").select("p_partkey", F.round(chem.window_edge(F.col("p_retailprice")), 6).alias("edge"))


@query("""
SELECT user_id, day, rank, score FROM (SELECT user_id, CAST(ts AS DATE) - DATE '2024-01-01' AS day, event_id AS form, round(value, 4) AS score, value,
  row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY CASE WHEN event_type IN ('click', 'view') THEN 0 ELSE 1 END, event_id % 3, value DESC, event_id) AS rank FROM events) WHERE rank = 1
""")
def best_localization(spark, d):
    x = t(spark, d, "events").select("user_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("day"), F.col("event_type").isin("click", "view").alias("is_site_specific"), (F.col("event_id") % 3).alias("n_ambiguous"), F.col("value").alias("score"), F.col("event_id").alias("form"))
    return st.best_localization(x, ["user_id", "day"]).select("user_id", "day", F.lit(1).cast("long").alias("rank"), F.round("score", 4).alias("score"))


# -- traces ------------------------------------------------------------------------------------------------------------

GAUSS = [(k, math.exp(-0.5 * (k / (5 / 6)) ** 2)) for k in range(-2, 3)]
_near = [(f"lead(value, {k}) OVER w" if k >= 0 else f"lag(value, {-k}) OVER w", g) for k, g in GAUSS]


@query(f"""
SELECT user_id, event_id, round(({" + ".join(f"coalesce({c}, 0) * {g!r}" for c, g in _near)}) / ({" + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {g!r} END" for c, g in _near)}), 6) AS smoothed
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def gaussian_average(spark, d):
    e = t(spark, d, "events")
    return e.select("user_id", "event_id", F.round(win.gaussian_average("value", win.over(["user_id"], ["ts", "event_id"]), 5), 6).alias("smoothed"))


@query("""
WITH x AS (SELECT user_id, epoch_us(ts) / 1e6 - 1704067200 AS x, sum(value) AS a, count(*) * 2.0 AS b FROM events GROUP BY ALL),
s AS (SELECT user_id, (x - lag(x) OVER w) * (a + lag(a) OVER w) / 2 AS a, (x - lag(x) OVER w) * (b + lag(b) OVER w) / 2 AS b FROM x WINDOW w AS (PARTITION BY user_id ORDER BY x))
SELECT user_id, round(coalesce(sum(a), 0), 1) AS a, round(coalesce(sum(b), 0), 1) AS b FROM s GROUP BY 1
""")
def isotope_areas(spark, d):
    x = t(spark, d, "events").select("user_id", (micros() - 1704067200).alias("x"), "value").groupBy("user_id", "x").agg(F.sum("value").alias("a"), (F.count(F.lit(1)) * 2.0).cast("double").alias("b"))
    return win.isotope_areas(x, ["user_id"], "x", ["a", "b"]).select("user_id", F.round("a", 1).alias("a"), F.round("b", 1).alias("b"))


@query("""
WITH x AS (SELECT user_id % 10 AS "window", CAST(ts AS DATE) - DATE '2024-01-01' AS cycle, event_type AS mz, sum(value) AS i FROM events GROUP BY ALL),
n AS (SELECT *, CASE WHEN lag("window") OVER w = "window" - 1 THEN lag(i) OVER w ELSE 0 END AS p, CASE WHEN lead("window") OVER w = "window" + 1 THEN lead(i) OVER w ELSE 0 END AS q FROM x WINDOW w AS (PARTITION BY cycle, mz ORDER BY "window"))
SELECT "window", cycle, mz, half, round(part, 4) AS part FROM (SELECT *, 'lower' AS half, i * p / (p + q) AS part FROM n WHERE p + q > 0 UNION ALL SELECT *, 'upper', i * q / (p + q) FROM n WHERE p + q > 0) WHERE part > 0
""")
def demultiplex(spark, d):
    x = t(spark, d, "events").groupBy((F.col("user_id") % 10).alias("window"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("cycle"), F.col("event_type").alias("mz")).agg(F.sum("value").alias("intensity"))
    return win.demultiplex(x, "window", "cycle", "mz", "intensity").select("window", "cycle", "mz", "half", F.round("part", 4).alias("part"))


def trace_table(spark, d):
    e = t(spark, d, "events").select("user_id", F.col("event_type").alias("ion"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("at"), "value")
    grid = e.groupBy("user_id").agg(F.lit(1).alias("__one")).drop("__one").withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(29).cast("long"))))
    grid = grid.withColumn("ion", F.explode(F.array(*[F.lit(k) for k in sorted(r[0] for r in e.select("ion").distinct().collect())])))  # a handful of types
    return grid.join(e.groupBy("user_id", "ion", "at").agg(F.sum("value").alias("v")).hint("merge"), ["user_id", "ion", "at"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


@query("""
WITH u AS (SELECT DISTINCT user_id FROM events), k AS (SELECT DISTINCT event_type AS ion FROM events), dd AS (SELECT range AS day FROM range(30)),
s AS (SELECT user_id, event_type AS ion, CAST(ts AS DATE) - DATE '2024-01-01' AS day, sum(value) AS v FROM events GROUP BY ALL),
g AS (SELECT * FROM u, k, dd),
x AS (SELECT g.user_id, g.ion, g.day, coalesce(v, 0) AS v FROM g LEFT JOIN s ON s.user_id = g.user_id AND s.ion = g.ion AND s.day = g.day),
l AS (SELECT *, sum(v) OVER (PARTITION BY user_id, ion ORDER BY day ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING) AS f FROM x),
h AS (SELECT user_id, ion, day, v, CASE WHEN f > 0 THEN v / f ELSE 0 END AS share FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY share) - 1 AS i, count(*) OVER (PARTITION BY user_id, day) AS n FROM h WHERE share > 0),
p AS (SELECT *, (n - 1) * (1 - 3.0 / n) AS place FROM r WHERE n >= 3),
m AS (SELECT user_id, day, sum(CASE WHEN i = floor(place) THEN share * (1 - (place - floor(place))) WHEN i = floor(place) + 1 THEN share * (place - floor(place)) ELSE 0 END) AS median FROM p GROUP BY ALL),
y AS (SELECT h.user_id, h.ion, h.day, h.v, coalesce(m.median, 0) AS median FROM h LEFT JOIN m ON m.user_id = h.user_id AND m.day = h.day),
c AS (SELECT *, count(*) OVER f AS cnt, corr(v, median) OVER f AS r, stddev_pop(v) OVER f AS sv, stddev_pop(median) OVER f AS sm, lag(median, 2) OVER o AS a, lead(median, 2) OVER o AS z FROM y
  WINDOW f AS (PARTITION BY user_id, ion ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), o AS (PARTITION BY user_id, ion ORDER BY day)),
w AS (SELECT user_id, day, median, CASE WHEN cnt = 5 AND median > a AND median > z AND sv > 0 AND sm > 0 THEN r ELSE 0 END AS r FROM c),
t AS (SELECT user_id, day, max(median) AS median, sum(r) AS s, sum(CAST(CASE WHEN r > 0.9 THEN 1 WHEN r > 0.75 THEN 0.1 WHEN r > 0.5 THEN 0.01 WHEN r > 0 THEN 0.001 ELSE 0 END AS DOUBLE)) AS tiers FROM w GROUP BY ALL),
v AS (SELECT *, avg(s) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS b FROM t)
SELECT user_id, day, round(median, 6) AS median, round(tiers, 4) AS tiers, round((CASE WHEN day = 29 THEN lag(b) OVER (PARTITION BY user_id ORDER BY day) ELSE b END) / 3, 6) AS correlation_sum FROM v
""")
def trace_scores(spark, d):
    out = tracescore.trace_scores(trace_table(spark, d), ["user_id"], "ion", "at", "v", 4)
    return out.select("user_id", F.col("at").alias("day"), F.round("median", 6).alias("median"), F.round("tiers", 4).alias("tiers"), F.round("correlation_sum", 6).alias("correlation_sum"))


@query()
def default_search(spark, d):
    """Users as candidates (of pairs, odd ones decoys), event types as ions, days as scans."""
    x = trace_table(spark, d).select(F.col("user_id").alias("candidate"), F.floor(F.col("user_id") / 2).alias("group"), (F.col("user_id") % 2 == 1).alias("decoy"), F.col("at").alias("scan"), "at", "ion", (F.length("ion") * 1.0).cast("double").alias("predicted"), F.sqrt("v").alias("intensity"))
    return tracescore.default_search(x, 4)


@query("""
WITH x AS (SELECT l_orderkey AS k, l_returnflag AS ion_type, l_linenumber AS ion_index, l_quantity AS predicted, CASE WHEN l_discount > 0.03 THEN l_extendedprice ELSE 0 END AS intensity, l_tax * 100 - 4 + l_partkey / 9712345.7 AS delta, o_totalprice AS tic
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
s AS (SELECT *, count(*) OVER g AS n, row_number() OVER (PARTITION BY k ORDER BY intensity DESC, delta DESC) AS r, sqrt(sum(predicted * predicted) OVER g) AS lp, sqrt(sum(intensity * intensity) OVER g) AS li FROM x WINDOW g AS (PARTITION BY k)),
u AS (SELECT *, predicted / lp AS p, CASE WHEN li > 0 THEN intensity / li ELSE 0 END AS a FROM s),
l AS (SELECT k, max(c) AS ladder FROM (SELECT k, ion_type, count(DISTINCT ion_index) AS c FROM x WHERE intensity > 0 GROUP BY ALL) GROUP BY 1),
f AS (SELECT k, count(*) FILTER (intensity > 0) AS n_matched, count(*) FILTER (intensity > 0 AND intensity > tic / (1 + n * n)) AS n_above, avg(delta) FILTER (r <= 4) AS dm, (sum(abs(delta)) FILTER (r <= 4) + 10 * greatest(0, 3 - count(*) FILTER (r <= 4))) / 3 AS da,
  sum(p * a) AS dot, coalesce(sum((p - a) * (p - a)) FILTER (p > 0 AND a > 0), 0) AS e, sum(intensity) AS s, max(n) AS n FROM u GROUP BY 1)
SELECT k AS l_orderkey, n_matched, n_above, round(dm, 6) AS delta_mean, round(da, 4) AS delta_abs, round(dot, 6) AS dot, coalesce(ladder, 0) AS ladder,
  round(CASE WHEN dot > 0 AND n_matched > 0 THEN greatest(log10(dot) + lgamma(n_matched + 1) / ln(10) + 2, 0) ELSE 0 END, 5) AS hyperscore, round(CASE WHEN e > 1e-12 THEN greatest(0, 1 - ln(e)) ELSE 0 END, 5) AS fit_score,
  round(ln(greatest(1, s * n_matched * (1 + 0.075 * coalesce(ladder, 0)) / n)), 5) AS ln_sp FROM f LEFT JOIN l USING (k)
""")
def library_features(spark, d):
    x = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    x = x.select("l_orderkey", F.col("l_returnflag").alias("ion_type"), F.col("l_linenumber").alias("ion_index"), F.col("l_quantity").alias("predicted"), F.when(F.col("l_discount") > 0.03, F.col("l_extendedprice")).otherwise(F.lit(0.0)).alias("intensity"), (F.col("l_tax") * 100 - 4 + F.col("l_partkey") / 9712345.7).alias("delta"), F.col("o_totalprice").alias("tic"))
    f = tracescore.match_features(x, ["l_orderkey"])
    digits = {"delta_mean": 6, "delta_abs": 4, "dot": 6, "hyperscore": 5, "fit_score": 5, "ln_sp": 5}
    return f.select("l_orderkey", "n_matched", "n_above", "ladder", *[F.round(c, k).alias(c) for c, k in digits.items()])


@query("""
WITH b AS (SELECT p_retailprice AS mass, count(*) AS n FROM part WHERE p_size <= 10 GROUP BY 1), i AS (SELECT p_partkey, p_size, p_retailprice AS mz FROM part),
c AS (SELECT mz, sum(n) AS c FROM (SELECT DISTINCT mz FROM i) JOIN b ON abs(mz - mass) <= greatest(mz, mass) * 300e-6 GROUP BY 1), w AS (SELECT i.*, 100.0 / (1 + coalesce(c, 0)) AS w FROM i LEFT JOIN c ON c.mz = i.mz)
SELECT p_partkey, round(w / sqrt(sum(w * w) OVER (PARTITION BY p_size)), 8) AS weight FROM w
""")
def background_weights(spark, d):
    p = t(spark, d, "part")
    b = p.where("p_size <= 10").groupBy(F.col("p_retailprice").alias("mass")).agg(F.count(F.lit(1)).alias("n"))
    return tracescore.background_weights(p.select("p_partkey", "p_size", F.col("p_retailprice").alias("mz")), b, ["p_size"], "mz", 300).select("p_partkey", F.round("weight", 8).alias("weight"))


@query("""
WITH x AS (SELECT user_id, event_type, event_id, value, lead(value) OVER w AS after, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, event_id))
SELECT user_id, event_id, round(value - coalesce(after, 0), 4) AS margin FROM x WHERE r = 1
""")
def compete(spark, d):
    return tracescore.compete(t(spark, d, "events"), ["user_id"], "value", ["event_id"]).select("user_id", "event_id", F.round("margin", 4).alias("margin"))


# -- libraries and runs ------------------------------------------------------------------------------------------------


@query("""
WITH e AS (SELECT l_partkey AS modseq, l_linenumber AS charge, l_suppkey AS source, max(l_extendedprice) AS score FROM lineitem GROUP BY ALL),
l AS (SELECT l_partkey AS modseq, l_linenumber AS charge, l_suppkey AS source, max(l_quantity) AS ls, bool_or(l_returnflag = 'R') AS ok FROM lineitem GROUP BY ALL),
b AS (SELECT DISTINCT o_custkey % 2000 AS seq, o_orderpriority AS accession FROM orders WHERE o_orderstatus <> 'F')
SELECT modseq, charge, source, score, ls AS localization_score, accessions FROM e JOIN l USING (modseq, charge, source) JOIN (SELECT seq, string_agg(accession, ';' ORDER BY accession) AS accessions FROM b GROUP BY 1) ON seq = modseq WHERE ls >= 30 AND ok
""")
def localized_entries(spark, d):
    x = t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("modseq"), F.col("l_linenumber").alias("charge"), F.col("l_suppkey").alias("source")).agg(F.max("l_extendedprice").alias("score"), F.max("l_quantity").alias("localization_score"), F.bool_or(F.col("l_returnflag") == "R").alias("is_localized"))
    bridge = t(spark, d, "orders").select((F.col("o_custkey") % 2000).alias("seq"), F.col("o_orderpriority").alias("accession"), (F.col("o_orderstatus") == "F").alias("is_decoy"))
    entries = x.select("modseq", "charge", "source", "score").withColumn("seq", F.col("modseq"))
    return reports.localized_entries(x.drop("score"), entries, bridge, 30).select("modseq", "charge", "source", "score", "localization_score", "accessions")


@query("""
SELECT g AS protein_group, string_agg(DISTINCT CAST(s AS VARCHAR), ';' ORDER BY CAST(s AS VARCHAR)) AS accessions, min(q) AS q, min(e) AS least_error, bool_or(dec) AS is_decoy, count(DISTINCT l_partkey) AS sequences
FROM (SELECT s_suppkey AS s, s_suppkey % 40 AS g, s_acctbal AS q, s_acctbal / 2 AS e, s_nationkey = 3 AS dec FROM supplier) LEFT JOIN lineitem ON l_suppkey = s GROUP BY 1
""")
def stored_groups(spark, d):
    scores = t(spark, d, "supplier").select((F.col("s_suppkey") % 40).alias("protein_group"), F.col("s_suppkey").cast("string").alias("accession"), F.col("s_acctbal").alias("q"), (F.col("s_acctbal") / 2).alias("least_error"), (F.col("s_nationkey") == 3).alias("is_decoy"))
    bridge = t(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("accession"), F.col("l_partkey").alias("seq")).distinct()
    return reports.stored_groups(scores, bridge)


@query("""
SELECT p_brand, p_size, round(avg(p_retailprice), 6) AS mean_rt, round(quantile_cont(p_retailprice, 0.5), 6) AS median_rt, count(*) AS n FROM part WHERE p_partkey % 4 <> 0 GROUP BY ALL
""")
def sequence_times(spark, d):
    out = reports.sequence_times(t(spark, d, "part"), ["p_brand", "p_size"], "p_retailprice", F.col("p_partkey") % 4 == 0)
    return out.select("p_brand", "p_size", F.round("mean_rt", 6).alias("mean_rt"), F.round("median_rt", 6).alias("median_rt"), "n")


@query("""
SELECT event_id FROM events WHERE event_type <> 'purchase' ORDER BY ts, event_id LIMIT (SELECT count(*) FROM events WHERE event_type = 'purchase')
""")
def as_many_decoys(spark, d):
    e = t(spark, d, "events")
    return reports.as_many_decoys(e.where("event_type = 'purchase'"), e.where("event_type <> 'purchase'"), ["ts", "event_id"]).select("event_id")


@query("""
WITH p AS (SELECT p_brand AS s, p_retailprice AS mz, CAST(sum(p_size) AS DOUBLE) AS i FROM part WHERE p_size < 40 GROUP BY ALL), t AS (SELECT DISTINCT p_brand AS s, p_retailprice AS t FROM part WHERE p_size >= 40 AND p_brand <> 'Brand#11'),
l AS (SELECT * FROM p WHERE s IN (SELECT s FROM t)),
n AS (SELECT l.s, mz, t FROM l JOIN t ON l.s = t.s AND abs(mz - t) <= greatest(mz, t) * 500e-6 QUALIFY row_number() OVER (PARTITION BY l.s, t ORDER BY abs(mz - t), mz) = 1)
SELECT s AS modseq, mz, i AS intensity, EXISTS (SELECT 1 FROM n WHERE n.s = l.s AND n.mz = l.mz) AS quantified FROM l
UNION ALL SELECT s, t, 1e-30, true FROM t WHERE s IN (SELECT s FROM l) AND NOT EXISTS (SELECT 1 FROM n WHERE n.s = t.s AND n.t = t.t)
""")
def sample_library(spark, d):
    p = t(spark, d, "part")
    peaks = p.where("p_size < 40").groupBy(F.col("p_brand").alias("modseq"), F.col("p_retailprice").alias("mz")).agg(F.sum("p_size").cast("double").alias("intensity"))
    return reports.sample_library(peaks, p.where("p_size >= 40 and p_brand <> 'Brand#11'").select(F.col("p_brand").alias("modseq"), F.col("p_retailprice").alias("target")), 500)


@query("""
WITH x AS (SELECT user_id, epoch_us(ts) / 1e6 - 1704067200 AS rt, sum(value) AS y FROM events GROUP BY ALL), b AS (SELECT user_id, 86400.0 * (user_id % 5) AS a, 86400.0 * (user_id % 5 + 9) AS z FROM (SELECT DISTINCT user_id FROM events)),
i AS (SELECT x.* FROM x JOIN b USING (user_id) WHERE rt BETWEEN a AND z), e AS (SELECT *, least(first_value(y) OVER w, last_value(y) OVER w) AS low FROM i WINDOW w AS (PARTITION BY user_id ORDER BY rt ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
s AS (SELECT user_id, (rt - lag(rt) OVER w) * (y + lag(y) OVER w) / 2 AS t, (rt - lag(rt) OVER w) * (least(y, low) + lag(least(y, low)) OVER w) / 2 AS u FROM e WINDOW w AS (PARTITION BY user_id ORDER BY rt))
SELECT b.user_id, round(coalesce(sum(t), 0), 0) AS area, round(coalesce(sum(u), 0), 0) AS background, round(coalesce(sum(t), 0) - coalesce(sum(u), 0), 0) AS net FROM b LEFT JOIN s USING (user_id) GROUP BY 1
""")
def reintegrate(spark, d):
    x = t(spark, d, "events").select("user_id", (micros() - 1704067200).alias("rt"), "value").groupBy("user_id", "rt").agg(F.sum("value").alias("intensity"))
    b = x.select("user_id").distinct().select("user_id", (86400.0 * (F.col("user_id") % 5)).alias("start"), (86400.0 * (F.col("user_id") % 5 + 9)).alias("stop"))
    return reports.reintegrate(x, b, ["user_id"]).select("user_id", *[F.round(c, 0).alias(c) for c in ("area", "background", "net")])


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice + least(l_quantity * 1000, l_extendedprice * 0.6 / 1.0 * 1.5) + least(l_tax * 100000, l_extendedprice * 0.2 / 1.0 * 1.5), 3) AS total,
  CAST(l_quantity * 1000 > l_extendedprice * 0.6 / 1.0 * 1.5 AS INTEGER) + CAST(l_tax * 100000 > l_extendedprice * 0.2 / 1.0 * 1.5 AS INTEGER) AS cut FROM lineitem
""")
def capped_isotopes(spark, d):
    x = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("i0"), (F.col("l_quantity") * 1000).alias("i1"), (F.col("l_tax") * 100000).alias("i2"), F.lit(1.0).cast("double").alias("e0"), F.lit(0.6).cast("double").alias("e1"), F.lit(0.2).cast("double").alias("e2"))
    return reports.capped_isotopes(x, ["l_orderkey", "l_linenumber", "l_partkey"], ["i0", "i1", "i2"], ["e0", "e1", "e2"]).withColumn("total", F.round("total", 3))


@query("""
WITH x AS (SELECT event_id, event_type, value - 100 AS y, user_id % 3 = 0 AS decoy FROM events), n AS (SELECT event_type, avg(y) AS m, stddev_pop(y) AS s FROM x WHERE decoy GROUP BY 1),
k AS (SELECT * FROM x WHERE NOT decoy QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY abs(y) DESC, y) > floor(count(*) OVER (PARTITION BY event_type) / 20)), o AS (SELECT event_type, avg(y) AS m, stddev_pop(y) AS s FROM k GROUP BY 1),
p AS (SELECT event_id, exp(-0.5 * ((y - o.m) / o.s) ** 2) / (o.s * sqrt(2 * pi())) AS a, exp(-0.5 * ((y - n.m) / n.s) ** 2) / (n.s * sqrt(2 * pi())) AS b FROM x JOIN o USING (event_type) JOIN n USING (event_type))
SELECT event_id, round(CASE WHEN a + b > 0 THEN a / (a + b) ELSE 0 END, 8) AS probability, (CASE WHEN a + b > 0 THEN a / (a + b) ELSE 0 END) >= 0.05 AS passes FROM p
""")
def target_decoy_times(spark, d):
    x = t(spark, d, "events").select("event_id", "event_type", (F.col("value") - 100).alias("y"), (F.col("user_id") % 3 == 0).alias("decoy"))
    return reports.target_decoy_times(x, ["event_type"], "y", F.col("decoy")).select("event_id", F.round("probability", 8).alias("probability"), "passes")


@query("""
WITH x AS (SELECT l_orderkey AS k, l_partkey AS ion, sum(CASE WHEN l_discount > 0.02 THEN l_extendedprice ELSE 0 END) AS i FROM lineitem GROUP BY ALL)
SELECT k AS l_orderkey, count(DISTINCT ion) AS ions, round(sum(i), 2) AS signal FROM x WHERE i > 0 GROUP BY 1 HAVING count(DISTINCT ion) >= 2
""")
def ion_counts(spark, d):
    x = t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_discount", "l_extendedprice")
    # Nearly as many ions as rows: dealt out once, so that no task adds up more than about a million.
    x = x.repartition(ranges_for(x, 1_000_000) + spark.sparkContext.defaultParallelism, "l_orderkey")
    x = x.groupBy("l_orderkey", F.col("l_partkey").alias("ion_mz")).agg(F.sum(F.when(F.col("l_discount") > 0.02, F.col("l_extendedprice")).otherwise(F.lit(0.0))).alias("intensity"))
    return reports.ion_counts(x, ["l_orderkey"], 2).withColumn("signal", F.round("signal", 2))


@query("""
WITH s AS (SELECT '^' || replace(p_name, ' ', '') || '$' AS s FROM part), i AS (SELECT s, unnest(range(1, len(s))) AS i FROM s)
SELECT substr(s, i, 1) AS context, substr(s, i + 1, 1) AS next, count(*) AS n FROM i GROUP BY ALL
""")
def transition_counts(spark, d):
    return reports.transition_counts(t(spark, d, "part").select(F.replace("p_name", F.lit(" "), F.lit("")).alias("s")), "s")


@query("""
WITH g AS (SELECT l_suppkey % 5 AS sample, l_partkey AS modseq, l_linenumber AS charge, l_suppkey AS run, max(l_extendedprice) AS score FROM lineitem GROUP BY ALL)
SELECT sample, modseq, charge, run, score FROM g QUALIFY row_number() OVER (PARTITION BY sample, modseq, charge ORDER BY score DESC, run) = 1
""")
def group_libraries(spark, d):
    x = t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("modseq"), F.col("l_linenumber").alias("charge"), F.col("l_suppkey").alias("run")).agg(F.max("l_extendedprice").alias("score"))
    groups = x.select("run", (F.col("run") % 5).alias("sample")).distinct()
    return reports.group_libraries(x, groups).select("sample", "modseq", "charge", "run", "score")


# -- notation ----------------------------------------------------------------------------------------------------------


@query(f"""
SELECT p_partkey, replace(replace({MODSEQ}, '[+57.02]', '[+57.021464]'), '[+79.97]', '[+79.966331]') AS canonical, CAST(CASE p_partkey % 3 WHEN 0 THEN 79.966331 WHEN 1 THEN 15.994915 END AS DOUBLE) AS mass,
  CASE p_partkey % 3 WHEN 0 THEN 'Phospho' WHEN 1 THEN 'Oxidation' END AS name FROM part
""")
def canonical_masses(spark, d):
    from peakfold.plans.catalog import modseq

    k = F.col("p_partkey") % 3
    given = F.when(k == 0, F.lit("PHOSPHO")).when(k == 1, F.lit("oxidation")).otherwise(F.lit("nothing"))
    mass = F.when(k == 0, F.lit(79.97)).when(k == 1, F.lit(15.99)).otherwise(F.lit(3.0)).cast("double")
    return t(spark, d, "part").select("p_partkey", notation.canonical_masses(modseq()).alias("canonical"), notation.modification_mass(given).alias("mass"), notation.nearest_modification(mass)["name"].alias("name"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, lower(l_returnflag) || l_linenumber || CASE l_suppkey % 3 WHEN 1 THEN '++' WHEN 2 THEN '+++' ELSE '' END AS name, lower(l_returnflag) AS kind, l_linenumber AS index, CAST(l_suppkey % 3 + 1 AS INTEGER) AS charge,
  lower(l_returnflag) || '|' || l_linenumber || '|' || l_suppkey AS archived, CAST(l_suppkey AS DOUBLE) AS mass FROM lineitem
""")
def ion_names(spark, d):
    x = t(spark, d, "lineitem").withColumn("name", notation.ion_name(F.lower("l_returnflag"), F.col("l_linenumber"), (F.col("l_suppkey") % 3 + 1).cast("int")))
    x = x.withColumn("p", notation.parse_ion(F.col("name"))).withColumn("a", notation.archive(F.array(F.struct(F.lower("l_returnflag").alias("kind"), F.col("l_linenumber").alias("index"), F.col("l_suppkey").alias("mass")))))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "name", "p.kind", "p.index", "p.charge", F.col("a").alias("archived"), notation.from_archive(F.col("a"))[0]["mass"].alias("mass"))


# -- expressions -------------------------------------------------------------------------------------------------------


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_tax > 0 THEN ln(l_tax) ELSE 0 END, 8) AS ln, round(CASE WHEN l_quantity > 25 THEN log2(l_quantity - 25) ELSE 0 END, 8) AS log2, round(10 + (l_quantity - 1) / 49 * 90, 6) AS mapped,
  round(CASE WHEN l_tax = 0.04 THEN (l_quantity + l_discount) / 2 ELSE l_quantity + (l_discount - l_quantity) * 0.01 / (0.04 - l_tax) END, 6) AS between, round(l_extendedprice * 20e-6, 9) AS width, round((l_extendedprice - o_totalprice) / o_totalprice * 1e6, 3) AS ppm,
  abs(l_extendedprice - o_totalprice) <= greatest(l_extendedprice, o_totalprice) * 0.2 AS close FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""")
def scalar_maps(spark, d):
    x = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    c = F.col
    return x.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(A.protected_log(c("l_tax")), 8).alias("ln"), F.round(A.protected_log(c("l_quantity") - 25, 2), 8).alias("log2"), F.round(A.map_range(c("l_quantity"), 1, 50, 10, 100), 6).alias("mapped"),
        F.round(F.when(c("l_tax") == 0.04, (c("l_quantity") + c("l_discount")) / 2).otherwise(A.interpolate(F.lit(0.01).cast("double"), F.lit(0.0).cast("double"), c("l_quantity"), F.lit(0.04).cast("double") - c("l_tax"), c("l_discount"))), 6).alias("between"),
        F.round(A.tolerance(c("l_extendedprice"), ppm=20), 9).alias("width"), F.round(A.delta_ppm(c("l_extendedprice"), c("o_totalprice")), 3).alias("ppm"), A.within_ppm(c("l_extendedprice"), c("o_totalprice"), 2e5).alias("close"),
    )


@query("""
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings), v AS (SELECT *, list_reverse(a) AS b FROM e)
SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: (a[i] + b[i]) * abs(a[i]))), 6) AS added, round(list_sum(list_transform(range(1, 65), lambda i: a[i] * b[i])), 6) AS dot, round(list_sum(list_transform(range(1, 65), lambda i: a[i] * 2.5)), 6) AS scaled,
  round(list_sum(list_transform(range(1, 65), lambda i: abs(a[i]) / (1 + abs(b[i])))), 6) AS ratio, round(list_sum(list_sort(a, 'DESC')[1:5]), 6) AS top, round(sqrt(list_var_pop(a)), 6) AS sd FROM v
""")
def array_arithmetic(spark, d):
    x = t(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a")).withColumn("b", F.reverse("a"))
    a, b = F.col("a"), F.col("b")
    size = lambda v: F.transform(v, lambda y: F.abs(y))
    return x.select(
        "vec_id", F.round(A.total(A.multiply(A.add(a, b), size(a))), 6).alias("added"), F.round(A.total(A.multiply(a, b)), 6).alias("dot"), F.round(A.total(A.scale(a, 2.5)), 6).alias("scaled"),
        F.round(A.total(A.divide(size(a), F.transform(size(b), lambda y: 1 + y))), 6).alias("ratio"), F.round(A.top_sum(a, 5), 6).alias("top"), F.round(A.stdev(a), 6).alias("sd"),
    )


@query("""
WITH p AS (SELECT vec_id, i * 10.0 AS mz, abs(CAST(embedding[i] AS DOUBLE)) AS y FROM embeddings, (SELECT unnest(range(1, 65)) AS i))
SELECT vec_id, round(sum(y), 6) AS total, count(*) FILTER (mz BETWEEN 100 AND 300) AS trimmed, count(*) FILTER (y >= 0.5 * m) AS strong, round(coalesce(sum(y) FILTER (abs(mz - 200.05) <= 200.05 * 60000e-6), 0), 6) AS near, round(coalesce(max(y) FILTER (abs(mz - 200.05) <= 200.05 * 60000e-6), 0), 6) AS top_near
FROM (SELECT *, max(y) OVER (PARTITION BY vec_id) AS m FROM p) GROUP BY 1
""")
def peak_filters(spark, d):
    mz = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: i * F.lit(10.0).cast("double"))
    x = t(spark, d, "embeddings").select("vec_id", A.peaks(mz, F.transform("embedding", lambda y: F.abs(y.cast("double")))).alias("p"))
    p, at = F.col("p"), F.lit(200.05).cast("double")
    return x.select("vec_id", F.round(A.peak_total(p), 6).alias("total"), F.size(A.trim(p, 100, 300)).cast("long").alias("trimmed"), F.size(A.base_peak_filter(p, 0.5)).cast("long").alias("strong"), F.round(A.intensity_near(p, at, 60000), 6).alias("near"), F.round(A.max_intensity_near(p, at, 60000), 6).alias("top_near"))


@query("""
WITH x AS (SELECT event_id, CAST(event_id * 1103515245 AS HUGEINT) + 12345 AS v FROM events), w AS (SELECT event_id, CAST(((v + 2147483648) % 4294967296) - 2147483648 AS BIGINT) % 2147483647 AS r FROM x)
SELECT event_id, CAST(r AS INTEGER) AS random, round((r / 2147483647.0 + 1) / 2, 9) AS share FROM w
""")
def lcg_steps(spark, d):
    r = seq.lcg(F.col("event_id").cast("int"))
    return t(spark, d, "events").select("event_id", r.alias("random"), F.round(seq.unit_interval(r), 9).alias("share"))


@query("""
SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(p_type || ' ' || p_name || ' ' || p_type, ' '))), ';') AS accessions FROM part
""")
def accession_sets(spark, d):
    joined = F.concat_ws(";", F.replace("p_type", F.lit(" "), F.lit(";")), F.replace("p_name", F.lit(" "), F.lit(";")), F.replace("p_type", F.lit(" "), F.lit(";")))
    return t(spark, d, "part").select("p_partkey", F.array_join(seq.accessions(joined), ";").alias("accessions"))


@query("""
SELECT p_partkey FROM part a WHERE NOT EXISTS (SELECT 1 FROM part x WHERE x.p_size = 7 AND a.p_retailprice BETWEEN x.p_retailprice - 0.5 AND x.p_retailprice + 0.5 AND a.p_size BETWEEN x.p_partkey % 20 AND x.p_partkey % 20 + 25)
""")
def exclude_ions(spark, d):
    from peakfold.operators import features

    p = t(spark, d, "part")
    x = p.where("p_size = 7").select((F.col("p_retailprice") - 0.5).alias("x_low"), (F.col("p_retailprice") + 0.5).alias("x_high"), (F.col("p_partkey") % 20).alias("x_start"), (F.col("p_partkey") % 20 + 25).alias("x_stop"))
    return features.exclude_ions(p.select("p_partkey", F.col("p_retailprice").alias("mz"), F.col("p_size").alias("rt")), x, 1.0).select("p_partkey")


@query(f"""
SELECT p_partkey, regexp_matches({MODSEQ}, '[ST]\\[') AS any_mod, regexp_matches({MODSEQ}, 'C\\[\\+?57\\.02[0-9]*\\]') AS alkylated, regexp_replace({MODSEQ}, 'M', 'M[+15.99]', 'g') AS fixed FROM part
""")
def modification_filters(spark, d):
    from peakfold.operators import features
    from peakfold.plans.catalog import modseq

    return t(spark, d, "part").select("p_partkey", features.has_modification(modseq(), "ST").alias("any_mod"), features.has_modification(modseq(), "C", "57.02").alias("alkylated"), features.apply_mass_map(modseq(), {"M": 15.99}).alias("fixed"))


@query("""
WITH s AS (SELECT p_partkey AS id, replace(upper(p_name), ' ', '') AS s FROM part), v AS (SELECT id, s, p_size AS pos FROM s JOIN part ON id = p_partkey WHERE p_size BETWEEN 1 AND len(s))
SELECT id AS accession, id || '_' || pos || 'WK' AS variant, substr(s, 1, pos - 1) || 'WK' || substr(s, pos + 1) AS sequence FROM v
""")
def variant_sequences(spark, d):
    from peakfold.operators import features

    p = t(spark, d, "part")
    proteins = p.select(F.col("p_partkey").alias("accession"), F.replace(F.upper("p_name"), F.lit(" "), F.lit("")).alias("sequence"))
    return features.variant_sequences(proteins, p.select(F.col("p_partkey").alias("accession"), F.col("p_size").alias("position"), F.lit("WK").alias("residues"))).select("accession", "variant", "sequence")


@query("""
WITH x AS (SELECT p_size, replace(upper(p_name), ' ', '') AS s, max(p_retailprice) AS v FROM part GROUP BY ALL), b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY p_size ORDER BY v DESC, s) = 1),
o AS (SELECT b.p_size, b.s, b.v, x.v AS w FROM b JOIN x USING (p_size) WHERE len(x.s) <> len(b.s) OR len(list_filter(range(1, len(b.s) + 1), lambda i: translate(x.s, 'INEK', 'LDQQ')[i] <> translate(b.s, 'INEK', 'LDQQ')[i])) > 2)
SELECT b.p_size, b.s AS sequence, round(b.v - coalesce(max(w), 0), 4) AS margin FROM b LEFT JOIN o ON o.p_size = b.p_size GROUP BY b.p_size, b.s, b.v
""")
def dissimilar_margin(spark, d):
    from peakfold.operators import features

    x = t(spark, d, "part").groupBy("p_size", F.replace(F.upper("p_name"), F.lit(" "), F.lit("")).alias("sequence")).agg(F.max("p_retailprice").alias("v"))
    return features.sequence_per_candidate_margin(x, ["p_size"], "sequence", "v").select("p_size", "sequence", F.round("margin", 4).alias("margin"))


@query("""
WITH b AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s FROM events WHERE event_id % 2 = 0 GROUP BY 1)
SELECT event_id, round((value - m) / s, 7) AS z FROM events JOIN b USING (event_type)
""")
def z_scores(spark, d):
    from peakfold.operators import features

    e = t(spark, d, "events")
    return features.z_scores(e, agg.background(e.where("event_id % 2 = 0"), ["event_type"], "value"), ["event_type"], "value").select("event_id", F.round("z", 7).alias("z"))


@query("""
SELECT event_id, round(exp(-0.5 * ((value - 100) / 40) ** 2) / (40 * sqrt(2 * pi())), 10) AS gaussian, round(exp(-abs(value - 100) / 40) / 80, 10) AS laplace, round(CASE WHEN value < 100 THEN 0.5 * exp(-abs(value - 100) / 40) ELSE 1 - 0.5 * exp(-abs(value - 100) / 40) END, 10) AS laplace_cdf,
  round(1 / (pi() * 40 * (1 + ((value - 100) / 40) ** 2)), 10) AS cauchy, round(exp(-(value - 100) / 40 - exp(-(value - 100) / 40)) / 40, 10) AS gumbel, round(exp(-exp(-(value - 100) / 40)), 10) AS gumbel_cdf,
  round(value * exp(-value / 40) / 1600, 10) AS gamma, round(CASE WHEN abs(value - 100) <= 80 THEN pi() / 320 * cos((100 - value) * pi() / 160) ELSE 0 END, 10) AS bell, round(greatest(0, least(1, (value - 50) / 100)), 10) AS uniform FROM events
""")
def densities(spark, d):
    from peakfold.functions import distributions as D

    v = F.col("value")
    cols = {"gaussian": D.gaussian_pdf(v, 100, 40), "laplace": D.laplace_pdf(v, 100, 40), "laplace_cdf": D.laplace_cdf(v, 100, 40), "cauchy": D.cauchy_pdf(v, 100, 40), "gumbel": D.gumbel_pdf(v, 100, 40), "gumbel_cdf": D.gumbel_cdf(v, 100, 40), "gamma": D.gamma_pdf(v, 2, 40), "bell": D.cosine_gaussian_pdf(v, 100, 40), "uniform": D.uniform_cdf(v, 50, 150)}
    return t(spark, d, "events").select("event_id", *[F.round(c, 10).alias(n) for n, c in cols.items()])
