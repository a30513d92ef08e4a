"""Named queries of quantification with their SQL (see `catalog` for what stands in for what)."""

from __future__ import annotations

from pyspark.sql import functions as F

from peakfold.operators import alignment, features, merging, tracescore, variants
from peakfold.operators import quantitation as quant
from peakfold.plans import transfer
from peakfold.plans.catalog import query, t
from peakfold.plans.catalog_more import trace_table

#: Users' events a day and type, dense over days and types.
TRACES = """
u AS (SELECT DISTINCT user_id FROM events), e AS (SELECT DISTINCT event_type AS ion FROM events),
sv AS (SELECT user_id, event_type AS ion, CAST(ts AS DATE) - DATE '2024-01-01' AS x, sum(value) AS v FROM events GROUP BY ALL),
tr AS (SELECT g.user_id AS k, g.ion, g.x, coalesce(sv.v, 0) AS v FROM (SELECT u.user_id, e.ion, r.range AS x FROM u, e, range(30) r) g LEFT JOIN sv USING (user_id, ion, x))"""


def range_sql(p: str, source: str, width: float) -> str:
    """CTEs that end in {p}r (k, a, z, apex): the peak of each trace of `source` (k, x, y), three points at least."""
    grow = ""
    for j in (0, 1):
        grow += f""",
{p}g{j + 1} AS (SELECT k, n, apex, ys, CASE WHEN NOT stay AND lft THEN a - 1 ELSE a END AS a, CASE WHEN stay OR lft THEN z ELSE z + 1 END AS z, CASE WHEN stay THEN f WHEN lft THEN false ELSE f OR l = r END AS f
  FROM (SELECT *, z - a + 1 >= least(3, n) AS stay, l > r OR (l = r AND f) AS lft FROM (SELECT *, CASE WHEN a > 0 THEN ys[a] ELSE -1 END AS l, CASE WHEN z + 1 < n THEN ys[z + 2] ELSE -1 END AS r FROM {p}g{j})))"""
    return f"""
{p}i AS (SELECT k, x, y, row_number() OVER (PARTITION BY k ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY k) AS n, max(y) OVER (PARTITION BY k) AS top, x - lag(x) OVER (PARTITION BY k ORDER BY x) AS d FROM {source}),
{p}s AS (SELECT k, any_value(n) AS n, any_value(top) AS top, greatest(0.2 * {width}, coalesce(2.1 * median(d), 0)) AS lim, CASE WHEN bool_or(y = top AND i = (n - 1) // 2) THEN any_value((n - 1) // 2) ELSE min(i) FILTER (y = top) END AS apex, list(y ORDER BY i) AS ys FROM {p}i GROUP BY k),
{p}w AS (SELECT i.k, i.x, i.y, i.i, s.n, s.top, s.lim, s.apex, e.side, abs(i.i - s.apex) AS far FROM {p}i i JOIN {p}s s USING (k), (VALUES (-1), (1)) e(side) WHERE sign(i.i - s.apex) IN (0, e.side)),
{p}l AS (SELECT *, min({{'y': y, 'f': far, 'x': x, 'i': i}}) OVER (PARTITION BY k, side ORDER BY far ROWS UNBOUNDED PRECEDING) AS low FROM {p}w),
{p}h AS (SELECT k, side, coalesce(min({{'f': far, 'at': CASE WHEN up THEN low.i ELSE i + side END}}) FILTER (up OR under), max({{'f': far, 'at': low.i}})) AS hit, any_value(n) AS n
  FROM (SELECT *, abs(x - low.x) > lim AND 2 * low.y < top AS up, far > 0 AND y < 0.01 * top AS under FROM {p}l) GROUP BY k, side),
{p}g0 AS (SELECT h.k, s.n, s.apex, s.ys, max(greatest(0, least(h.hit.at, s.n - 1))) FILTER (side < 0) AS a, max(greatest(0, least(h.hit.at, s.n - 1))) FILTER (side > 0) AS z, true AS f FROM {p}h h JOIN {p}s s USING (k) GROUP BY ALL){grow},
{p}r AS (SELECT k, a, z, apex FROM {p}g2)"""


def local_sql(p: str, source: str, width: float) -> str:
    """CTEs that end in {p}n (k, ion, x, v, q, y, a, z): shares and their median within the peak, and the peak of that; x are places."""
    return f"""
{p}p AS (SELECT k, ion, x, v, CASE WHEN s <> 0 THEN v / s ELSE 0 END AS q FROM (SELECT *, sum(v) OVER (PARTITION BY k, ion) AS s FROM {source})),
{p}m AS (SELECT k, x, round(median(q), 12) AS y FROM {p}p GROUP BY k, x),{range_sql(p + "0", p + "m", width)},
{p}q AS (SELECT k, ion, x, v, CASE WHEN s <> 0 THEN v / s ELSE 0 END AS q FROM (SELECT o.*, sum(v) FILTER (x BETWEEN a AND z) OVER (PARTITION BY k, ion) AS s FROM {source} o JOIN {p}0r USING (k))),
{p}o AS (SELECT k, x, round(median(q), 12) AS y FROM {p}q GROUP BY k, x),{range_sql(p + "1", p + "o", width)},
{p}n AS (SELECT q.*, o.y, r.a, r.z FROM {p}q q JOIN {p}o o USING (k, x) JOIN {p}1r r USING (k))"""


def area_sql(source: str, out: str) -> str:
    """CTE `out` (k, ion, correlation, area, background) from rows (k, ion, x, v, q, y) within the range; q is correlated with y."""
    return f"""
{out}e AS (SELECT *, least(first(v) OVER o, last(v) OVER o) AS base FROM {source} WINDOW o AS (PARTITION BY k, ion ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
{out}t AS (SELECT *, (x - lag(x) OVER w) * (v + lag(v) OVER w) / 2 AS t, (x - lag(x) OVER w) * (least(v, base) + least(lag(v) OVER w, base)) / 2 AS u FROM {out}e WINDOW w AS (PARTITION BY k, ion ORDER BY x)),
{out} AS (SELECT k, ion, round(CASE WHEN var_pop(q) > 1e-12 * avg(q * q) AND var_pop(y) > 1e-12 * avg(y * y) THEN least(1, corr(q, y)) ELSE 0 END, 9) AS correlation, coalesce(sum(t), 0) AS area, coalesce(sum(u), 0) AS background FROM {out}t GROUP BY k, ion)"""


REFINED = f"""{TRACES},{local_sql("f", "tr", 8)},
fi AS (SELECT * FROM fn WHERE x BETWEEN a AND z),{area_sql("fi", "ar")},
rk AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY correlation DESC, ion) AS r FROM ar),
ls AS (SELECT k, min(correlation) FILTER (r <= 3 OR (r <= 5 AND correlation >= 0.5)) AS least FROM rk GROUP BY k),
se AS (SELECT ar.*, correlation >= least AS selected FROM ar JOIN ls USING (k)),
sl AS (SELECT tr.* FROM tr JOIN se USING (k, ion) WHERE selected),{local_sql("g", "sl", 8)},
ends AS (SELECT DISTINCT k, a, z FROM gn)"""


@query(f"""
WITH src AS (SELECT user_id AS k, CAST(epoch_us(ts) AS DOUBLE) / 3.6e9 AS x, value AS y FROM (SELECT user_id, ts, max(value) AS value FROM events GROUP BY ALL)),{range_sql("p", "src", 100.0)}
SELECT r.k AS user_id, round(a.x, 6) AS start, round(z.x, 6) AS stop, round(m.x, 6) AS apex, r.z - r.a + 1 AS points FROM pr r JOIN pi a ON a.k = r.k AND a.i = r.a JOIN pi z ON z.k = r.k AND z.i = r.z JOIN pi m ON m.k = r.k AND m.i = r.apex
""")
def peak_ranges(spark, d):
    """Users' events in hours: the peak of each user."""
    e = t(spark, d, "events").groupBy("user_id", "ts").agg(F.max("value").alias("value")).select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).alias("x"), "value")
    return quant.peak_ranges(e, ["user_id"], "x", "value", 100.0).select("user_id", *[F.round(c, 6).alias(c) for c in ("start", "stop", "apex")], "points")


@query(f"""
WITH {REFINED}
SELECT k AS user_id, ion, round(correlation, 6) AS correlation, correlation >= 0.9 AS quantitative, round(area, 4) AS area, round(background, 4) AS background, selected, CAST(a AS DOUBLE) AS start, CAST(z AS DOUBLE) AS stop FROM se JOIN ends USING (k)
""")
def refine_transitions(spark, d):
    """Users as candidates, event types as transitions, days as scans."""
    r = quant.refine_transitions(trace_table(spark, d), ["user_id"], "ion", "at", "v", 8.0)
    return r.select("user_id", "ion", F.round("correlation", 6).alias("correlation"), "quantitative", F.round("area", 4).alias("area"), F.round("background", 4).alias("background"), "selected", "start", "stop")


@query(f"""
WITH {REFINED},
us AS (SELECT *, bool_or(correlation >= 0.9) OVER (PARTITION BY k) AS good FROM se),
qu AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY correlation DESC, ion) AS r FROM us WHERE CASE WHEN good THEN correlation >= 0.9 ELSE selected END)
SELECT k AS user_id, round(sum(greatest(area - background, 0)), 4) AS intensity, count(*) AS n_ions, string_agg(ion, ',' ORDER BY r) AS ions, round(avg(correlation), 6) AS correlation, CAST(any_value(a) AS DOUBLE) AS start, CAST(any_value(z) AS DOUBLE) AS stop FROM qu JOIN ends USING (k) WHERE r <= 5 GROUP BY k
""")
def quantities(spark, d):
    """One quantity a user, of its refined transitions."""
    r = quant.quantified(quant.refine_transitions(trace_table(spark, d), ["user_id"], "ion", "at", "v", 8.0), ["user_id"], "ion")
    return r.select("user_id", F.round("intensity", 4).alias("intensity"), "n_ions", "ions", F.round("correlation", 6).alias("correlation"), "start", "stop")


@query(f"""
WITH {TRACES},
po AS (SELECT k, 2 + x // 15 AS charge, dense_rank() OVER (ORDER BY ion) - 1 AS isotope, CAST(x % 15 AS DOUBLE) AS x, v FROM tr),
sh AS (SELECT *, 1 / (1 + isotope * (k % 3 + 1) / 4) AS share FROM po),
sc AS (SELECT *, min(CASE WHEN share > 0.5 THEN v / share END) OVER (PARTITION BY k, charge, x) AS scale FROM sh),
pu AS (SELECT *, least(v, scale * share) AS pure FROM sc),
sg AS (SELECT *, greatest(0, (-21 * lag(pure, 4, 0) OVER w + 14 * lag(pure, 3, 0) OVER w + 39 * lag(pure, 2, 0) OVER w + 54 * lag(pure, 1, 0) OVER w + 59 * pure + 54 * lead(pure, 1, 0) OVER w + 39 * lead(pure, 2, 0) OVER w + 14 * lead(pure, 3, 0) OVER w - 21 * lead(pure, 4, 0) OVER w) / 231) AS smooth
  FROM pu WINDOW w AS (PARTITION BY k, charge, isotope ORDER BY x)),
so AS (SELECT *, max(smooth) OVER (PARTITION BY k) > 0 AS capped FROM sg),
un AS (SELECT k, charge, isotope, x, capped, CASE WHEN capped THEN smooth ELSE v END AS v FROM so WHERE capped OR isotope <= 1),
nm AS (SELECT *, CASE WHEN max(v) OVER (PARTITION BY k, charge, isotope) > 0 THEN v / max(v) OVER (PARTITION BY k, charge, isotope) ELSE 0 END AS unit FROM un),
me AS (SELECT k, x, round(median(unit), 12) AS y FROM nm GROUP BY k, x),{range_sql("p", "me", 4)},
ins AS (SELECT nm.k, charge * 10 + isotope AS ion, nm.x, nm.v, nm.v AS q, me.y, capped, r.a, r.z FROM nm JOIN me ON me.k = nm.k AND me.x = nm.x JOIN pr r ON r.k = nm.k WHERE nm.x BETWEEN r.a AND r.z),{area_sql("ins", "ar")}
SELECT ar.k AS user_id, CAST(ar.ion // 10 AS INTEGER) AS charge, CAST(ar.ion % 10 AS INTEGER) AS isotope, round(correlation, 6) AS correlation, correlation > 0.9 AS quantitative, round(area, 4) AS area, round(background, 4) AS background, capped, CAST(a AS DOUBLE) AS start, CAST(z AS DOUBLE) AS stop
FROM ar JOIN (SELECT DISTINCT k, capped, a, z FROM ins) USING (k)
""")
def precursor_areas(spark, d):
    """Users as candidates, halves of the month as charges, event types as isotopes."""
    x = trace_table(spark, d)
    kinds = sorted(r[0] for r in x.select("ion").distinct().collect())  # a handful of types
    isotope = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("ion")).cast("int") - 1
    x = x.select("user_id", (2 + F.floor(F.col("at") / 15)).cast("int").alias("charge"), isotope.alias("isotope"), (F.col("at") % 15).cast("double").alias("x"), "v")
    expected = x.select("user_id", "isotope").distinct().withColumn("share", 1 / (1 + F.col("isotope") * (F.col("user_id") % 3 + 1) / 4))
    r = quant.integrate_precursors(x, expected, ["user_id"], "charge", "isotope", "x", "v", 4.0)
    return r.select("user_id", "charge", "isotope", F.round("correlation", 6).alias("correlation"), "quantitative", F.round("area", 4).alias("area"), F.round("background", 4).alias("background"), "capped", "start", "stop")


@query(f"""
WITH live AS (SELECT user_id AS k, event_type AS ion FROM events GROUP BY ALL HAVING sum(value) > 0),
{REFINED.replace("tr AS (SELECT", "tr AS (SELECT * FROM (SELECT", 1).replace("LEFT JOIN sv USING (user_id, ion, x))", "LEFT JOIN sv USING (user_id, ion, x)) JOIN live USING (k, ion))", 1)},
md AS (SELECT DISTINCT k, x, y, a, z, CAST(k % 30 AS DOUBLE) AS c FROM gn),
pc AS (SELECT user_id AS k, CAST(ts AS DATE) - DATE '2024-01-01' AS x, count(*) AS p FROM events GROUP BY ALL),
sh AS (SELECT md.*, CASE WHEN x BETWEEN a AND z THEN coalesce(p, 0) ELSE 0 END AS p, greatest(8 / 6, (z - a) / 4) AS dev FROM md LEFT JOIN pc USING (k, x)),
bl AS (SELECT *, CASE WHEN abs(x - c) <= 2 * dev THEN cos(abs(x - c) * pi() / (4 * dev)) ELSE 0 END AS g FROM sh),
co AS (SELECT k, any_value(a) AS a, any_value(z) AS z, sum(y) FILTER (x BETWEEN a AND z) > 0 AS live, sum(p) > 0 AS parent,
  CASE WHEN var_pop(g) > 1e-12 * avg(g * g) AND var_pop(y) > 1e-12 * avg(y * y) THEN least(1, corr(g, y)) ELSE 0 END AS cg, CASE WHEN var_pop(p) > 1e-12 * avg(p * p) AND var_pop(y) > 1e-12 * avg(y * y) THEN least(1, corr(p, y)) ELSE 0 END AS cp FROM bl GROUP BY k),
ng AS (SELECT k, count(*) FILTER (correlation >= 0.75) AS good, count(*) FILTER (correlation >= 0.9) AS great FROM ar GROUP BY k)
SELECT k AS user_id, CAST(good AS INTEGER) AS n_good, CAST(live AND great > 0 AS INTEGER) AS is_integrated_signal, CAST(live AND parent AS INTEGER) AS is_integrated_precursor,
  round(CASE WHEN live THEN cg ELSE 0 END, 6) AS correlation_to_gaussian, round(CASE WHEN live THEN cp ELSE 0 END, 6) AS correlation_to_precursor, CAST(a AS DOUBLE) AS start, CAST(z AS DOUBLE) AS stop FROM co JOIN ng USING (k)
""")
def shape_features(spark, d):
    """Users as candidates, their events a day as the precursor, their ranges not bound to a scan beyond the bell's centre."""
    days = t(spark, d, "events").groupBy("user_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("at")).agg(F.count(F.lit(1)).alias("p"))
    x = trace_table(spark, d).join(days, ["user_id", "at"], "left").withColumns({"p": F.coalesce("p", F.lit(0)), "c": (F.col("user_id") % 30).cast("double")})
    out = quant.shape_features(x, ["user_id"], "ion", "at", "v", "p", "c", 8.0, hold=False)
    return out.select("user_id", "n_good", "is_integrated_signal", "is_integrated_precursor", F.round("correlation_to_gaussian", 6).alias("correlation_to_gaussian"), F.round("correlation_to_precursor", 6).alias("correlation_to_precursor"), "start", "stop")


@query()
def feature_search(spark, d):
    """Users as candidates (of pairs, odd ones decoys), event types as ions, days as scans, events a day as the precursor."""
    e = t(spark, d, "events").withColumn("at", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long"))
    days = e.groupBy("user_id", "at").agg(F.count(F.lit(1)).cast("double").alias("precursor"), F.sum("value").alias("tic"))
    x = trace_table(spark, d).join(days.hint("merge"), ["user_id", "at"], "left")
    x = x.select(F.col("user_id").alias("candidate"), F.floor(F.col("user_id") / 2).alias("group"), (F.col("user_id") % 2 == 1).alias("decoy"), F.col("at").alias("scan"), "at", (F.col("at") * 1.0).cast("double").alias("rt"), "ion", F.substring("ion", 1, 1).alias("ion_type"), F.length("ion").alias("ion_index"), (F.length("ion") * 1.0).cast("double").alias("predicted"), F.sqrt("v").alias("intensity"), (F.col("v") % 7 - 3).alias("delta"), F.coalesce("tic", F.lit(0.0)).alias("tic"), F.coalesce("precursor", F.lit(0.0)).alias("precursor"))
    peaks = e.groupBy(F.col("user_id").alias("candidate"), F.col("at").alias("scan")).agg(F.array_sort(F.collect_list(F.struct((F.col("event_id") % 997 + 100.0).alias("mz"), F.col("value").alias("intensity")))).alias("peaks"))
    library = e.groupBy(F.col("event_type").alias("type")).agg(F.array_sort(F.collect_set((F.col("event_id") % 97 * 10 + 100.0))).alias("mz"))  # a hundred masses a type
    one = peaks.withColumn("type", F.element_at(F.array(F.lit("click"), F.lit("error"), F.lit("view")), (F.col("candidate") % 3 + 1).cast("int"))).join(library, "type", "left")
    scans = features.xcorr_pair(one.withColumns({"ions": F.coalesce("mz", F.array().cast("array<double>")), "library": F.transform(F.coalesce("mz", F.array().cast("array<double>")), lambda m: F.struct(m.alias("mz"), (m % 13).alias("intensity")))}))
    scans = scans.select("candidate", "scan", "xcorr_lib", "xcorr_model", (F.size("peaks") / (F.size("peaks") + 1.0)).alias("isotope_dot"), (F.size("peaks") * 1.0).alias("parent_delta"))
    out = tracescore.feature_search(x, scans, 4, 8.0)
    return out.select("candidate", "group", "decoy", "scan", "rank", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in tracescore.FEATURES])


RIDGE = """
p AS (SELECT event_type AS k, CAST(epoch_us(ts) AS DOUBLE) / 3.6e9 AS x, value AS y FROM events),
r AS (SELECT k, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p GROUP BY k),
c AS (SELECT k, CAST(floor((x - x0) / (x1 - x0) * 59 + 0.5) AS INTEGER) AS i, CAST(floor((y - y0) / (y1 - y0) * 39 + 0.5) AS INTEGER) AS j, count(*) AS c FROM p JOIN r USING (k) GROUP BY ALL),
s AS (SELECT k, least(60 / 40, sum(c) ** (-1 / 6) * sqrt(greatest((sum(c * i * i) - sum(c * i) * sum(c * i) / sum(c)) / sum(c), 0)) / (2 * sqrt(2 * ln(2)))) AS di, least(40 / 40, sum(c) ** (-1 / 6) * sqrt(greatest((sum(c * j * j) - sum(c * j) * sum(c * j) / sum(c)) / sum(c), 0)) / (2 * sqrt(2 * ln(2)))) AS dj FROM c GROUP BY k),
o AS (SELECT range AS o FROM range(-3, 4)),
h AS (SELECT k, i + o AS i, j, sum(c * CASE WHEN di > 0 THEN sqrt(greatest(cos(abs(o) * pi() / (4 * di)), 0) * pi() / (8 * di)) ELSE 1 END) AS w FROM c JOIN s USING (k), o WHERE abs(o) <= floor(2 * di + 0.5) AND (abs(o) <= 2 * di) AND i + o BETWEEN 0 AND 59 GROUP BY ALL),
v AS (SELECT k, i, j + o AS j, round(sum(w * CASE WHEN dj > 0 THEN sqrt(greatest(cos(abs(o) * pi() / (4 * dj)), 0) * pi() / (8 * dj)) ELSE 1 END), 9) AS w FROM h JOIN s USING (k), o WHERE abs(o) <= floor(2 * dj + 0.5) AND abs(o) <= 2 * dj AND j + o BETWEEN 0 AND 39 GROUP BY ALL)"""


@query(f"""
WITH RECURSIVE {RIDGE},
t AS (SELECT k, i, j FROM v QUALIFY row_number() OVER (PARTITION BY k ORDER BY w DESC, i, j) = 1),
q AS (
  SELECT k, d, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j FROM t, (VALUES (1), (-1)) s(d)
  UNION ALL
  SELECT k, d, i, CASE WHEN e >= greatest(n, s) OR n = s THEN jj WHEN n > s THEN jj + 1 ELSE jj - 1 END FROM (
    SELECT q.k, q.d, q.i + q.d AS i, least(greatest(q.j, 1), 38) AS jj, coalesce(a.w, 0) AS e, coalesce(b.w, 0) AS n, coalesce(z.w, 0) AS s
    FROM q LEFT JOIN v a ON a.k = q.k AND a.i = q.i + q.d AND a.j = least(greatest(q.j, 1), 38) LEFT JOIN v b ON b.k = q.k AND b.i = q.i + q.d AND b.j = least(greatest(q.j, 1), 38) + 1 LEFT JOIN v z ON z.k = q.k AND z.i = q.i + q.d AND z.j = least(greatest(q.j, 1), 38) - 1
    WHERE q.i + q.d BETWEEN 0 AND 59)
)
SELECT DISTINCT k AS event_type, CAST(i AS INTEGER) AS i, round(x0 + i * (x1 - x0) / 59, 4) AS x, round(y0 + j * (y1 - y0) / 39, 6) AS y FROM q JOIN r USING (k)
""")
def mass_error_ridge(spark, d):
    """Event types as runs, hours as times, values as errors."""
    e = t(spark, d, "events").select("event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).alias("x"), "value")
    return alignment.ridge(e, ["event_type"], "x", "value", 60, 40).select("event_type", "i", F.round("x", 4).alias("x"), F.round("y", 6).alias("y"))


@query(f"""
WITH {RIDGE}
SELECT k AS event_type, i, CAST(j AS INTEGER) AS j, round(w, 6) AS weight FROM v WHERE w > 0
""")
def rectangle_density(spark, d):
    e = t(spark, d, "events").select("event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).alias("x"), "value")
    grid, _ = alignment.rectangle_density(e, ["event_type"], "x", "value", 60, 40)
    return grid.where("weight > 0").select("event_type", "i", "j", F.round("weight", 6).alias("weight"))


@query()
def corrected_errors(spark, d):
    """Event types as runs: errors less their ridge."""
    e = t(spark, d, "events").select("event_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).alias("x"), "value")
    return alignment.corrected_errors(e, ["event_type"], "x", "value", "event_id", 300, 100)


@query()
def apex_times(spark, d):
    """Users' values a day: the spline's apex of each user's peak."""
    e = t(spark, d, "events").groupBy("user_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("double").alias("x")).agg(F.sum("value").alias("y"))
    return quant.apex_times(e, ["user_id"], "x", "y", 8.0).select("user_id", *[F.round(c, 6).alias(c) for c in ("apex", "height", "start", "stop")])


@query("""
WITH x AS (SELECT l_orderkey AS k, p_retailprice AS mz, l_quantity AS lib, CASE WHEN l_discount > 0.03 THEN l_extendedprice ELSE 0 END AS y, o_totalprice AS mag, l_linenumber + 4 AS len, p_size % 3 AS w FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
b AS (SELECT p_size % 3 AS w, p_retailprice AS m, sum(1.0 / (p_size + 10)) AS f FROM part WHERE p_partkey % 4 = 0 GROUP BY ALL),
c AS (SELECT x.w, x.mz, least(1, sum(f)) AS chance FROM (SELECT DISTINCT w, mz FROM x) x JOIN b ON b.w = x.w AND abs(b.m - x.mz) <= greatest(b.m, x.mz) * 100e-6 GROUP BY ALL),
r AS (SELECT x.*, CASE WHEN y > 0 THEN lib * y END AS p, coalesce(sum(CASE WHEN y > 0 THEN lib * y END) OVER (PARTITION BY k), 0) AS raw, chance FROM x LEFT JOIN c ON c.w = x.w AND c.mz = x.mz)
SELECT k AS l_orderkey, round(max(raw), 2) AS raw, round(max(raw) / max(mag), 4) AS similarity, round(coalesce(sum(p * mz) / sum(mz) FILTER (y > 0), 0), 2) AS weighted, count(*) FILTER (p > raw / (len + 1)) AS n_above, count(*) FILTER (y > 0) AS n_matched,
  round(coalesce(sum(chance), 0), 6) AS expected, round(count(*) FILTER (y > 0) - coalesce(sum(chance), 0), 6) AS excess FROM r GROUP BY k
""")
def chance_scores(spark, d):
    """Orders as candidates, their parts' prices as masses, the sizes of parts as windows."""
    x = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    x = x.select("l_orderkey", F.col("p_retailprice").alias("mz"), F.col("l_quantity").alias("library"), F.when(F.col("l_discount") > 0.03, F.col("l_extendedprice")).otherwise(F.lit(0.0)).alias("intensity"), F.col("o_totalprice").alias("magnitude"), (F.col("l_linenumber") + 4).alias("length"), (F.col("p_size") % 3).alias("window"))
    b = t(spark, d, "part").where("p_partkey % 4 = 0").groupBy((F.col("p_size") % 3).alias("window"), F.col("p_retailprice").alias("mass")).agg(F.sum(1.0 / (F.col("p_size") + 10)).alias("frequency"))
    out = variants.chance_scores(x, ["l_orderkey"], b, 100.0)
    return out.select("l_orderkey", F.round("raw", 2).alias("raw"), F.round("similarity", 4).alias("similarity"), F.round("weighted", 2).alias("weighted"), "n_above", "n_matched", F.round("expected", 6).alias("expected"), F.round("excess", 6).alias("excess"))


@query("""
WITH s AS (SELECT p_partkey, regexp_replace(upper(p_name), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS s FROM part),
c AS (SELECT 'TCAG'[i + 1] || 'TCAG'[j + 1] || 'TCAG'[k + 1] AS codon, 'FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG'[16 * i + 4 * j + k + 1] AS a FROM range(4) x(i), range(4) y(j), range(4) z(k)),
n AS (SELECT DISTINCT x.a AS was, y.a AS becomes FROM c x JOIN c y ON CAST(x.codon[1] <> y.codon[1] AS INTEGER) + CAST(x.codon[2] <> y.codon[2] AS INTEGER) + CAST(x.codon[3] <> y.codon[3] AS INTEGER) = 1 WHERE x.a <> y.a AND x.a <> '*' AND y.a <> '*'),
p AS (SELECT p_partkey, s, unnest(range(1, length(s) + 1)) AS position FROM s)
SELECT p_partkey, CAST(position AS INTEGER) AS position, was, becomes, substr(s, 1, position - 1) || becomes || substr(s, position + 1) AS variant FROM p JOIN n ON n.was = substr(s, position, 1)
""")
def single_variants(spark, d):
    """Part names as sequences: all that one changed base can make of them."""
    x = t(spark, d, "part").select("p_partkey", F.regexp_replace(F.upper("p_name"), "[^ACDEFGHIKLMNPQRSTVWY]", "").alias("s"))
    return variants.single_variants(x, "s").select("p_partkey", "position", "was", "becomes", "variant")


@query()
def checked_decoys(spark, d):
    """Part names as sequences, against all of them."""
    x = t(spark, d, "part").select("p_partkey", F.regexp_replace(F.upper("p_name"), "[^ACDEFGHIKLMNPQRSTVWY]", "").alias("s")).where("length(s) > 0")
    return variants.checked_decoys(x, "s", x.select("s"), tries=10, most_shared=0.4)


@query(f"""
WITH {TRACES},
q AS (SELECT k // 10 AS site, k, ion, x AS tm, v, round(100 + length(ion) * 37 + k % 10 * ascii(ion) / 10.0, 3) AS mz FROM tr),
pr AS (SELECT site, k, tm, sum(sqrt(v)) AS p FROM q GROUP BY ALL),
ga AS (SELECT *, (p + exp(-0.72) * (coalesce(lag(p) OVER w, 0) + coalesce(lead(p) OVER w, 0)) + exp(-2.88) * (coalesce(lag(p, 2) OVER w, 0) + coalesce(lead(p, 2) OVER w, 0)))
  / (1 + exp(-0.72) * (CAST(lag(p) OVER w IS NOT NULL AS INTEGER) + CAST(lead(p) OVER w IS NOT NULL AS INTEGER)) + exp(-2.88) * (CAST(lag(p, 2) OVER w IS NOT NULL AS INTEGER) + CAST(lead(p, 2) OVER w IS NOT NULL AS INTEGER))) AS a
  FROM pr WINDOW w AS (PARTITION BY k ORDER BY tm)),
st AS (SELECT k, tm AS start FROM pr QUALIFY row_number() OVER (PARTITION BY k ORDER BY p DESC, tm) = 1),
io AS (SELECT DISTINCT site, k, mz FROM q),
te AS (SELECT * FROM io x WHERE NOT EXISTS (SELECT 1 FROM io y WHERE y.site = x.site AND y.k <> x.k AND abs(y.mz - x.mz) <= greatest(x.mz, y.mz) * 1e-5)),
pk AS (SELECT DISTINCT site, tm, mz FROM q WHERE v > 60),
lo AS (SELECT k, tm, count(*) * -log10(0.05) AS l, count(*) AS n FROM (SELECT DISTINCT te.k, te.mz, pk.tm FROM te JOIN pk ON pk.site = te.site AND abs(pk.mz - te.mz) <= greatest(pk.mz, te.mz) * 1e-5) GROUP BY ALL),
be AS (SELECT ga.site, ga.k, ga.tm, ga.p, coalesce(l, 0) AS l, coalesce(n, 0) AS n FROM ga JOIN st USING (k) LEFT JOIN lo ON lo.k = ga.k AND lo.tm = ga.tm WHERE abs(ga.tm - start) < 6
  QUALIFY row_number() OVER (PARTITION BY ga.k ORDER BY round(coalesce(l, 0), 9) DESC, round(a, 9) DESC, ga.tm) = 1),
fl AS (SELECT *, round(l, 9) >= 3 AND n >= 3 AS localized FROM be)
SELECT site, k AS user_id, tm AS "at", CAST(tm AS DOUBLE) AS rt, round(p, 6) AS primary, round(l, 6) AS localization, n AS n_ions, localized,
  CASE WHEN bool_or(localized) OVER (PARTITION BY site) THEN localized ELSE row_number() OVER (PARTITION BY site ORDER BY p DESC, k) = 1 END AS reported FROM fl
""")
def allele_competition(spark, d):
    """Users as alleles of ten a site, days as scans, event types' values as masses."""
    x = trace_table(spark, d).withColumns({"site": F.floor(F.col("user_id") / 10), "mz": F.round(100 + F.length("ion") * 37 + F.col("user_id") % 10 * F.ascii("ion") / 10.0, 3)})
    primary = x.groupBy("site", "user_id", "at").agg(F.sum(F.sqrt("v")).alias("primary")).withColumn("rt", F.col("at") * 1.0)
    ions = x.select("site", "user_id", "mz", F.lit(0.05).alias("frequency")).distinct()
    peaks = x.where("v > 60").select("site", "at", "mz").distinct()
    out = variants.allele_competition(primary, ions, peaks, ["site"], "user_id", 6.0, 5, 10.0, 3.0, 3)
    return out.withColumns({c: F.round(c, 6) for c in ("rt", "primary", "localization")})


def line_times(spark, d):
    """Line numbers as runs, parts as sequences, at times that run with the part's key."""
    return t(spark, d, "lineitem").select(F.concat(F.lit("r"), F.col("l_linenumber").cast("string")).alias("run"), F.col("l_partkey").cast("string").alias("modseq"), (F.col("l_partkey") / 50 * (1 + F.col("l_linenumber") / 40) + F.col("l_linenumber") + F.col("l_quantity") / 100).alias("rt"))


@query("""
WITH p AS (SELECT DISTINCT 'r' || l_linenumber AS run, l_partkey FROM lineitem)
SELECT x.run AS a, y.run AS b, count(*) AS n FROM p x JOIN p y ON x.l_partkey = y.l_partkey AND x.run < y.run GROUP BY ALL
""")
def shared_counts(spark, d):
    return transfer.shared_counts(line_times(spark, d))


@query()
def tree_alignment(spark, d):
    return transfer.tree_alignment(line_times(spark, d)).select("run", "modseq", F.round("rt", 6).alias("rt"), F.round("aligned", 6).alias("aligned"), "root")


@query()
def all_peak_locations(spark, d):
    return transfer.all_peak_locations(line_times(spark, d)).select("run", "modseq", F.round("rt", 6).alias("rt"), "observed")


@query()
def empirical_alignment(spark, d):
    """Lines 1 and 2 to 7 of a part as pairs of runs."""
    x = line_times(spark, d).groupBy("run", "modseq").agg(F.min("rt").alias("rt"))
    pairs = x.where("run <> 'r1'").join(x.where("run = 'r1'").select("modseq", F.col("rt").alias("seed")), "modseq")
    return alignment.empirical_alignment(pairs, ["run"], "seed", "rt", "modseq").select("run", "modseq", *[F.round(c, 6).alias(c) for c in ("warped", "delta", "probability")])


@query()
def source_times(spark, d):
    """Years of orders as sources of one library a clerk's last digit, customers as spectra."""
    o = t(spark, d, "orders").select((F.col("o_orderkey") % 10).alias("library"), F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("source"), (F.col("o_custkey") / 10 + F.year("o_orderdate") % 100 + F.col("o_totalprice") / 1e6).alias("rt"), (F.col("o_orderkey") % 2).alias("best"))
    return transfer.source_times(o, ["library"]).select("library", "id", F.round("rt", 6).alias("rt"))


@query()
def transferred_peaks(spark, d):
    """Users as sequences: the first half of the month as the reference, the second as a run."""
    x = t(spark, d, "events").groupBy("user_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("double").alias("rt")).agg(F.sum("value").alias("intensity"))
    x = x.withColumnRenamed("user_id", "modseq")
    bounds = transfer.reference_shapes(x.where("rt < 15"), 6.0)
    pairs = x.where("rt < 15").select(F.lit("second").alias("run"), F.col("rt").alias("reference_rt"), (F.col("rt") + 15).alias("rt")).distinct()
    out = transfer.transferred_peaks(bounds, pairs, x.where("rt >= 15").withColumn("run", F.lit("second")), 6.0)
    return out.select("run", "modseq", "transferred", *[F.round(c, 6).alias(c) for c in ("start", "stop", "correlation", "area", "background", "net")])


@query()
def merged_spectra(spark, d):
    """Orders' lines as spectra of a part each, prices as masses."""
    x = t(spark, d, "lineitem").select("l_suppkey", "l_orderkey", (F.col("l_orderkey") % 100).cast("double").alias("rt"), F.col("l_extendedprice").alias("mz"), F.col("l_quantity").alias("y"))
    out = merging.merged_spectra(x, ["l_suppkey"], "l_orderkey", "rt", "mz", "y", 2000.0, 50, 500.0)
    return out.select("l_suppkey", *[F.round(c, 6).alias(c) for c in ("mz", "intensity", "rt")], "n_spectra")


@query()
def combined_peaks(spark, d):
    """Events of a user as peaks, values as masses."""
    x = t(spark, d, "events").select("user_id", (F.col("value") + 100).alias("mz"), (F.col("event_id") % 97 + 1.0).alias("y"))
    return merging.combined_peaks(x, ["user_id"], "mz", "y", 5000.0).select("user_id", F.round("mz", 6).alias("mz"), F.round("y", 6).alias("y"))
