"""Quantification from traces: peak ranges, refinement of transitions, integration of precursors over charges and isotopes.

Traces are tables with a row for each member (a transition, or an isotope of a charge) and x of a candidate; where a member
lacks an x of its candidate it counts as 0 there.  Spark deals out the rows by the candidate's key, once, and sorts them; a
candidate is one small matrix, of which an Arrow batch holds many.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakfold.operators.kernels import per_group

#: The share of the apex below which a peak ends, the share of the expected width (or the multiple of the
#: median step) that a peak may go uphill, correlations of good and of weak transitions.
FLOOR, UPHILL, STEPS = 0.01, 0.2, 2.1
QUANTITATIVE, WEAK = 0.9, 0.5
#: Isotopes expected to have more than this share of the largest decide how much signal is theirs.
DECIDING = 0.5
#: The quadratic smoothing filter of nine points.
SMOOTH = np.array([-21, 14, 39, 54, 59, 54, 39, 14, -21]) / 231
#: Variances of less than this share of the mean square are rounding.
FLAT = 1e-12


def _edge(x: np.ndarray, y: np.ndarray, apex: int, step: int, limit: float) -> int:
    """Where the peak ends on one side."""
    low = apex
    for i in range(apex + step, len(y) if step > 0 else -1, step):
        if y[i] < y[low]:
            low = i
        elif abs(x[i] - x[low]) > limit and 2 * y[low] < y[apex]:
            return low
        if y[i] < FLOOR * y[apex]:
            return min(max(i + step, 0), len(y) - 1)
    return low


def _grown(y: np.ndarray, a: int, z: int, least: int) -> tuple[int, int]:
    """The range widened to `least` points by the higher neighbour; of equal ones by the side that didn't grow last."""
    right_last = True
    while z - a + 1 < min(least, len(y)):
        left, right = (y[a - 1] if a else -1.0), (y[z + 1] if z + 1 < len(y) else -1.0)
        go_left = left > right or (left == right and right_last)
        if go_left:
            a, right_last = a - 1, False
        else:
            z, right_last = z + 1, right_last or left == right
    return a, z


def peak_range(x: np.ndarray, y: np.ndarray, width: float, least: int = 3, near: float | None = None) -> tuple[int, int, int]:
    """(first, last, apex) of the peak of a trace.

    From the apex (the first of the greatest y; the middle of the trace if that is one of them) each side is walked outwards.
    It ends one point after y falls below a hundredth of the apex, or at the lowest point so far once the walk is further than
    a fifth of `width` (2.1 median steps at least) beyond it and it is below half of the apex; else at its lowest point.
    A range that doesn't hold the x `near` is taken again around the first point at or after that.
    """
    limit = max(UPHILL * width, STEPS * float(np.median(np.diff(x))) if len(x) > 1 else 0.0)
    middle = (len(y) - 1) // 2
    apex = middle if y[middle] == y.max() else int(y.argmax())
    a, z = _grown(y, _edge(x, y, apex, -1, limit), _edge(x, y, apex, 1, limit), least)
    if near is not None and not np.isnan(near) and not x[a] <= near <= x[z]:
        apex = min(int(np.searchsorted(x, near)), len(x) - 1)
        a, z = _grown(y, _edge(x, y, apex, -1, limit), _edge(x, y, apex, 1, limit), least)
    return a, z, apex


def shares(m: np.ndarray, a: int, z: int) -> np.ndarray:
    """Rows over their sums from a to z; 0 where that is 0."""
    total = m[:, a : z + 1].sum(1, keepdims=True)
    return np.divide(m, total, out=np.zeros_like(m), where=total != 0)


def median_of(m: np.ndarray) -> np.ndarray:
    """Of the columns, to twelve digits, so that no tie hangs on the order of additions."""
    return np.round(np.median(m, axis=0), 12)


def local_median(x: np.ndarray, m: np.ndarray, width: float, least: int, near: float | None) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(rows normalised within the peak, their median, first and last of the peak of that): the peak is looked for in the median
    of rows normalised as wholes, and again in that of rows normalised within it."""
    a, z, _ = peak_range(x, median_of(shares(m, 0, len(x) - 1)), width, least, near)
    n = shares(m, a, z)
    median = median_of(n)
    a, z, _ = peak_range(x, median, width, least)
    return n, median, a, z


def correlations(m: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each row with y; 0 without variance, at most 1."""
    u, v = m - m.mean(1, keepdims=True), y - y.mean()
    uu, vv = (u * u).sum(1), float(v @ v)
    live = (uu > FLAT * (m * m).sum(1)) & (vv > FLAT * float(y @ y))
    return np.minimum(1.0, np.divide(u @ v, np.sqrt(uu * vv), out=np.zeros(len(m)), where=live))


def areas(x: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(area by trapezoids, what of it is under the lower end, following dips) of each row."""
    under = np.minimum(m, np.minimum(m[:, :1], m[:, -1:]))
    step = np.diff(x)
    return ((m[:, 1:] + m[:, :-1]) * step).sum(1) / 2, ((under[:, 1:] + under[:, :-1]) * step).sum(1) / 2


def smoothed(m: np.ndarray) -> np.ndarray:
    """Rows smoothed over nine points, 0 beyond their ends and not below 0; shorter rows stay."""
    if m.shape[1] < len(SMOOTH):
        return m
    return np.maximum(0.0, np.stack([np.convolve(r, SMOOTH, "same") for r in m]))


def _matrix(member: np.ndarray, x: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(members, x, matrix) of a candidate's rows; of rows that repeat a place the last counts."""
    names, row = np.unique(member, return_inverse=True)
    xs, column = np.unique(x.astype(float), return_inverse=True)
    m = np.zeros((len(names), len(xs)))
    m[row, column] = np.nan_to_num(v.astype(float))
    return names, xs, m


def _agreement(x: np.ndarray, m: np.ndarray, width: float, near: float | None, most: int = 5, fewest: int = 3, least: int = 3, weak: float = WEAK) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    """(correlation of each row with the local median, whether it is among the selected, first and last of the peak)."""
    n, median, a, z = local_median(x, m, width, least, near)
    r = np.round(correlations(n[:, a : z + 1], median[a : z + 1]), 9)
    place = np.empty(len(r), np.int64)
    place[np.argsort(-r, kind="stable")] = np.arange(len(r))
    return r, r >= r[(place < most) & ((r >= weak) | (place < fewest))].min(), (a, z)


def peak_ranges(df: DataFrame, key: list[str], x: str, y: str, width: float, least: int = 3, near: str | None = None) -> DataFrame:
    """The peak of every trace (see `peak_range`): key, start, stop, apex as x, points.  `near`: a column of one value a trace."""

    def kernel(xs, ys, *hint):
        xs, ys = xs.astype(float), ys.astype(float)
        a, z, apex = peak_range(xs, ys, width, least, float(hint[0][0]) if hint and hint[0][0] is not None else None)
        return {"start": [xs[a]], "stop": [xs[z]], "apex": [xs[apex]], "points": [z - a + 1]}

    return per_group(df, key, [x], [x, y, *([near] if near else [])], "start double, stop double, apex double, points long", kernel)


def refine_transitions(traces: DataFrame, key: list[str], ion: str, x: str, value: str, width: float = 25.0, most: int = 5, fewest: int = 3, near: str | None = None, least: int = 3, weak: float = WEAK, quantitative: float = QUANTITATIVE) -> DataFrame:
    """Which transitions of a candidate agree, and the peak they agree on.

    The range comes from the median of all normalised transitions.  Within it each is correlated with the median and
    integrated (trapezoids less the background under the lower end).  The `most` best are selected, fewer if they
    correlate by less than `weak`, but `fewest` at least and all that tie with the last; their median gives the final range.
    `near`: a column with an x that the first ranges must hold (null: wherever the apex is).

    Returns key, ion, correlation, quantitative, area, background, net, selected, start and stop (x of the final range).
    """
    kind = dict(traces.dtypes)[ion]

    def kernel(member, xs, v, *hint):
        names, xs, m = _matrix(member, xs, v)
        at = float(hint[0][0]) if hint and hint[0][0] is not None else None
        r, selected, (a, z) = _agreement(xs, m, width, at, most, fewest, least, weak)
        area, under = areas(xs[a : z + 1], m[:, a : z + 1])
        _, _, a, z = local_median(xs, m[selected], width, least, at)
        many = len(names)
        return {ion: names, "correlation": r, "quantitative": r >= quantitative, "area": area, "background": under, "net": area - under, "selected": selected, "start": np.full(many, xs[a]), "stop": np.full(many, xs[z])}

    return per_group(traces.where(F.col(x).isNotNull()), key, [ion, x], [ion, x, value, *([near] if near else [])], f"`{ion}` {kind}, correlation double, quantitative boolean, area double, background double, net double, selected boolean, start double, stop double", kernel)


def integrate_precursors(traces: DataFrame, expected: DataFrame, key: list[str], charge: str, isotope: str, x: str, value: str, width: float = 25.0, low: str | None = None, high: str | None = None, least: int = 3, quantitative: float = QUANTITATIVE) -> DataFrame:
    """Areas of a candidate's isotopes at each charge, of the signal that its isotope distribution accounts for.

    traces: key, charge, isotope (those below 0 are left out), x, value; expected: key, isotope, share (of the largest).  At
    each point the isotopes expected at more than half of the largest say how much signal is the candidate's: no isotope
    counts for more than its share of the least of that.  Capped traces are smoothed and divided by their apex; the median over
    all charges and isotopes gives the range, which is widened to hold x from `low` to `high` (columns, null: not).  If nothing
    is left anywhere, the two first isotopes are taken as they are.

    Returns key, charge, isotope, correlation (with the median, in the range), quantitative, area, background, net, capped
    (whether the distribution was used), start, stop.
    """
    table = expected.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct(F.col(isotope).cast("int"), F.col("share").cast("double")))).alias("__shares"))  # a handful of isotopes
    named = F.struct(F.col(charge).cast("int").alias("charge"), F.col(isotope).cast("int").alias("isotope"))
    t = traces.where((F.col(isotope) >= 0) & F.col(x).isNotNull()).join(table, key, "left")
    t = t.select(*key, F.col(x).cast("double").alias("__x"), F.col(value).cast("double").alias("__v"), (named["charge"].cast("long") * 4096 + named["isotope"]).alias("__member"), F.coalesce(F.try_element_at("__shares", named["isotope"]), F.lit(0.0)).alias("__share"), *[F.col(c).cast("double").alias(n) for c, n in ((low, "__low"), (high, "__high")) if c])

    def kernel(member, xs, v, share, *bounds):
        part = dict(zip(member.tolist(), share.tolist()))
        names, xs, m = _matrix(member, xs, v)
        s = np.array([part[k] for k in names.tolist()])
        pure = m.copy()
        for c in np.unique(names >> 12):
            own = np.flatnonzero(names >> 12 == c)
            lead = own[s[own] > DECIDING]
            if len(lead):
                pure[own] = np.minimum(m[own], (m[lead] / s[lead][:, None]).min(0)[None, :] * s[own][:, None])
        pure = smoothed(pure)
        some = bool((pure > 0).any())
        if not some:
            first = names & 4095 <= 1
            names, pure = names[first], m[first]
        if not len(names):
            return {c: np.zeros(0) for c in ("charge", "isotope", "correlation", "quantitative", "area", "background", "net", "capped", "start", "stop")}
        top = pure.max(1, keepdims=True)
        median = median_of(np.divide(pure, top, out=np.zeros_like(pure), where=top > 0))
        a, z, _ = peak_range(xs, median, width, least)
        start, stop = xs[a], xs[z]
        if bounds:
            start, stop = np.fmin(start, bounds[0][0]), np.fmax(stop, bounds[1][0])
        inside = (xs >= start) & (xs <= stop)
        r = np.round(correlations(pure[:, inside], median[inside]), 9)
        area, under = areas(xs[inside], pure[:, inside])
        many = len(names)
        return {"charge": names >> 12, "isotope": names & 4095, "correlation": r, "quantitative": r > quantitative, "area": area, "background": under, "net": area - under, "capped": np.full(many, some), "start": np.full(many, start), "stop": np.full(many, stop)}

    out = per_group(t, key, ["__member", "__x"], ["__member", "__x", "__v", "__share", *[n for c, n in ((low, "__low"), (high, "__high")) if c]], "charge int, isotope int, correlation double, quantitative boolean, area double, background double, net double, capped boolean, start double, stop double", kernel)
    return out.withColumnsRenamed({"charge": charge, "isotope": isotope})


def quantified(refined: DataFrame, key: list[str], ion: str, most: int = 5) -> DataFrame:
    """A candidate's quantity: key, intensity (net areas of its best quantitative transitions, of the selected ones if none is
    quantitative), n_ions, ions (names, best first), correlation (of the used ones on average), start, stop."""
    used = refined.withColumn("__any", F.max("quantitative").over(Window.partitionBy(*key))).where(F.when(F.col("__any"), F.col("quantitative")).otherwise(F.col("selected")))
    used = used.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("correlation"), F.col(ion)))).where(F.col("__r") <= most)
    names = F.transform(F.array_sort(F.collect_list(F.struct(F.col("__r"), F.col(ion).cast("string").alias("name")))), lambda p: p["name"])
    return used.groupBy(*key).agg(F.sum(F.greatest("net", F.lit(0.0))).alias("intensity"), F.count(F.lit(1)).alias("n_ions"), F.array_join(names, ",").alias("ions"), F.avg("correlation").alias("correlation"), F.max("start").alias("start"), F.max("stop").alias("stop"))


# -- features of a peak in the traces ------------------------------------------------------------------------------------


def cosine_bell(x: np.ndarray, centre: float, deviation: float) -> np.ndarray:
    """The cosine that stands in for a Gaussian: 0 from two deviations on."""
    away = np.abs(x - centre)
    return np.where(away <= 2 * deviation, np.cos(away * np.pi / (4 * deviation)), 0.0) if deviation > 0 else np.zeros(len(x))


def shape_features(traces: DataFrame, key: list[str], ion: str, x: str, value: str, precursor: str, centre: str, width: float = 25.0, identifying: float = 0.75, hold: bool = True, **how) -> DataFrame:
    """How much a candidate's traces around a scan look like one peak.

    traces: key, ion, x, value, precursor (its signal at that x, on every ion's row), centre (x of the scan, one a key).
    Ions without signal are left out.  Transitions are refined as by `refine_transitions`, with `centre` to be held (unless `hold` is off); then the
    median of the selected ones is correlated with a bell around the centre (as wide as the range, two thirds of the expected
    width at least) and with the precursor within the range.

    Returns key, n_good (transitions correlating by 0.75 or more), is_integrated_signal, is_integrated_precursor (0 or 1),
    correlation_to_gaussian, correlation_to_precursor (0 where the median has no signal in the range), start, stop.
    """

    def kernel(member, xs, v, p, near):
        at = float(near[0])
        names, grid, m = _matrix(member, xs, v)
        own = _matrix(np.zeros(len(xs), np.int64), xs, p)[2][0]
        m = m[m.sum(1) > 0]
        if not len(m):
            return {"n_good": [0], "is_integrated_signal": [0], "is_integrated_precursor": [0], "correlation_to_gaussian": [0.0], "correlation_to_precursor": [0.0], "start": [grid[0]], "stop": [grid[-1]]}
        r, selected, _ = _agreement(grid, m, width, at if hold else None, **how)
        _, median, a, z = local_median(grid, m[selected], width, how.get("least", 3), at if hold else None)
        inside = (np.arange(len(grid)) >= a) & (np.arange(len(grid)) <= z)
        held = np.where(inside, own, 0.0)
        live = median[inside].sum() > 0
        bell = cosine_bell(grid, at, max(width / 6, (grid[z] - grid[a]) / 4))
        gaussian, parent = correlations(np.stack([bell, held]), median) if live else (0.0, 0.0)
        return {
            "n_good": [int((r >= identifying).sum())], "is_integrated_signal": [int(live and (r >= QUANTITATIVE).any())], "is_integrated_precursor": [int(live and held.sum() > 0)],
            "correlation_to_gaussian": [float(gaussian)], "correlation_to_precursor": [float(parent)], "start": [grid[a]], "stop": [grid[z]],
        }

    return per_group(traces.where(F.col(x).isNotNull()), key, [ion, x], [ion, x, value, precursor, centre], "n_good int, is_integrated_signal int, is_integrated_precursor int, correlation_to_gaussian double, correlation_to_precursor double, start double, stop double", kernel)


# -- traces between their points -----------------------------------------------------------------------------------------


def natural_spline(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Second derivatives at the knots of the cubic spline that is straight at both ends: the tridiagonal system, swept down and
    back up once."""
    n = len(x)
    m = np.zeros(n)
    if n < 3:
        return m
    h = np.diff(x)
    slope = np.diff(y) / h
    upper, right = np.zeros(n), np.zeros(n)
    for i in range(1, n - 1):
        pivot = 2 * (h[i - 1] + h[i]) - h[i - 1] * upper[i - 1]
        upper[i] = h[i] / pivot
        right[i] = (6 * (slope[i] - slope[i - 1]) - h[i - 1] * right[i - 1]) / pivot
    for i in range(n - 2, 0, -1):
        m[i] = right[i] - upper[i] * m[i + 1]
    return m


def spline_at(x: np.ndarray, y: np.ndarray, m: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The spline at given places, not below 0 and 0 outside of the trace."""
    if len(x) < 2:
        return np.where(at == x[0], np.maximum(y[0], 0.0), 0.0) if len(x) else np.zeros(len(at))
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(x) - 2)
    h = x[k + 1] - x[k]
    a, b = (x[k + 1] - at) / h, (at - x[k]) / h
    v = a * y[k] + b * y[k + 1] + ((a**3 - a) * m[k] + (b**3 - b) * m[k + 1]) * h * h / 6
    return np.where((at < x[0]) | (at > x[-1]), 0.0, np.maximum(v, 0.0))


def refined_apex(x: np.ndarray, y: np.ndarray, start: float, stop: float, steps: int = 10, even: float = 0.99, most: int = 60) -> tuple[float, float]:
    """(place, height) of the spline's apex from start to stop: between the neighbours of the greatest point there, ten places are
    looked at, then ten around the best of them, until all are within a hundredth of it.  NaN without signal."""
    inside = np.flatnonzero((x >= start) & (x <= stop) & (y > 0))
    if not len(inside):
        return float("nan"), float("nan")
    top = int(inside[y[inside].argmax()])
    m = natural_spline(x, y)
    low, high = max(start, x[max(top - 1, 0)]), min(stop, x[min(top + 1, len(x) - 1)])
    best, height = float(x[top]), float(y[top])
    for _ in range(most):
        if high <= low:
            break
        at = low + (high - low) / steps * np.arange(steps)
        v = spline_at(x, y, m, at)
        k = int(v.argmax())
        best, height = float(at[k]), float(v[k])
        if height <= 0 or v.min() >= even * height:
            break
        step = (high - low) / steps
        low, high = best - step, best + step
    return best, height


def apex_times(df: DataFrame, key: list[str], x: str, y: str, width: float = 25.0, least: int = 3) -> DataFrame:
    """Of each trace's peak: key, apex (x of the spline's greatest value), height, start, stop.  Of points that share an x the last
    counts; a trace without signal in its range has no apex."""

    def kernel(xs, ys):
        xs, ys = xs.astype(float), np.nan_to_num(ys.astype(float))
        last = np.append(np.diff(xs) > 0, True)
        xs, ys = xs[last], ys[last]
        a, z, _ = peak_range(xs, ys, width, least)
        apex, height = refined_apex(xs, ys, xs[a], xs[z])
        return {"apex": [apex], "height": [height], "start": [xs[a]], "stop": [xs[z]]}

    return per_group(df.where(F.col(x).isNotNull()), key, [x, y], [x, y], "apex double, height double, start double, stop double", kernel)


def resampled(df: DataFrame, key: list[str], x: str, y: str, points: int, low: str, high: str) -> DataFrame:
    """Traces at `points` even places from the columns low to high (one value of each a key): key, place, x, value of the spline."""

    def kernel(xs, ys, a, z):
        xs, ys = xs.astype(float), np.nan_to_num(ys.astype(float))
        last = np.append(np.diff(xs) > 0, True)
        xs, ys = xs[last], ys[last]
        at = float(a[0]) + (float(z[0]) - float(a[0])) * np.arange(points) / points
        return {"place": np.arange(points, dtype=np.int32), "x": at, "value": spline_at(xs, ys, natural_spline(xs, ys), at)}

    return per_group(df.where(F.col(x).isNotNull()), key, [x, y], [x, y, low, high], "place int, x double, value double", kernel)
