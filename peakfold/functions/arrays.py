"""Array and scalar expressions over numeric arrays and peak lists.  All stay inside the JVM (higher-order functions).

A peak list is array<struct<mz, intensity>>; `peaks` makes one from parallel arrays, so they cannot diverge.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

def _zero() -> Column:
    return F.lit(0.0)


# -- scalars -----------------------------------------------------------------------------------------------------------


def protected_log(x: Column, base: float = math.e) -> Column:
    """log of positive values, else 0."""
    return F.when(x > 0, F.ln(x) / math.log(base)).otherwise(_zero())


def log10_factorial(n: Column) -> Column:
    """log10(n!); by sum beyond the range of factorial()."""
    small = F.log10(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))
    more = F.aggregate(F.sequence(F.lit(20), F.greatest(n, F.lit(20)).cast("int")), _zero(), lambda a, k: a + F.when(k > 20, F.log10(k.cast("double"))).otherwise(_zero()))
    return small + more


def interpolate(x: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Linear interpolation; the mean of y0 and y1 where x0 = x1."""
    return F.when(x1 == x0, (y0 + y1) / 2).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))


def map_range(x: Column, low: float, high: float, to_low: float, to_high: float) -> Column:
    return F.lit(to_low) + (x - low) / (high - low) * (to_high - to_low)


def chunk_range(low: Column, high: Column, n: int) -> Column:
    """n equal closed ranges as array<struct<start, stop>>."""
    step = (high - low) / n
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct((low + k * step).alias("start"), (low + (k + 1) * step).alias("stop")))


# -- tolerances --------------------------------------------------------------------------------------------------------


def tolerance(mass: Column, ppm: float | None = None, amu: float | None = None, resolution: float | None = None) -> Column:
    """Half width in mass units of a tolerance given in ppm, mass units or by resolution."""
    if amu is not None:
        return F.lit(float(amu))
    return mass * (ppm * 1e-6 if ppm is not None else 1.0 / resolution)


def within_ppm(a: Column, b: Column, ppm: float) -> Column:
    return F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b)) * (ppm * 1e-6)


def delta_ppm(a: Column, b: Column) -> Column:
    return (a - b) / b * 1e6


# -- vectors -----------------------------------------------------------------------------------------------------------


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def divide(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.try_divide(x, y))


def scale(a: Column, by) -> Column:
    return F.transform(a, lambda x: x * by)


def total(a: Column) -> Column:
    return F.aggregate(a, _zero(), lambda s, x: s + x.cast("double"))


def mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, total(a) / F.size(a)).otherwise(_zero())


def variance(a: Column) -> Column:
    """Population variance; 0 when empty."""
    m = mean(a)
    return F.when(F.size(a) > 0, F.aggregate(F.transform(a, lambda x: x.cast("double")), F.struct(_zero().alias("s"), m.alias("m")), lambda s, x: F.struct((s["s"] + (x - s["m"]) * (x - s["m"])).alias("s"), s["m"].alias("m")), lambda s: s["s"]) / F.size(a)).otherwise(_zero())


def stdev(a: Column) -> Column:
    return F.sqrt(variance(a))


def top_sum(a: Column, n: int) -> Column:
    """Sum of the n largest values."""
    return total(F.slice(F.reverse(F.array_sort(a)), 1, n))


def quantile(a: Column, p: float) -> Column:
    """Linear interpolation at (n - 1) p; null when empty."""
    s = F.array_sort(a)
    at = (F.size(a) - 1) * F.lit(float(p))
    lo = F.floor(at).cast("int")
    hi = F.least(lo + 1, F.size(a) - 1)
    x, y = F.element_at(s, lo + 1).cast("double"), F.element_at(s, hi + 1).cast("double")
    return F.when(F.size(a) > 0, x + (y - x) * (at - lo))


def no_nan(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull() & ~F.isnan(x))


def extract(a: Column, start: Column, stop: Column) -> Column:
    """Elements of positions start to stop, from 0, stop included."""
    return F.slice(a, start + 1, stop - start + 1)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize_l2(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def normalize_sum(a: Column) -> Column:
    s = total(a)
    return F.when(s > 0, F.transform(a, lambda x: x / s)).otherwise(a)


def normalize_max(a: Column) -> Column:
    m = F.array_max(a)
    return F.when(m > 0, F.transform(a, lambda x: x / m)).otherwise(a)


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(_zero())


def spectral_angle(a: Column, b: Column) -> Column:
    """1 - 2 acos(cosine) / pi, with the cosine clamped to [0.00001, 0.99999]."""
    return 1 - 2 * F.acos(F.greatest(F.lit(0.00001), F.least(F.lit(0.99999), cosine(a, b)))) / math.pi


def pearson(a: Column, b: Column) -> Column:
    """0 without variance."""
    n = F.size(a)

    def ratio(sa, sb, aa, bb, ab):
        var = (aa - sa * sa / n) * (bb - sb * sb / n)
        return F.when(var > 0, (ab - sa * sb / n) / F.sqrt(var)).otherwise(_zero())

    return once(total(a), total(b), dot(a, a), dot(b, b), dot(a, b), use=ratio)


def average_ranks(a: Column) -> Column:
    """Ranks from 1, ties share their mean: the first place in the sorted array, plus half the number of equals after it."""
    sort = F.array_sort(a)
    return once(sort, F.reverse(sort), use=lambda up, down: F.transform(a, lambda x: (F.array_position(up, x) + (F.size(a) + 1 - F.array_position(down, x))) / 2))


def once(*values: Column, use) -> Column:
    """use(values), with each value evaluated once however often `use` names it: they are bound as fields of a struct."""
    bound = F.array(F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)]))
    return F.transform(bound, lambda s: use(*[s[f"v{i}"] for i in range(len(values))]))[0]


def spearman(a: Column, b: Column) -> Column:
    return once(average_ranks(a), average_ranks(b), use=pearson)


def squared_error(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def fit_error_score(predicted: Column, acquired: Column) -> Column:
    """ln(1 / sum of squared differences) of the two vectors at length 1; floored at 0."""
    e = squared_error(normalize_l2(predicted), normalize_l2(acquired))
    return F.when(e > 0, F.greatest(-F.ln(e), _zero())).otherwise(_zero())


def xtandem_score(dot_product: Column, matches: Column) -> Column:
    """log10(dot) + log10(matches!); 0 without a match."""
    return F.when((dot_product > 0) & (matches > 0), F.log10(dot_product) + log10_factorial(matches)).otherwise(_zero())


def hyperscore(dot_product: Column, matches: Column, offset: float = 2.0) -> Column:
    return F.greatest(xtandem_score(dot_product, matches) + offset, _zero())


def weighted_peak_score(predicted: Column, acquired: Column, correlation: Column, floor: float = 0.01) -> Column:
    return predicted * acquired * F.greatest(correlation, F.lit(floor))


# -- peak lists --------------------------------------------------------------------------------------------------------


def peaks(mz: Column, intensity: Column) -> Column:
    return F.zip_with(mz, intensity, lambda m, i: F.struct(m.cast("double").alias("mz"), i.cast("double").alias("intensity")))


def sqrt_intensity(p: Column) -> Column:
    return F.transform(p, lambda x: F.struct(x["mz"].alias("mz"), F.when(x["intensity"] > 0, F.sqrt(x["intensity"])).otherwise(_zero()).alias("intensity")))


def trim(p: Column, low: float, high: float) -> Column:
    return F.filter(p, lambda x: x["mz"].between(low, high))


def top_peaks(p: Column, n: int) -> Column:
    """The n most intense peaks, in order of mz; ties go to the smaller mz."""
    ranked = F.array_sort(F.transform(p, lambda x: F.struct((-x["intensity"]).alias("k"), x["mz"].alias("mz"), x["intensity"].alias("intensity"))))
    return F.array_sort(F.transform(F.slice(ranked, 1, n), lambda x: F.struct(x["mz"].alias("mz"), x["intensity"].alias("intensity"))))


def base_peak_filter(p: Column, fraction: float) -> Column:
    """Peaks of at least `fraction` of the largest."""
    top = F.array_max(F.transform(p, lambda x: x["intensity"]))
    return F.filter(p, lambda x: x["intensity"] >= top * fraction)


def near(p: Column, target: Column, ppm: float) -> Column:
    return F.filter(p, lambda x: within_ppm(x["mz"], target, ppm))


def intensity_near(p: Column, target: Column, ppm: float) -> Column:
    """Sum of the intensities within the tolerance of a target."""
    return F.aggregate(near(p, target, ppm), _zero(), lambda s, x: s + x["intensity"])


def max_intensity_near(p: Column, target: Column, ppm: float) -> Column:
    return F.coalesce(F.array_max(F.transform(near(p, target, ppm), lambda x: x["intensity"])), _zero())


def peak_total(p: Column) -> Column:
    return F.aggregate(p, _zero(), lambda s, x: s + x["intensity"])


# -- isotope packets: -1, 0, +1, +2 ------------------------------------------------------------------------------------


def isotope_dot(packet: Column, expected: Column) -> Column:
    """Cosine of the 0, +1, +2 isotopes with expectation; a -1 peak counts against it."""
    n = norm(packet) * norm(expected)
    return F.when(n > 0, dot(F.slice(packet, 2, 3), expected) / n).otherwise(_zero())


def blank_ratio(packet: Column) -> Column:
    """Share of the -1 peak in the packet."""
    return F.when(total(packet) > 0, packet[0] / total(packet)).otherwise(_zero())
