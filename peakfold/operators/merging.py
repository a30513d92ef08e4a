"""Spectra and peaks merged by mass: few spectra exactly, many in bins; peaks of one spectrum the most intense first."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakfold.operators.kernels import per_group
from peakfold.operators.running import ranges_for


def _near(masses: list[float], m: float, ppm: float) -> int:
    """Place of the nearest of sorted masses within the tolerance of the larger (the lower of equally near ones), or -1."""
    i = bisect_left(masses, m)
    best, away = -1, float("inf")
    for k in (i - 1, i):
        if 0 <= k < len(masses):
            d = abs(masses[k] - m)
            if d <= max(masses[k], m) * ppm * 1e-6 and d < away:
                best, away = k, d
    return best


def first_seen(mz: np.ndarray, intensity: np.ndarray, ppm: float) -> tuple[list[float], list[float]]:
    """Peaks in the order given, each added to the mass seen before that it is within the tolerance of; else a mass of its own."""
    masses: list[float] = []
    total: list[float] = []
    for m, y in zip(mz.tolist(), intensity.tolist()):
        k = _near(masses, m, ppm)
        if k < 0:
            k = bisect_left(masses, m)
            masses.insert(k, m)
            total.insert(k, 0.0)
        total[k] += y
    return masses, total


def most_intense_first(mz: np.ndarray, intensity: np.ndarray, ppm: float) -> tuple[list[float], list[float]]:
    """Peaks from the most intense down (of equal ones the lighter), each merged with the more intense of the neighbours that are
    within the tolerance, at the mean mass by intensity."""
    masses: list[float] = []
    total: list[float] = []
    for i in np.lexsort((mz, -intensity)).tolist():
        m, y = float(mz[i]), float(intensity[i])
        k = bisect_left(masses, m)
        near = [j for j in (k - 1, k) if 0 <= j < len(masses) and abs(masses[j] - m) <= max(masses[j], m) * ppm * 1e-6]
        if near:
            j = max(near, key=lambda j: (total[j], -j))
            both = total[j] + y
            m, y = ((masses[j] * total[j] + m * y) / both if both > 0 else masses[j]), both
            del masses[j], total[j]
        k = bisect_left(masses, m)
        masses.insert(k, m)
        total.insert(k, y)
    return masses, total


def combined_peaks(df: DataFrame, key: list[str], mz: str, intensity: str, ppm: float) -> DataFrame:
    """Peaks of each spectrum merged within the tolerance, the most intense first: key, mz, intensity."""

    def kernel(m, y):
        masses, total = most_intense_first(m.astype(float), y.astype(float), ppm)
        return {mz: np.array(masses), intensity: np.array(total)}

    return per_group(df.where(F.col(mz).isNotNull() & F.col(intensity).isNotNull()), key, [mz, intensity], [mz, intensity], f"`{mz}` double, `{intensity}` double", kernel)


def merged_spectra(df: DataFrame, key: list[str], spectrum: str, rt: str, mz: str, intensity: str, ppm: float = 10.0, most: int = 50, width: float = 0.1) -> DataFrame:
    """One spectrum of each key's spectra: key, mz, intensity, rt, n_spectra.

    Up to `most` spectra are merged by mass: each peak joins the mass that was seen first, spectra in the order of rt, and rt is
    their mean.  More of them are added up in bins of `width`, whose number is rounded, and rt is the least.
    """
    p = df.where(F.col(mz).isNotNull() & F.col(intensity).isNotNull() & F.col(rt).isNotNull())
    # Nearly as many spectra as rows: dealt out first, so that no task adds up more than about a million before and after a shuffle.
    each = p.select(*key, spectrum, rt).repartition(ranges_for(df, 1_000_000) + df.sparkSession.sparkContext.defaultParallelism, *key, spectrum).groupBy(*key, spectrum).agg(F.min(F.col(rt).cast("double")).alias("__rt"))
    size = each.groupBy(*key).agg(F.count(F.lit(1)).alias("n_spectra"), F.avg("__rt").alias("__mean"), F.min("__rt").alias("__least"))
    x = p.select(*key, spectrum, rt, mz, intensity).join(size, key)
    binned = x.where(F.col("n_spectra") > most).groupBy(*key, F.floor(F.col(mz) / width + 0.5).alias("__b")).agg(F.sum(intensity).cast("double").alias("intensity")).where("intensity > 0").select(*key, (F.col("__b") * width).alias("mz"), "intensity")

    def kernel(m, y):
        masses, total = first_seen(m.astype(float), y.astype(float), ppm)
        return {"mz": np.array(masses), "intensity": np.array(total)}

    exact = per_group(x.where(F.col("n_spectra") <= most), key, [rt, spectrum, mz], [mz, intensity], "mz double, intensity double", kernel)
    times = size.select(*key, F.when(F.col("n_spectra") > most, F.col("__least")).otherwise(F.col("__mean")).alias("rt"), "n_spectra")
    return exact.unionByName(binned).join(times, key)
