"""Alignment by densities on a rectangle: counts on a grid, stamped with cosine bells, and the ridge through them.

Counts and stamps are aggregations, so a key (a run, a pair of runs) may hold any share of the rows.  What a ridge is read from is
one grid a key, whose size is a parameter.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakfold.operators import kernels
from peakfold.operators.joins import small_side
from peakfold.operators.kernels import per_group

#: Width at half height over the deviation of a Gaussian.
HALF_WIDTH = 2 * math.sqrt(2 * math.log(2))


def cell(v: Column, low: Column, high: Column, cells: int) -> Column:
    """The grid point next to v, of `cells` from low to high; 0 where these are equal."""
    return F.when(high > low, F.floor((v - low) / (high - low) * (cells - 1) + 0.5)).otherwise(F.lit(0)).cast("int")


def _spread(n: Column, s1: Column, s2: Column, cells: int) -> Column:
    """Deviation of the bells in cells: Silverman's for two dimensions, a fortieth of the grid at most."""
    variance = F.greatest((s2 - s1 * s1 / n) / n, F.lit(0.0))
    return F.least(F.lit(cells / 40), F.pow(n.cast("double"), F.lit(-1 / 6)) * F.sqrt(variance) / HALF_WIDTH)


def _bell(away: Column, deviation: Column) -> Column:
    """Square root of the bell's height; a deviation of 0 is one cell."""
    height = F.when(away <= 2 * deviation, F.greatest(F.cos(away * math.pi / (4 * deviation)), F.lit(0.0)) * math.pi / (8 * deviation)).otherwise(F.lit(0.0))
    return F.when(deviation > 0, F.sqrt(height)).otherwise((away == 0).cast("double"))


def rectangle_density(df: DataFrame, key: list[str], x: str, y: str, x_cells: int = 3000, y_cells: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(grid: key, i, j, weight; ranges: key, n, x0, x1, y0, y1) of the points of each key.

    A point adds the root of the product of two bells to the cells around its own.  The stamp is a product, so the counts are spread
    along x first and then along y.
    """
    p = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*key, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    ranges = p.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("__x").alias("x0"), F.max("__x").alias("x1"), F.min("__y").alias("y0"), F.max("__y").alias("y1"))
    at = p.join(small_side(ranges), key).select(*key, cell(F.col("__x"), F.col("x0"), F.col("x1"), x_cells).alias("i"), cell(F.col("__y"), F.col("y0"), F.col("y1"), y_cells).alias("j"))
    counts = at.groupBy(*key, "i", "j").agg(F.count(F.lit(1)).alias("c"))
    sums = counts.groupBy(*key).agg(F.sum("c").alias("n"), *[F.sum(F.col("c") * F.col(a) * b).alias(f"{a}{k}") for a in "ij" for k, b in ((1, 1), (2, F.col(a)))])
    s = sums.select(*key, _spread(F.col("n"), F.col("i1"), F.col("i2"), x_cells).alias("__di"), _spread(F.col("n"), F.col("j1"), F.col("j2"), y_cells).alias("__dj"))
    now = counts.join(small_side(s), key).withColumn("weight", F.col("c").cast("double"))
    for a, cells in (("i", x_cells), ("j", y_cells)):
        radius = F.floor(2 * F.col(f"__d{a}") + 0.5)
        now = now.withColumn("__o", F.explode(F.sequence(-radius, radius))).withColumn("__w", F.col("weight") * _bell(F.abs("__o").cast("double"), F.col(f"__d{a}")))
        now = now.withColumn(a, (F.col(a) + F.col("__o")).cast("int")).where((F.col(a) >= 0) & (F.col(a) < cells) & (F.col("__w") > 0))
        now = now.groupBy(*key, "i", "j").agg(F.sum("__w").alias("weight"), F.first("__di").alias("__di"), F.first("__dj").alias("__dj"))
    return now.select(*key, "i", "j", F.round("weight", 9).alias("weight")), ranges


def walk_ridge(g: np.ndarray) -> np.ndarray:
    """Of every column i of the grid the cell j of the ridge: from the greatest cell (the first of equal ones) each step
    goes to the greatest of the next column's three nearest cells; straight on if that is among the greatest, or if both
    sides are equal.  The rim is not followed: the walk stays one cell inside."""
    n, m = g.shape
    out = np.empty(n, np.int64)
    i0, j0 = np.unravel_index(int(g.argmax()), g.shape)
    out[i0] = j0
    for step in (1, -1):
        i, j = int(i0), int(j0)
        while 0 <= i + step < n:
            j = min(max(j, 1), m - 2)
            i += step
            down, same, up = g[i, j - 1 : j + 2]
            if same < max(down, up) and down != up:
                j += 1 if up > down else -1
            out[i] = j
    return out


def ridge(df: DataFrame, key: list[str], x: str, y: str, x_cells: int = 3000, y_cells: int = 1000) -> DataFrame:
    """key, i, x, y of the ridge at each of the x_cells grid points, for keys with points at two x at least."""
    grid, ranges = rectangle_density(df, key, x, y, x_cells, y_cells)

    def kernel(i, j, w):
        g = np.zeros((x_cells, y_cells))
        g[i, j] = w
        return {"i": np.arange(x_cells, dtype=np.int32), "j": walk_ridge(g).astype(np.int32)}

    path = per_group(grid, key, ["i", "j"], ["i", "j", "weight"], "i int, j int", kernel)
    back = lambda c, low, high, cells: F.col(low) + F.col(c) * (F.col(high) - F.col(low)) / (cells - 1)
    return path.join(small_side(ranges.where("x1 > x0")), key).select(*key, "i", back("i", "x0", "x1", x_cells).alias("x"), back("j", "y0", "y1", y_cells).alias("y"))


def corrected_errors(df: DataFrame, key: list[str], x: str, y: str, ident: str, x_cells: int = 3000, y_cells: int = 1000) -> DataFrame:
    """Errors y over time x less what is systematic: key, ident, corrected, probability.

    With more than 20 points of a key that is the ridge of their density, linear between its points; with 2 to 20 a line; else
    nothing.  `probability`: of belonging to the Gaussian of a Gaussian and uniform mixture of the corrected errors.
    """
    p = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*key, ident, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    size = small_side(p.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"), F.min("__x").alias("__a"), F.max("__x").alias("__z"), F.regr_slope("__y", "__x").alias("__m"), F.regr_intercept("__y", "__x").alias("__b"), F.avg("__y").alias("__mean")))
    p = p.join(size, key)
    dense = (F.col("__n") > 20) & (F.col("__z") > F.col("__a"))
    path = ridge(p.where(dense), key, "__x", "__y", x_cells, y_cells)
    ahead = _with_next(path, key)
    place = (F.col("__x") - F.col("__a")) / (F.col("__z") - F.col("__a")) * (x_cells - 1)
    met = p.where(dense).withColumn("__p", place).withColumn("i", F.least(F.floor("__p"), F.lit(x_cells - 2)).cast("int")).join(ahead, [*key, "i"])
    ridged = met.withColumn("corrected", F.col("__y") - (F.col("__u") + (F.col("__v") - F.col("__u")) * (F.col("__p") - F.col("i")))).select(*key, ident, "corrected")
    line = F.when(F.col("__n") > 1, F.coalesce(F.col("__m") * F.col("__x") + F.col("__b"), F.col("__mean"))).otherwise(F.lit(0.0))
    rest = p.where(~dense).withColumn("corrected", F.col("__y") - line).select(*key, ident, "corrected")
    types = dict(df.dtypes)

    def kernel(ids, v):
        return {ident: ids, "corrected": v, "probability": kernels.mixture(v)[3]}

    return per_group(ridged.unionByName(rest), key, ["corrected", ident], [ident, "corrected"], f"`{ident}` {types[ident]}, corrected double, probability double", kernel)


def _with_next(path: DataFrame, key: list[str]) -> DataFrame:
    """A ridge's y at each grid point and at the next."""
    w = Window.partitionBy(*key).orderBy("i")
    return path.select(*key, "i", F.col("y").alias("__u"), F.lead("y").over(w).alias("__v")).where("__v IS NOT NULL")


# -- mixtures of empirical densities --------------------------------------------------------------------------------------


def empirical_posterior(delta: np.ndarray, bins: int = 400, rounds: int = 10) -> np.ndarray:
    """Probability of being a match for each deviation, by a mixture whose two components are densities of the data themselves.

    Matches begin as a bell around the median, as wide as the middle half.  Each round draws both densities anew from the
    points, weighted by what they are likely to be: that of matches narrowly smoothed and falling to both sides of its mode,
    that of the rest smoothed over an eighth of the range, for without such shapes two free densities couldn't be told apart.
    """
    if len(delta) < 2 or delta.max() <= delta.min():
        return np.ones(len(delta))
    low, high = float(delta.min()), float(delta.max())
    step = (high - low) / (bins - 1)
    at = np.clip(np.round((delta - low) / step).astype(int), 0, bins - 1)
    half = float(np.subtract(*np.percentile(delta, [75, 25])))
    narrow = max(0.9 * min(float(delta.std()), half / 1.34 if half > 0 else np.inf) * len(delta) ** -0.2, step)
    away = np.abs(np.arange(bins)[:, None] - np.arange(bins)[None, :]) * step
    blur, wide = (np.where(away <= 2 * h, np.cos(np.minimum(away / (4 * h), 0.5) * np.pi), 0.0) for h in (narrow, (high - low) / 8))
    post = 0.9 * np.exp(-0.5 * ((delta - float(np.median(delta))) / max(half, step)) ** 2) + 0.05
    for _ in range(rounds):
        own, rest = (np.bincount(at, weights=w, minlength=bins) @ k for w, k in ((post, blur), (1 - post, wide / wide.sum(0))))
        top = int(own.argmax())
        own[top:], own[: top + 1] = np.minimum.accumulate(own[top:]), np.minimum.accumulate(own[: top + 1][::-1])[::-1]
        share = float(np.clip(post.mean(), 0.01, 0.99))
        f = share * own / max(own.sum(), 1e-300)
        g = (1 - share) * rest / max(rest.sum(), 1e-300)
        post = (f / np.maximum(f + g, 1e-300))[at]
    return post


def empirical_alignment(df: DataFrame, key: list[str], x: str, y: str, ident: str) -> DataFrame:
    """Like `kernels.rt_align` with the empirical mixture for the fit: key, ident, warped, delta, probability."""
    types = dict(df.dtypes)

    def kernel(ids, xs, ys):
        xs, ys = xs.astype(float), ys.astype(float)
        warped = kernels.align(xs, ys)(xs)
        return {ident: ids, "warped": warped, "delta": ys - warped, "probability": empirical_posterior(ys - warped)}

    return per_group(df, key, [x, y, ident], [ident, x, y], f"`{ident}` {types[ident]}, warped double, delta double, probability double", kernel)
