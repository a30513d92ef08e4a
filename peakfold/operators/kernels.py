"""Numpy kernels for operators that carry state from row to row, and the grouped DataFrame functions around them.

A group is one trace, one candidate or one file pair, small by nature; the group function sees it as arrays.
"""

from __future__ import annotations

import heapq
import itertools
import os
import tempfile
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def per_group(df: DataFrame, key: list[str], order: list[str], columns: list[str], schema: str, kernel: Callable[..., dict]) -> DataFrame:
    """kernel(arrays of the group's columns in order) -> dict of arrays; key columns are put in front.

    Rows are dealt out by the key and sorted by Spark; a batch holds many groups, of which the last waits for the next batch.
    Missing numbers are NaN to the kernel, and NaN is null in the result.
    """
    types = dict(df.dtypes)
    full = StructType.fromDDL(", ".join([f"`{k}` {types[k]}" for k in key] + [schema]))
    wanted = to_arrow_schema(full)
    names = list(dict.fromkeys([*key, *order, *columns]))

    def starts(t: pa.Table) -> np.ndarray:
        """First rows of the groups of t but the first."""
        new = np.zeros(max(t.num_rows - 1, 0), bool)
        for k in key:
            c = t.column(k).combine_chunks()
            a, z = c[1:], c[:-1]
            new |= np.asarray(pc.fill_null(pc.not_equal(a, z), False)) | (np.asarray(a.is_null()) != np.asarray(z.is_null()))
        return np.flatnonzero(new) + 1

    def solved(t: pa.Table, cut: np.ndarray) -> pa.RecordBatch:
        given = {c: t.column(c).to_numpy() for c in columns}
        first, end = np.concatenate([[0], cut]).astype(np.int64), np.concatenate([cut, [t.num_rows]]).astype(np.int64)
        found = [kernel(*[given[c][a:z] for c in columns]) for a, z in zip(first.tolist(), end.tolist())]
        sizes = [len(next(iter(f.values()))) for f in found]
        at = pa.array(np.repeat(first, sizes))
        out = [t.column(k).combine_chunks().take(at) for k in key]
        for field in list(wanted)[len(key) :]:
            parts = [f[field.name] for f in found]
            plain = all(isinstance(p, np.ndarray) and p.dtype != object for p in parts)
            out.append(pa.array(np.concatenate(parts), from_pandas=True).cast(field.type) if plain else pa.array([v for p in parts for v in p], field.type, from_pandas=True))
        return pa.RecordBatch.from_arrays(out, schema=wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            edge = len(starts(pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), b.slice(0, 1)]))) if held else 0
            cut = starts(pa.Table.from_batches([b]))
            if edge or len(cut):
                t = pa.Table.from_batches([*held, b])
                before = t.num_rows - b.num_rows
                every = np.concatenate([[before] if edge else [], cut + before]).astype(np.int64)
                last = int(every[-1])
                yield solved(t.slice(0, last), every[:-1])
                held = t.slice(last).to_batches()
            else:
                held.append(b)
        if held:
            yield solved(pa.Table.from_batches(held), np.zeros(0, np.int64))

    return df.select(*names).repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, full)


# -- exclusion ---------------------------------------------------------------------------------------------------------


def exclusive_top(scores: np.ndarray, k: int, zone: int) -> np.ndarray:
    """Positions of the k best scores, each at least `zone` + 1 from better ones; ties to the earlier."""
    taken: list[int] = []
    free = np.ones(len(scores), bool)
    for i in np.argsort(-scores, kind="stable"):
        if free[i]:
            taken.append(int(i))
            if len(taken) == k:
                break
            free[max(0, i - zone) : i + zone + 1] = False
    return np.array(taken, np.int64)


def topk_exclusion(df: DataFrame, key: list[str], order: list[str], ident: str, score: str, k: int, zone: int) -> DataFrame:
    types = dict(df.dtypes)

    def kernel(ids, s):
        at = exclusive_top(s.astype(float), k, zone)
        return {ident: ids[at], "score": s[at].astype(float), "rank": np.arange(1, len(at) + 1, dtype=np.int32)}

    return per_group(df, key, order, [ident, score], f"`{ident}` {types[ident]}, score double, rank int", kernel)


# -- peaks -------------------------------------------------------------------------------------------------------------


def peak_bounds(y: np.ndarray, apex: int | None = None, floor: float = 0.01, uphill: float = 0.2, least: int = 3) -> tuple[int, int]:
    """First and last point of the peak around its apex.  Each side in turn grows while it is above a floor of the apex and
    hasn't risen by `uphill` of the apex over its lowest point for two points."""
    if not len(y):
        return 0, -1
    top = int(np.argmax(y)) if apex is None else apex
    edge = [top, top]
    low = [y[top], y[top]]
    best = [top, top]
    rises = [0, 0]
    alive = [True, True]
    while any(alive):
        for side, step in ((0, -1), (1, 1)):
            if not alive[side]:
                continue
            i = edge[side] + step
            if not 0 <= i < len(y) or y[i] < floor * y[top]:
                alive[side] = False
                continue
            edge[side] = i
            if y[i] <= low[side]:
                low[side], best[side], rises[side] = y[i], i, 0
            elif y[i] > low[side] + uphill * y[top]:
                rises[side] += 1
                alive[side] = rises[side] < 2
    a, z = best
    while z - a + 1 < least and (a > 0 or z < len(y) - 1):
        a, z = max(0, a - 1), min(len(y) - 1, z + 1)
    return a, z


def bounds(df: DataFrame, key: list[str], x: str, y: str) -> DataFrame:
    def kernel(xs, ys):
        a, z = peak_bounds(ys.astype(float))
        return {"start": [float(xs[a])], "stop": [float(xs[z])], "apex": [float(xs[int(np.argmax(ys))])], "points": [z - a + 1]}

    return per_group(df, key, [x], [x, y], "start double, stop double, apex double, points long", kernel)


def savitzky_golay_coefficients(points: int, degree: int, derivative: int = 0) -> np.ndarray:
    """Least-squares smoothing coefficients."""
    half = points // 2
    x = np.arange(-half, half + 1)[:, None] ** np.arange(degree + 1)
    return np.linalg.pinv(x)[derivative]


def demultiplex_factor(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    both = before + after
    return np.divide(before, both, out=np.full(len(both), np.nan), where=both > 0)


# -- densities and curves ----------------------------------------------------------------------------------------------


def bandwidth(x: np.ndarray) -> float:
    """Silverman's rule with the population deviation."""
    return bandwidth_of(float(x.std()) if len(x) else 0.0, len(x))


def bandwidth_of(deviation: float, n: int) -> float:
    return max(1.06 * deviation * max(n, 1) ** -0.2, 1e-9)


def density(x: np.ndarray, grid: np.ndarray, width: float | None = None) -> np.ndarray:
    """Kernel density on a grid; the kernel is a cosine bell that ends after two widths."""
    h = bandwidth(x) if width is None else width
    out = np.zeros(len(grid))
    for v in x:
        a, z = np.searchsorted(grid, [v - 2 * h, v + 2 * h])
        out[a:z] += np.pi / (8 * h) * np.cos((grid[a:z] - v) * np.pi / (4 * h))
    return out / max(len(x), 1)


def mode(x: np.ndarray, bins: int = 100) -> float:
    if not len(x) or x.min() == x.max():
        return float(x[0]) if len(x) else float("nan")
    grid = np.linspace(x.min(), x.max(), bins)
    return float(grid[np.argmax(density(x, grid))])


def kde_mode(df: DataFrame, key: list[str], value: str, bins: int = 100) -> DataFrame:
    return per_group(df, key, [value], [value], "mode double, n long", lambda v: {"mode": [mode(v.astype(float), bins)], "n": [len(v)]})


def pava(y: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Non-decreasing least-squares fit."""
    value, size, count = [], [], []
    for v, w in zip(y.astype(float), np.ones(len(y)) if weight is None else weight):
        value.append(v)
        size.append(w)
        count.append(1)
        while len(value) > 1 and value[-2] > value[-1]:
            v2, w2, c2 = value.pop(), size.pop(), count.pop()
            value[-1] = (value[-1] * size[-1] + v2 * w2) / (size[-1] + w2)
            size[-1] += w2
            count[-1] += c2
    return np.repeat(value, count)


def monotone_cubic(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic interpolation without overshoot, flat beyond the ends.

    The slope at an inner knot is the weighted harmonic mean of the secants beside it (Fritsch and Butland), and 0 where they
    differ in sign, which keeps every piece monotone; at the ends it is the secant.
    """
    if len(x) < 2:
        return np.full(len(at), y[0] if len(y) else np.nan)
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    with np.errstate(divide="ignore", invalid="ignore"):
        inner = 3 * (h[:-1] + h[1:]) / ((h[:-1] + 2 * h[1:]) / d[:-1] + (2 * h[:-1] + h[1:]) / d[1:])
    m = np.concatenate([d[:1], np.where(d[:-1] * d[1:] > 0, inner, 0.0), d[-1:]])
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(h) - 1)
    t = np.clip((at - x[k]) / h[k], 0, 1)
    return y[k] * (2 * t**3 - 3 * t**2 + 1) + h[k] * m[k] * (t**3 - 2 * t**2 + t) + y[k + 1] * (3 * t**2 - 2 * t**3) + h[k] * m[k + 1] * (t**3 - t**2)


def ridge(x: np.ndarray, y: np.ndarray, cells: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Monotone knots along the crest of the joint density: from its peak, step up or right (and down or left) to the higher
    neighbour.  The density is a binned count blurred along both axes."""
    gx, gy = np.linspace(x.min(), x.max(), cells + 1), np.linspace(y.min(), y.max(), cells + 1)
    g, _, _ = np.histogram2d(x, y, [gx, gy])
    return crest(g, gx, gy, bandwidth(x), bandwidth(y))


def crest(g: np.ndarray, gx: np.ndarray, gy: np.ndarray, width_x: float, width_y: float) -> tuple[np.ndarray, np.ndarray]:
    """The ridge of counts g in a square grid between the edges gx and gy."""
    cells = len(g)
    for axis, (v, width) in enumerate(((gx, width_x), (gy, width_y))):
        step = (v[-1] - v[0]) / cells
        n = int(np.clip(np.ceil(2 * width / max(step, 1e-12)), 1, cells // 4))
        kernel = np.cos(np.arange(-n, n + 1) / n * np.pi / 2)
        g = np.apply_along_axis(lambda c: np.convolve(c, kernel, "same"), axis, g)
    i, j = np.unravel_index(np.argmax(g), g.shape)
    path = [(i, j)]
    for step in (1, -1):
        a, b = i, j
        while 0 <= a + step < cells and 0 <= b + step < cells:
            a, b = max(((a + step, b), (a, b + step), (a + step, b + step)), key=lambda p: g[p])
            if g[a, b] <= 0:
                break
            path.append((a, b))
    path = np.array(sorted(set(path)))
    cx, cy = (gx[:-1] + gx[1:]) / 2, (gy[:-1] + gy[1:]) / 2
    ux = np.unique(path[:, 0])
    return cx[ux], pava(np.array([cy[path[path[:, 0] == u, 1]].mean() for u in ux]))


def along(kx: np.ndarray, ky: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Interpolation between knots, beyond them at their pace of one."""
    return lambda v: np.interp(v, kx, ky) + np.where(v < kx[0], v - kx[0], 0) + np.where(v > kx[-1], v - kx[-1], 0)


def align(x: np.ndarray, y: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Model of y by x: the ridge for more than 20 points, a line for 3 to 20, identity below."""
    if len(x) > 20 and x.min() < x.max() and y.min() < y.max():
        return along(*ridge(x, y))
    if len(x) > 2 and x.min() < x.max():
        m, b = np.polyfit(x, y, 1)
        return lambda v: m * v + b
    return lambda v: v


def mixture(delta: np.ndarray, rounds: int = 10) -> tuple[float, float, float, np.ndarray]:
    """Gaussian plus uniform by EM: (mean, deviation, share of the Gaussian, its posterior for each value)."""
    if not len(delta):
        return 0.0, 1.0, 1.0, delta
    span = max(float(delta.max() - delta.min()), 1e-9)
    mean, sd, share = float(np.median(delta)), max(float(np.subtract(*np.percentile(delta, [75, 25]))) / 1.349, span / 1000), 0.9
    post = np.ones(len(delta))
    for _ in range(rounds):
        g = share * np.exp(-0.5 * ((delta - mean) / sd) ** 2) / (sd * np.sqrt(2 * np.pi))
        post = g / (g + (1 - share) / span + 1e-300)
        total = post.sum()
        if total <= 0:
            break
        mean = float((post * delta).sum() / total)
        sd = max(float(np.sqrt((post * (delta - mean) ** 2).sum() / total)), span / 1000)
        share = float(np.clip(total / len(delta), 0.01, 0.99))
    return mean, sd, share, post


def rt_align(df: DataFrame, key: list[str], x: str, y: str, ident: str) -> DataFrame:
    """Warped x, deviation and probability of fit for each point, per file pair."""
    types = dict(df.dtypes)

    def kernel(ids, xs, ys):
        xs, ys = xs.astype(float), ys.astype(float)
        warped = align(xs, ys)(xs)
        _, _, _, post = mixture(ys - warped)
        return {ident: ids, "warped": warped, "delta": ys - warped, "probability": post}

    return per_group(df, key, [x, y, ident], [ident, x, y], f"`{ident}` {types[ident]}, warped double, delta double, probability double", kernel)


def running_median(x: np.ndarray, width: int) -> np.ndarray:
    """Medians of symmetric frames that shrink at the ends, made monotone outwards from the middle."""
    half, n = width // 2, len(x)
    m = np.array([np.median(x[i - min(half, i, n - 1 - i) : i + min(half, i, n - 1 - i) + 1]) for i in range(n)])
    c = n // 2
    return np.concatenate([np.minimum.accumulate(m[: c + 1][::-1])[::-1], np.maximum.accumulate(m[c:])[1:]]) if n else m


# -- error rates -------------------------------------------------------------------------------------------------------


def local_fdr(p: np.ndarray, pi0: float | None = None) -> np.ndarray:
    """pi0 times the null density over the density, on the logit scale; clipped to 1 and monotone in p."""
    if not len(p):
        return p
    q = np.clip(p, 1e-10, 1 - 1e-10)
    z = np.log(q / (1 - q))
    if pi0 is None:
        cuts = np.arange(1, 10) / 10
        pi0 = float(np.clip(np.median([(p > c).mean() / (1 - c) for c in cuts]), 0.05, 1))
    grid = np.linspace(z.min() - 1e-6, z.max() + 1e-6, 100)
    f = np.maximum(np.interp(z, grid, density(z, grid)), 1e-12)
    raw = np.minimum(pi0 * q * (1 - q) / f, 1)  # the null's logit has density p (1 - p)
    order = np.argsort(p, kind="stable")
    out = np.empty(len(p))
    out[order] = np.maximum.accumulate(raw[order])
    return out


def local_fdr_by(df: DataFrame, key: list[str], ident: str, p: str) -> DataFrame:
    types = dict(df.dtypes)
    return per_group(df, key, [p, ident], [ident, p], f"`{ident}` {types[ident]}, p double, lfdr double", lambda i, v: {ident: i, "p": v.astype(float), "lfdr": local_fdr(v.astype(float))})


def posterior_error(score: np.ndarray, decoy: np.ndarray, bins: int = 50) -> np.ndarray:
    """Posterior error of each row: decoy share of equal-count bins from the best score down, smoothed, made monotone,
    p / (1 - p) of it at most 1, and a monotone cubic between the bins' centres."""
    order = np.argsort(-score, kind="stable")
    d = decoy[order].astype(float)
    n = max(1, min(bins, len(d) // 5 or 1))
    parts = np.array_split(np.arange(len(d)), n)
    x = np.array([0.0] + [q.mean() for q in parts])
    y = np.array([0.5] + [d[q].mean() for q in parts])
    y[0] = min(y[0], y[1]) if len(y) > 1 else y[0]
    step = np.diff(x).mean() if len(x) > 1 else 1.0
    k = np.exp(-0.5 * ((x[:, None] - x[None, :]) / (2 * step)) ** 2)
    y = pava((k * y[None, :]).sum(1) / k.sum(1))
    pep = np.minimum(1, y / np.maximum(1 - y, 1e-9))
    out = np.empty(len(d))
    out[order] = np.clip(monotone_cubic(x, pep, np.arange(len(d), dtype=float)), 0, 1)
    return out


# -- discriminants -----------------------------------------------------------------------------------------------------


def discriminant(n: np.ndarray, sums: np.ndarray, products: np.ndarray, least_range: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """(coefficients, constant) from per-class counts, sums and products; class 1 is positive.  `least_range` masks features."""
    live = np.ones(sums.shape[1], bool) if least_range is None else least_range > 1e-4
    mean = sums / n[:, None]
    cov = sum(products[c] - n[c] * np.outer(mean[c], mean[c]) for c in (0, 1)) / n.sum()
    use = np.flatnonzero(live)
    c = np.zeros(sums.shape[1])
    c[use] = np.linalg.pinv(cov[np.ix_(use, use)]) @ (mean[1] - mean[0])[use]
    return c, float(-np.log(n[0] / n[1]) - 0.5 * c @ (mean[0] + mean[1]))


def class_moments(x: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [x[~positive], x[positive]]
    return np.array([len(p) for p in parts], float), np.stack([p.sum(0) for p in parts]), np.stack([p.T @ p for p in parts])


def semi_supervised(x: np.ndarray, decoy: np.ndarray, restarts: int = 10, rounds: int = 5, keep: int = 5, start: float = 0.15, cuts: tuple[float, ...] = (0.02, 0.01), seed: int = 1) -> tuple[np.ndarray, float]:
    """Discriminant trained on decoys against the targets that pass its own error rate: restarts on random halves, each
    starting from its best single feature, the best models averaged."""
    rng = np.random.default_rng(seed)
    models = []
    for _ in range(restarts):
        half = rng.random(len(x)) < 0.5
        best = max(range(x.shape[1]), key=lambda f: abs(x[half & ~decoy, f].mean() - x[half & decoy, f].mean()) / (x[half, f].std() + 1e-12))
        sign = np.sign(x[half & ~decoy, best].mean() - x[half & decoy, best].mean()) or 1.0
        c, b = np.eye(x.shape[1])[best] * sign, 0.0
        for k in range(rounds):
            s = x @ c + b
            null = s[half & decoy]
            cut = np.quantile(s[half & ~decoy], 1 - start) if k == 0 else _cut(s[half & ~decoy], null, cuts[min(k - 1, len(cuts) - 1)])
            good = half & ~decoy & (s >= cut)
            if good.sum() < 5 or (half & decoy).sum() < 5:
                break
            train = good | (half & decoy)
            c, b = discriminant(*class_moments(x[train], good[train]), np.ptp(x[train], axis=0))
        s = x @ c + b
        models.append((int((s[~half & ~decoy] >= _cut(s[~half & ~decoy], s[~half & decoy], cuts[-1])).sum()), c / (np.linalg.norm(c) + 1e-12), b / (np.linalg.norm(c) + 1e-12)))
    models.sort(key=lambda m: -m[0])
    return np.mean([m[1] for m in models[:keep]], axis=0), float(np.mean([m[2] for m in models[:keep]]))


def _cut(targets: np.ndarray, decoys: np.ndarray, rate: float) -> float:
    """Lowest score at which decoys over targets stay within the rate."""
    s = np.sort(targets)[::-1]
    d = np.searchsorted(np.sort(-decoys), -s, "right")
    ok = np.flatnonzero(d / np.arange(1, len(s) + 1) <= rate)
    return float(s[ok[-1]]) if len(ok) else np.inf


def lda_semi_supervised(df: DataFrame, features: list[str], decoy: str, ident: str, most_rows: int = 200_000, seed: int = 1) -> DataFrame:
    """Rows with `lda_score`.  The model is fitted on at most `most_rows` rows, drawn by hash; every row is scored in the JVM."""
    from peakfold.operators.statistics import lda_score

    n = df.count()
    u = F.pmod(F.xxhash64(ident, F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    pdf = df.where(u < most_rows / max(n, 1)).select(ident, decoy, *features).toPandas().sort_values(ident, kind="stable")  # bounded by most_rows
    x = pdf[features].to_numpy(float)
    mean, sd = x.mean(0), x.std(0) + 1e-12
    c, b = semi_supervised((x - mean) / sd, pdf[decoy].to_numpy(bool), seed=seed)
    return df.withColumn("lda_score", lda_score(features, (c / sd).tolist(), float(b - (c / sd) @ mean)))


# -- parsimony ---------------------------------------------------------------------------------------------------------


#: Pairs of an item and a group that a step of the parsimony holds at once; holders of an item in one row.
PAIRS, HOLDERS = 1 << 21, 500


class _Numbers:
    """Integers in a file without a name: appended in turn, read by position, so that memory holds only what is asked for."""

    def __init__(self, kind: type):
        self.kind, self.n, self.file = np.dtype(kind), 0, tempfile.TemporaryFile()

    def add(self, x: np.ndarray) -> None:
        self.file.write(np.ascontiguousarray(x, self.kind).data)
        self.n += len(x)

    def read(self, a: int, z: int) -> np.ndarray:
        return np.frombuffer(os.pread(self.file.fileno(), (z - a) * self.kind.itemsize, a * self.kind.itemsize), self.kind)


def _worth(errors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """1 - error as an exact integer of 2 ** 53 parts, in two limbs, so that sums are exact."""
    w = (1 - errors) * float(1 << 26)
    high = np.floor(w)
    low = ((w - high) * (1 << 27)).astype(np.int64)
    return (high.astype(np.int64) if not len(w) or w.max() < 1 << 31 else np.array([int(h) for h in high], object)), low


def _by_group(holders: _Numbers, ends: np.ndarray, place: np.ndarray, groups: int) -> tuple[np.ndarray, Iterator[tuple[int, int, np.ndarray]]]:
    """Turns groups of items into items of groups: where the groups begin, and (first group, group after the last, their items by rising place)."""
    n = len(ends)
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    cuts = [0]
    while cuts[-1] < n:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, begins[cuts[-1]] + PAIRS, "right"))))
    sizes = np.zeros(groups, np.int64)
    for a, z in zip(cuts, cuts[1:]):
        sizes += np.bincount(holders.read(int(begins[a]), int(ends[z - 1])), minlength=groups)
    first = np.concatenate([[0], np.cumsum(sizes)])
    bucket = first[:-1] // max(PAIRS, int(first[-1]) >> 8)

    def parts() -> Iterator[tuple[int, int, np.ndarray]]:
        held = [_Numbers(np.int64) for _ in range(int(bucket[-1]) + 1 if groups else 0)]
        for a, z in zip(cuts, cuts[1:]):
            g = holders.read(int(begins[a]), int(ends[z - 1])).astype(np.int64)
            key = g * n + np.repeat(place[a:z], ends[a:z] - begins[a:z])
            if len(held) == 1:
                held[0].add(key)
                continue
            of = bucket[g].astype(np.uint16)
            order = np.argsort(of, kind="stable")
            edge = np.searchsorted(of[order], np.arange(len(held) + 1))
            for k in np.flatnonzero(np.diff(edge)).tolist():
                held[k].add(key[order[edge[k] : edge[k + 1]]])
        for k, h in enumerate(held):
            if h.n:
                h.file.flush()
                key = np.sort(h.read(0, h.n))
                yield int(np.searchsorted(bucket, k)), int(np.searchsorted(bucket, k, "right")), (key % n).astype(np.int32)
            h.file.close()

    return first, parts()


def _covers(names: list[str], holders: _Numbers, ends: np.ndarray, errors: np.ndarray) -> Iterator[tuple[list[int], np.ndarray, float]]:
    """Greedy groups over any number of components.  holders: the groups (numbers into names) of each item in turn, up to `ends`.
    Gives groups of equal items by name, the items they claim and the least error of these.

    Groups only get worse as others claim, so they wait in a heap, and one that is no longer as good as it was goes back; an item
    is claimed once, so all updates together are as many as groups have items.  Memory holds a few numbers for each item and each
    group; the pairs stay in files.
    """
    holders.file.flush()
    order = np.argsort(-errors, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    error = errors[order]
    high, low = _worth(error)
    first, parts = _by_group(holders, ends, place, len(names))
    sums, rest = np.zeros(len(names), high.dtype), np.zeros(len(names), np.int64)
    tail = np.full(len(names), -1, np.int64)
    items = _Numbers(np.int32)
    same: dict[bytes, list[int]] = {}
    for a, z, ids in parts:
        items.add(ids)
        at = first[a : z + 1] - first[a]
        held = np.flatnonzero(np.diff(at))
        sums[a + held] = np.add.reduceat(high[ids], at[held])
        rest[a + held] = np.add.reduceat(low[ids], at[held])
        tail[a + held] = ids[at[held + 1] - 1]
        for g in held.tolist():
            same.setdefault(blake2b(ids[at[g] : at[g + 1]].data, digest_size=24).digest(), []).append(a + g)
    items.file.flush()
    rank = np.empty(len(names), np.int64)
    rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
    equal = {}
    for members in same.values():
        members.sort(key=rank.__getitem__)
        equal[members[0]] = members
    del same
    end = first[1:].copy()
    taken = np.zeros(len(order), bool)

    def now(g: int) -> tuple | None:
        """How good the group is, by what it still claims."""
        total = (int(sums[g]) << 27) + int(rest[g])
        if total <= 0:
            return None
        while taken[tail[g]]:
            a = max(int(first[g]), int(end[g]) - 64)
            ids = items.read(a, int(end[g]))
            free = np.flatnonzero(~taken[ids])
            end[g] = a + (free[-1] + 1 if len(free) else 0)
            if len(free):
                tail[g] = ids[free[-1]]
        return float(error[tail[g]]), -total, -int(rank[g]), g

    heap = [k for k in map(now, equal) if k]
    heapq.heapify(heap)
    while heap:
        g = heap[0][3]
        k = now(g)
        if k != heap[0]:
            heapq.heapreplace(heap, k) if k else heapq.heappop(heap)
            continue
        heapq.heappop(heap)
        own = items.read(int(first[g]), int(end[g]))
        own = own[~taken[own]]
        taken[own] = True
        claimed = order[own]
        stops = ends[claimed]
        starts = np.where(claimed > 0, ends[claimed - 1], 0)
        step = np.cumsum(stops - starts) // PAIRS
        for a, z in itertools.pairwise([0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(own)]):
            met = np.concatenate([holders.read(x, y) for x, y in zip(starts[a:z].tolist(), stops[a:z].tolist())])
            each = np.repeat(own[a:z], stops[a:z] - starts[a:z])
            np.subtract.at(sums, met, high[each])
            np.subtract.at(rest, met, low[each])
        yield equal[g], claimed, k[0]
    items.file.close()


def parsimony(members: dict[str, set], error: dict) -> list[tuple[list[str], set, float]]:
    """Greedy groups: the group of least error, then of largest sum of 1 - error over what it still claims, then the later
    name, takes all its items; equal sets are one group; groups that claim nothing are dropped."""
    names, held = list(members), {}
    for g, name in enumerate(names):
        for i in members[name]:
            held.setdefault(i, []).append(g)
    items, holders = list(held), _Numbers(np.int32)
    for i in items:
        holders.add(np.array(held[i]))
    ends = np.cumsum([len(held[i]) for i in items], dtype=np.int64)
    errors = np.array([error[i] for i in items], float)
    return [([names[g] for g in same], {items[i] for i in claimed.tolist()}, e) for same, claimed, e in _covers(names, holders, ends, errors)]


def _changes(c: pa.Array) -> np.ndarray:
    """Whether a row differs from the one before; the first does."""
    a, z = c[1:], c[:-1]
    new = np.asarray(pc.fill_null(pc.not_equal(a, z), False)) | (np.asarray(a.is_null()) != np.asarray(z.is_null()))
    return np.concatenate([[True], new])[: len(c)]


def _codes(c: pa.Array) -> np.ndarray:
    """A number for each different value, null too."""
    return np.asarray(c.dictionary_encode(null_encoding="encode").indices)


def parsimony_groups(bridge: DataFrame, item: str, group: str, error: str, component: str) -> DataFrame:
    """bridge (component, item, group, error): groups per connected component: members, items claimed, least error.

    An item has its least error, 1 at most and if none is known; each null item is one of its own.  Tasks put the groups of each
    item in a row; the rows of a component meet in one task, which keeps the pairs in files (`_covers`).
    """
    types = dict(bridge.dtypes)
    rows_of = StructType.fromDDL(f"c {types[component]}, i {types[item]}, piece int, e double, holders array<{types[group]}>")
    found_of = StructType.fromDDL(f"`{component}` {types[component]}, members string, n_items long, least_error double")
    rows, found = to_arrow_schema(rows_of), to_arrow_schema(found_of)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists(t: pa.Table) -> pa.RecordBatch:
            i, g = t["i"].combine_chunks(), t["g"].combine_chunks()
            at, of_c, of_g = np.cumsum(_changes(i) | np.asarray(i.is_null())), _codes(t["c"].combine_chunks()), _codes(g)
            order = np.lexsort((of_g, of_c, at))
            at, of_c, of_g = at[order], of_c[order], of_g[order]
            new = np.concatenate([[True], (at[1:] != at[:-1]) | (of_c[1:] != of_c[:-1])])
            keep = new | np.concatenate([[True], of_g[1:] != of_g[:-1]])
            at = np.flatnonzero(new)
            e = np.fmin(np.fmin.reduceat(t["e"].to_numpy()[order], at), 1.0)
            size = np.add.reduceat(keep.astype(np.int64), at)
            pieces = -(-size // HOLDERS)
            of = np.repeat(np.arange(len(at)), pieces)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            edge = np.append((np.cumsum(size) - size)[of] + piece * HOLDERS, size.sum())
            holders = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), g.take(pa.array(order[keep])), type=rows.field("holders").type)
            where = pa.array(order[at[of]])
            return pa.RecordBatch.from_arrays([t["c"].combine_chunks().take(where), i.take(where), pa.array(piece, pa.int32()), pa.array(e[of]), holders], schema=rows)

        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            i = b["i"]
            new = _changes(i)
            new[0] = not held or _changes(pa.concat_arrays([held[-1]["i"][-1:], i[:1]]))[1]
            new |= np.asarray(i.is_null())
            last = int(np.flatnonzero(new)[-1]) if new.any() else -1
            if held and last >= 0 or last > 0:
                yield lists(pa.Table.from_batches([*held, b.slice(0, last)]))
                held = [b.slice(last)]
            else:
                held.append(b)
        if held:
            yield lists(pa.Table.from_batches(held))

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, owner, known, table = [], [], [], {}
        sizes, begun, errors = [], [], []
        holders = _Numbers(np.int32)
        for b in batches:
            if not b.num_rows:
                continue
            c, held = b["c"], b["holders"]
            new = _changes(c)
            new[0] = not known or known[-1] != c.slice(0, 1)
            sizes.append(np.asarray(held.value_lengths()).astype(np.int64))
            begun.append(np.asarray(b["piece"]) == 0)
            errors.append(np.asarray(b["e"]))
            for a, z in itertools.pairwise(sorted({0, *np.flatnonzero(new).tolist(), b.num_rows})):
                if new[a]:
                    table = {}
                    known.append(c.slice(a, 1))
                d = held.slice(a, z - a).flatten().dictionary_encode(null_encoding="encode")
                number = []
                for name in map(str, d.dictionary.to_pylist()):
                    if name not in table:
                        table[name] = len(names)
                        names.append(name)
                        owner.append(len(known) - 1)
                    number.append(table[name])
                holders.add(np.array(number, np.int32)[np.asarray(d.indices)])
        if not names:
            return
        ends, at = np.cumsum(np.concatenate(sizes)), np.flatnonzero(np.concatenate(begun))
        of = pa.concat_arrays(known)
        groups = _covers(names, holders, ends[np.append(at[1:], len(ends)) - 1], np.concatenate(errors)[at])
        del sizes, begun, errors, known
        while part := [(owner[g[0]], ";".join(names[x] for x in g), len(claimed), e) for g, claimed, e in itertools.islice(groups, 10_000)]:
            c, members, n, e = zip(*part)
            yield pa.RecordBatch.from_arrays([of.take(pa.array(c)), pa.array(members, pa.string()), pa.array(n, pa.int64()), pa.array(e, pa.float64())], schema=found)

    c, i, g = F.col(component).alias("c"), F.col(item).alias("i"), F.col(group).alias("g")
    own = F.when(F.col("i").isNull(), F.col("g"))
    pairs = bridge.select(c, i, g, F.col(error).cast("double").alias("e")).repartition("i", own).sortWithinPartitions("i")
    return pairs.mapInArrow(packed, rows_of).repartition("c").sortWithinPartitions("c", "i", "piece").drop("i").mapInArrow(solved, found_of)


# -- spectra -----------------------------------------------------------------------------------------------------------


def xcorr_vector(mz: np.ndarray, intensity: np.ndarray, width: float = 1.0005079, offset: float = 0.4, groups: int = 10, around: int = 75) -> np.ndarray:
    """Binned square-root spectrum, each tenth of the range scaled to 50, less the mean of 75 bins to either side."""
    if not len(mz):
        return np.zeros(1)
    bins = (mz / width + offset).astype(int)
    v = np.zeros(int(bins.max()) + 1 + around)
    np.maximum.at(v, bins, np.sqrt(np.maximum(intensity, 0)))
    size = -(-len(v) // groups)
    for a in range(0, len(v), size):
        top = v[a : a + size].max()
        if top > 0:
            v[a : a + size] *= 50 / top
    total = np.concatenate([[0], np.cumsum(v)])
    i = np.arange(len(v))
    a, z = np.maximum(i - around, 0), np.minimum(i + around + 1, len(v))
    return v - (total[z] - total[a] - v) / (2 * around)


def xcorr(theoretical: np.ndarray, mz: np.ndarray, intensity: np.ndarray, width: float = 1.0005079, offset: float = 0.4, weights: np.ndarray | None = None) -> float:
    """Cross-correlation of a spectrum with theoretical ions; with weights each bin counts by the square root of its largest
    weight, the largest of all as 1."""
    v = xcorr_vector(mz, intensity, width, offset)
    bins = (theoretical / width + offset).astype(int)
    if weights is None:
        bins = np.unique(bins)
        return float(v[bins[bins < len(v)]].sum() * 50 / 1e4)
    top = float(weights.max(initial=0))
    if top <= 0:
        return 0.0
    bins, back = np.unique(bins, return_inverse=True)
    high = np.zeros(len(bins))
    np.maximum.at(high, back, np.sqrt(np.maximum(weights, 0) / top))
    live = bins < len(v)
    return float((v[bins[live]] * high[live]).sum() * 50 / 1e4)


def isotope_distribution(atoms: np.ndarray, peaks: int = 5) -> np.ndarray:
    """First isotope peaks of H, C, O, N, S atoms by repeated convolution, summing to 1."""
    # Natural abundances of the isotopes +0, +1, +2, ... of H, C, O, N, S.
    natural = [(0.999885, 0.000115), (0.9893, 0.0107), (0.99757, 0.00038, 0.00205), (0.99636, 0.00364), (0.9499, 0.0075, 0.0425)]
    out = np.zeros(peaks)
    out[0] = 1
    for n, p in zip(atoms, natural):
        base, k = np.zeros(peaks), int(n)
        base[: min(peaks, len(p))] = p[:peaks]
        while k:
            if k & 1:
                out = np.convolve(out, base)[:peaks]
            base = np.convolve(base, base)[:peaks]
            k >>= 1
    return out / out.sum()


# -- quantification ----------------------------------------------------------------------------------------------------


def select_transitions(matrix: np.ndarray, least: int = 3, most_error: float = 0.05, most_cv: float = 0.5) -> np.ndarray:
    """Columns (transitions) whose share of the total varies least over rows (samples): samples far from the median profile
    don't vote; columns join by variation while it is within bounds or there are fewer than `least`."""
    total = matrix.sum(1, keepdims=True)
    share = np.divide(matrix, total, out=np.zeros_like(matrix, dtype=float), where=total > 0)
    live = share[total.ravel() > 0]
    if not len(live):
        return np.arange(min(least, matrix.shape[1]))
    median = np.median(live, axis=0)
    good = live[((live - median) ** 2).sum(1) <= most_error]
    good = good if len(good) else live
    cv = good.std(0) / np.maximum(good.mean(0), 1e-12)
    order = np.argsort(cv, kind="stable")
    return np.sort(order[: max(least, int((cv[order] <= most_cv).sum()))])


def dilution_fit(amount: np.ndarray, signal: np.ndarray, k: float = 2.0) -> tuple[float, float, float, float]:
    """(noise, factor, LOD, LOQ): a plateau of noise and, above it, signal = factor * amount, the crossover of least squared
    error in log space; LOD where the line leaves the largest noise, LOQ k deviations above."""
    order = np.argsort(amount, kind="stable")
    x, y = amount[order].astype(float), signal[order].astype(float)
    best = (np.inf, 0.0, 1.0, 0)
    for cut in range(0, len(x)):
        low, hx, hy = y[:cut], x[cut:], y[cut:]
        ok = (hx > 0) & (hy > 0)
        if ok.sum() < 2:
            continue
        noise = float(low.mean()) if len(low) else 0.0
        factor = float(10 ** np.mean(np.log10(hy[ok]) - np.log10(hx[ok])))
        floor = max(noise, 1e-9)
        err = ((np.log10(np.maximum(low, 1e-9)) - np.log10(floor)) ** 2).sum() + ((np.log10(hy[ok]) - np.log10(factor * hx[ok])) ** 2).sum()
        if err < best[0]:
            best = (err, noise, factor, cut)
    _, noise, factor, cut = best
    low = y[:cut]
    top = float(low.max()) if len(low) else noise
    lod = top / factor
    loq = (top + k * (float(low.std()) if len(low) else 0.0)) / factor
    zeros, signals = x[(y <= 0)], x[(y > 0)]
    bound = lambda v: float(np.clip(v, zeros.max() if len(zeros) else 0.0, max(v, signals.min()) if len(signals) else v))
    return noise, factor, bound(lod), max(bound(loq), bound(lod))


def dilution(df: DataFrame, key: list[str], amount: str, signal: str) -> DataFrame:
    def kernel(x, y):
        n, f, lod, loq = dilution_fit(x.astype(float), y.astype(float))
        return {"noise": [n], "factor": [f], "lod": [lod], "loq": [loq]}

    return per_group(df, key, [amount, signal], [amount, signal], "noise double, factor double, lod double, loq double", kernel)


def sigmoid_fit(x: np.ndarray, y: np.ndarray, rate: float = 0.1, rounds: int = 2000) -> tuple[float, float]:
    """(slope, midpoint) of a logistic curve from 0 to 1 by gradient descent on scaled x."""
    m, s = float(x.mean()), float(x.std()) + 1e-12
    z, a, b = (x - m) / s, 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = (p - y) * p * (1 - p)
        a, b = a - rate * float((g * z).mean()) * 4, b - rate * float(g.mean()) * 4
    return a / s, m - b / a * s if a else m


def schedule(starts: np.ndarray, stops: np.ndarray, values: np.ndarray, cap: int, step: float) -> np.ndarray:
    """Greedy choice of targets by value so that no time bin holds more than `cap` of them."""
    low = float(starts.min()) if len(starts) else 0.0
    bins = np.zeros(int((float(stops.max()) - low) / step) + 2 if len(stops) else 1, int)
    taken = np.zeros(len(starts), bool)
    for i in np.argsort(-values, kind="stable"):
        a, z = int((starts[i] - low) / step), int((stops[i] - low) / step) + 1
        if (bins[a:z] < cap).all():
            bins[a:z] += 1
            taken[i] = True
    return taken


def hydrophobicity(sequence: str, coefficients: dict[str, float], ends: float = 0.4) -> float:
    """Additive retention: residue coefficients, those of the first three residues weighted less."""
    weights = [ends + (1 - ends) * i / 3 if i < 3 else 1.0 for i in range(len(sequence))]
    return sum(coefficients.get(a, 0.0) * w for a, w in zip(sequence, weights))
