"""Times and peaks carried from run to run: alignment through a tree of runs, one through a seed that keeps every sequence,
boundaries taken over from a reference, times across a library's sources."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakfold.operators import kernels, quantitation
from peakfold.operators import statistics as st
from peakfold.operators.components import checkpointed
from peakfold.operators.joins import small_side
from peakfold.operators.kernels import per_group


def _times(peptides: DataFrame) -> DataFrame:
    return peptides.where("run IS NOT NULL AND modseq IS NOT NULL AND rt IS NOT NULL").groupBy("run", "modseq").agg(F.min(F.col("rt").cast("double")).alias("rt"))


# -- a tree of runs ------------------------------------------------------------------------------------------------------


def shared_counts(peptides: DataFrame) -> DataFrame:
    """a, b, n: sequences that two runs share, for every pair of runs that share any (a < b).

    A sequence of very many runs makes as many pairs as these have, which is what the tree is chosen from: a row for each pair
    of runs after the partial sums.
    """
    x = _times(peptides).select("run", "modseq")
    y = x.select(F.col("run").alias("b"), F.col("modseq").alias("m"))
    return x.join(y, (F.col("modseq") == F.col("m")) & (F.col("run") < F.col("b"))).groupBy(F.col("run").alias("a"), "b").agg(F.count(F.lit(1)).alias("n"))


def run_tree(peptides: DataFrame) -> list[tuple[str, str | None, int]]:
    """(run, parent, depth) of a spanning tree along the pairs that share most: the root is the run with most sequences (of equal
    ones the smaller name); runs that share nothing with any other are roots of their own.  One row a pair of runs comes to the driver."""
    sizes = {r["run"]: r["n"] for r in _times(peptides).groupBy("run").agg(F.count(F.lit(1)).alias("n")).collect()}
    near: dict[str, list[tuple[int, str]]] = {r: [] for r in sizes}
    parts = {r: r for r in sizes}

    def root(r: str) -> str:
        while parts[r] != r:
            parts[r] = parts[parts[r]]
            r = parts[r]
        return r

    for a, b, n in sorted(((r["a"], r["b"], r["n"]) for r in shared_counts(peptides).collect()), key=lambda p: (-p[2], p[0], p[1])):
        if root(a) != root(b):
            parts[root(a)] = root(b)
            near[a].append((n, b))
            near[b].append((n, a))
    out, seen = [], set()
    for start in sorted(sizes, key=lambda r: (-sizes[r], r)):
        queue = [] if start in seen else [(start, None, 0)]
        seen.update(q[0] for q in queue)
        while queue:
            run, parent, depth = queue.pop(0)
            out.append((run, parent, depth))
            for _, b in sorted(near[run], key=lambda p: (-p[0], p[1])):
                if b not in seen:
                    seen.add(b)
                    queue.append((b, run, depth + 1))
    return out


#: Cells of the density on each axis, as `kernels.ridge` has them, and grids of counts that a task holds.
CELLS, HELD = 300, 64


def alignments(pairs: DataFrame, key: list[str], x: str, y: str) -> dict[tuple, tuple[str, list[float], list[float]]]:
    """By key (kind, xs, ys) of the model that `kernels.align` makes of the pairs (key, x, y): the knots of a ridge, or slope and
    offset of a line; keys that stay as they are have none.

    Tasks count their pairs in the cells of a grid, and only the counts of a key meet, so its pairs may be any number.  Pairs are
    read up to three times.  A model has at most CELLS knots, which come to the driver.
    """
    p = pairs.select(*key, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    numbers = [f(c).alias(f"{n}{c}") for c in ("__x", "__y") for n, f in (("low", F.min), ("high", F.max), ("sd", F.stddev_pop))]
    known = {tuple(r[k] for k in key): r for r in p.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *numbers).collect()}
    out, grids, short = {}, {}, False
    for k, r in known.items():
        if r["n"] > 20 and r["low__x"] < r["high__x"] and r["low__y"] < r["high__y"]:
            grids[k] = (len(grids), r["low__x"], r["high__x"], r["low__y"], r["high__y"])
        elif r["n"] > 20 and r["low__x"] < r["high__x"]:
            out[k] = ("line", [0.0], [r["low__y"]])
        elif r["n"] > 2 and r["low__x"] < r["high__x"]:
            short = True
    edges = lambda a, z: np.linspace(a, z, CELLS + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def told():
            for k, g in held.items():
                cell = np.flatnonzero(g)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), k)), pa.array(cell), pa.array(g.ravel()[cell].astype(np.int64))], names=["k", "cell", "c"])

        for b in batches:
            u, v = (b.column(c).to_numpy(zero_copy_only=False) for c in ("__x", "__y"))
            for name, at in rows_by(b, key):
                if name not in grids:
                    continue
                k, *ends = grids[name]
                if k not in held and len(held) == HELD:
                    yield from told()
                    held.clear()
                g, _, _ = np.histogram2d(u[at], v[at], [edges(*ends[:2]), edges(*ends[2:])])
                held[k] = held[k] + g if k in held else g
        yield from told()

    if grids:
        names = list(grids)
        widths = [tuple(kernels.bandwidth_of(known[n][f"sd{c}"], known[n]["n"]) for c in ("__x", "__y")) for n in names]

        def kernel(k, cell, c):
            g = np.zeros(CELLS * CELLS)
            g[cell] = c
            _, *ends = grids[names[int(k[0])]]
            kx, ky = kernels.crest(g.reshape(CELLS, CELLS), edges(*ends[:2]), edges(*ends[2:]), *widths[int(k[0])])
            return {"x": kx, "y": ky}

        counts = p.mapInArrow(count, "k long, cell long, c long").groupBy("k", "cell").agg(F.sum("c").alias("c")).withColumn("of", F.col("k"))
        for r in per_group(counts, ["k"], ["cell"], ["of", "cell", "c"], "x double, y double", kernel).orderBy("k", "x").collect():
            _, xs, ys = out.setdefault(names[r["k"]], ("ridge", [], []))
            xs.append(r["x"])
            ys.append(r["y"])
    if short:
        few = p.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n BETWEEN 3 AND 20").drop("n")
        same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in key])
        some = p.join(few.withColumnsRenamed({k: f"__of_{k}" for k in key}), same, "left_semi")

        def fit(xs, ys):
            xs, ys = xs.astype(float), ys.astype(float)
            return dict(zip(("slope", "offset"), ([float(v)] for v in np.polyfit(xs, ys, 1)))) if xs.min() < xs.max() else {"slope": [], "offset": []}

        for r in per_group(some, key, ["__x", "__y"], ["__x", "__y"], "slope double, offset double", fit).collect():
            out.setdefault(tuple(r[k] for k in key), ("line", [r["slope"]], [r["offset"]]))
    return out


def rows_by(b: pa.RecordBatch, key: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """(key, its rows) of a batch."""
    code = np.zeros(b.num_rows, np.int64)
    for k in key:
        d = b.column(k).dictionary_encode(null_encoding="encode")
        code = code * max(len(d.dictionary), 1) + np.asarray(d.indices)
    order = np.argsort(code, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
        if len(at):
            yield tuple(b.column(k)[int(at[0])].as_py() for k in key), at


def warped_by(pairs: DataFrame, queries: DataFrame, key: list[str], x: str, y: str) -> DataFrame:
    """Queries (key, x, ...) with `warped`: y of the model that `kernels.align` makes of the pairs (key, x, y) of their key; keys
    without pairs stay as they are.  Queries are not shuffled."""
    names = [c for c in queries.columns if c not in (*key, x)]
    types = dict(queries.dtypes)
    models = alignments(pairs, key, x, y)

    def warp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(x).to_numpy(zero_copy_only=False)
            w = v.copy()
            for name, at in rows_by(b, key):
                kind, xs, ys = models.get(name, ("", [], []))
                if kind == "ridge":
                    w[at] = kernels.along(np.array(xs), np.array(ys))(v[at])
                elif kind == "line":
                    w[at] = xs[0] * v[at] + ys[0]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in key], *[pa.array(f, from_pandas=True) for f in (v, w)], *[b.column(c) for c in names]], names=[*key, x, "warped", *names])

    schema = ", ".join([*[f"`{k}` {types[k]}" for k in key], f"`{x}` double, warped double", *[f"`{c}` {types[c]}" for c in names]])
    return queries.select(*key, F.col(x).cast("double").alias(x), *names).mapInArrow(warp, schema)


def tree_alignment(peptides: DataFrame) -> DataFrame:
    """Times of peptides (run, modseq, rt) in their root's time: run, modseq, rt, aligned, root.

    Every run is aligned to its parent in the tree of runs, by the sequences that both have, and times go from parent to
    parent: runs that share little with the root come to it through runs that are like them.  Depths go one after the other,
    all runs of a depth at once.
    """
    spark = peptides.sparkSession
    times = _times(peptides)
    tree = run_tree(peptides)
    if not tree:
        return times.withColumns({"aligned": F.col("rt"), "root": F.col("run")})
    top = {}
    for run, parent, _ in tree:
        top[run] = run if parent is None else top[parent]
    known = small_side(spark.createDataFrame([(r, p, d, top[r]) for r, p, d in tree], "run string, parent string, depth int, root string"))
    named = times.withColumn("run", F.col("run").cast("string")).join(known, "run")
    done = checkpointed(named.where("depth = 0").select("run", "modseq", "rt", F.col("rt").alias("aligned"), "root"))
    for depth in range(1, max(d for *_, d in tree) + 1):
        own = named.where(F.col("depth") == depth)
        above = done.select(F.col("run").alias("parent"), "modseq", F.col("aligned").alias("__to"))
        pairs = checkpointed(own.join(above, ["parent", "modseq"]).select("run", "rt", "__to"))
        found = warped_by(pairs, own.select("run", "rt", "modseq", "root"), ["run"], "rt", "__to")
        done = checkpointed(done.unionByName(found.select("run", "modseq", "rt", F.col("warped").alias("aligned"), "root")))
    return done


# -- a seed that keeps every sequence --------------------------------------------------------------------------------------


def all_peak_locations(peptides: DataFrame) -> DataFrame:
    """Where each sequence of any run lies in every run: run, modseq, rt, observed.

    The run with most sequences is the seed and others are aligned to it.  A sequence that the seed lacks has the seed's time
    from the first run (by name) that has it; times that a run didn't observe are the seed's, warped into it.
    """
    best = checkpointed(_times(peptides))
    seed_run = small_side(st.seed_run(best, "run").select(F.col("run").alias("__seed")))  # one row
    seed = best.join(seed_run, F.col("run") == F.col("__seed")).select("modseq", F.col("rt").alias("seed_rt"))
    others = best.join(seed_run, F.col("run") == F.col("__seed"), "left_anti")
    pairs = checkpointed(others.join(seed, "modseq").select("run", "rt", "seed_rt"))
    lacking = others.join(seed, "modseq", "left_anti")
    first = lacking.groupBy("modseq").agg(F.min(F.struct("run", "rt")).alias("r")).select("modseq", "r.run", "r.rt")
    taken = warped_by(pairs, first, ["run"], "rt", "seed_rt").select("modseq", F.col("warped").alias("seed_rt"))
    every = checkpointed(seed.unionByName(taken))
    runs = small_side(best.select("run").distinct().withColumn("__k", F.lit(0)))
    wanted = every.withColumn("__k", F.lit(0)).join(runs, "__k").drop("__k").join(best.select("run", "modseq"), ["run", "modseq"], "left_anti")
    inferred = warped_by(pairs, wanted, ["run"], "seed_rt", "rt").select("run", "modseq", F.col("warped").alias("rt"), F.lit(False).alias("observed"))
    return best.withColumn("observed", F.lit(True)).unionByName(inferred)


# -- boundaries from a reference ---------------------------------------------------------------------------------------------


def transferred_peaks(bounds: DataFrame, pairs: DataFrame, traces: DataFrame, width: float = 25.0, least: float = 0.75, points: int = 20) -> DataFrame:
    """Peaks of runs integrated between boundaries taken over from a reference.

    bounds: modseq, start, apex, stop in the reference's time, shape (array<double>: the reference's trace at `points` even
    places from start to stop); pairs: run, reference_rt, rt of the sequences that align them; traces: run, modseq, rt,
    intensity.  Boundaries are warped into each run.  If the run's trace between them has a correlation of `least` with the
    reference's shape they stand; else the peak around the warped apex is taken instead, if it does better.

    Returns run, modseq, start, stop, correlation, transferred (whether the boundaries stood), area, background, net.
    """
    ends = F.explode(F.array(*[F.struct(F.lit(k).alias("which"), F.col(k).alias("reference_rt")) for k in ("start", "apex", "stop")]))
    runs = small_side(traces.select("run").distinct().withColumn("__k", F.lit(0)))
    asked = bounds.select("modseq", ends.alias("e")).select("modseq", "e.which", "e.reference_rt", F.lit(0).alias("__k")).join(runs, "__k").drop("__k")
    moved = warped_by(pairs, asked, ["run"], "reference_rt", "rt").groupBy("run", "modseq").agg(*[F.max(F.when(F.col("which") == k, F.col("warped"))).alias(f"__{k}") for k in ("start", "apex", "stop")])
    x = traces.join(moved, ["run", "modseq"]).join(bounds.select("modseq", F.array_join(F.transform("shape", lambda v: v.cast("string")), ",").alias("__shape")), "modseq")

    def kernel(rt, y, a, top, z, shape):
        rt, y = rt.astype(float), np.nan_to_num(y.astype(float))
        last = np.append(np.diff(rt) > 0, True)
        rt, y = rt[last], y[last]
        want = np.array([float(v) for v in shape[0].split(",")]) if shape[0] else np.zeros(points)
        m = quantitation.natural_spline(rt, y)

        def like(start: float, stop: float) -> float:
            at = start + (stop - start) * np.arange(len(want)) / max(len(want), 1)
            return float(quantitation.correlations(quantitation.spline_at(rt, y, m, at)[None, :], want)[0]) if len(want) > 1 else 0.0

        start, stop = float(a[0]), float(z[0])
        r, stood = like(start, stop), True
        if r < least:
            i = min(int(np.searchsorted(rt, float(top[0]))), len(rt) - 1)
            p, q, _ = quantitation.peak_range(rt, np.where(np.abs(rt - rt[i]) <= 2 * width, y, 0.0), width)
            other = like(rt[p], rt[q])
            if other > r:
                start, stop, r, stood = float(rt[p]), float(rt[q]), other, False
        inside = (rt >= start) & (rt <= stop)
        area, under = (float(v[0]) for v in quantitation.areas(rt[inside], y[inside][None, :])) if inside.sum() > 1 else (0.0, 0.0)
        return {"start": [start], "stop": [stop], "correlation": [r], "transferred": [stood], "area": [area], "background": [under], "net": [area - under]}

    schema = "start double, stop double, correlation double, transferred boolean, area double, background double, net double"
    return per_group(x.where("rt IS NOT NULL"), ["run", "modseq"], ["rt"], ["rt", "intensity", "__start", "__apex", "__stop", "__shape"], schema, kernel)


def reference_shapes(traces: DataFrame, width: float = 25.0, points: int = 20) -> DataFrame:
    """Boundaries and shapes of a reference run's traces (modseq, rt, intensity), as `transferred_peaks` takes them."""
    peaks = quantitation.apex_times(traces, ["modseq"], "rt", "intensity", width)
    lined = quantitation.resampled(traces.join(peaks.select("modseq", "start", "stop"), "modseq"), ["modseq"], "rt", "intensity", points, "start", "stop")
    shape = lined.groupBy("modseq").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda p: p["value"]).alias("shape"))  # `points` values
    return peaks.where("apex IS NOT NULL").select("modseq", "start", "apex", "stop").join(shape, "modseq")


# -- times across a library's sources ------------------------------------------------------------------------------------------


def source_times(times: DataFrame, key: list[str]) -> DataFrame:
    """One time for each spectrum of a library whose sources ran at different paces: times (key, id, rt, source, best).

    A source's time of a spectrum is the median of its times there.  The largest source (of equal ones the smaller number) sets
    the scale; the others follow by size, each aligned to all times known so far, and add what they alone have.  A
    spectrum's time is that of its best source, in the scale of the first; spectra without a best source have none.

    Returns key, id, rt.  A library is one file, and one group here.
    """
    m = times.where("rt IS NOT NULL AND id IS NOT NULL").groupBy(*key, "source", "id").agg(F.percentile(F.col("rt").cast("double"), F.lit(0.5)).alias("rt"), F.max(F.coalesce(F.col("best").cast("int"), F.lit(0))).alias("best"))
    kind = dict(times.dtypes)["id"]

    def kernel(source, ids, rt, best):
        names, sizes = np.unique(source, return_counts=True)
        order = sorted(range(len(names)), key=lambda k: (-sizes[k], names[k]))
        known: dict = {}
        out: dict = {}
        for place, k in enumerate(order):
            own = np.flatnonzero(source == names[k])
            both = [i for i in own.tolist() if ids[i] in known]
            model = (lambda v: v) if not place or not both else kernels.align(rt[both].astype(float), np.array([known[ids[i]] for i in both]))
            fitted = np.asarray(model(rt[own].astype(float)), float)
            for i, v in zip(own.tolist(), fitted.tolist()):
                known.setdefault(ids[i], v)
                if best[i]:
                    out[ids[i]] = v
        return {"id": np.array(sorted(out)), "rt": np.array([out[i] for i in sorted(out)], float)}

    return per_group(m, key, ["source", "id"], ["source", "id", "rt", "best"], f"id {kind}, rt double", kernel)


def blib_times(spark, path: str) -> DataFrame:
    """Aligned times of BLIB files: source (the file), id, rt in seconds."""
    from peakfold.sources.binary import sqlite

    x = sqlite(spark, path, "SELECT RefSpectraID, retentionTime * 60, spectrumSourceID, bestSpectrum FROM RetentionTimes", "id long, rt double, origin long, best int")
    return source_times(x.withColumnsRenamed({"source": "library", "origin": "source"}), ["library"]).withColumnRenamed("library", "source")
