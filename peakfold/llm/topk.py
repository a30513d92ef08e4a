"""Operator 9: exact top-k by inner product over a pivot-distance index.

Vectors are integers, floor(256 x).  Every vector is keyed by its nearest pivot and its distance to it; a cell's vectors
within one step of distance are an annulus, of which a table of bounded size keeps the least and greatest distance and
the greatest norm.  For a query q and a vector x, 2 <q, x> = |q|^2 + |x|^2 - |q - x|^2, and the triangle inequality
bounds |q - x| from below by how far q is outside the annulus.  Annuli are expanded in the order of that bound, nearest
part first; the k-th best score found so far, at first that within the sample the pivots come from, stops the expansion:
an annulus whose bound is below it is not joined.  What is left is searched in tiles of at most about TILE vectors of an
annulus and QUERIES queries of neighbouring cells, and a tile's vectors are sent only to those blocks of queries whose bounds ask for
the annulus.

Cases: vectors that are null, or hold null or non-finite components, take no part, nor do rows without vec_id or with a
component of 256 x beyond HUGE, which no array<float> holds; large components are exact; scores beyond 64 bits are the largest (or
least) 64-bit number, and what ties there goes to the smaller vec_id; shorter vectors, empty ones too, count as padded with zeros; every row
is a candidate, equal rows too; every row that asks is a query with results of its own, so a query row that is there twice
has them twice; a query never meets rows of its own vec_id; ties go to the smaller vec_id; fewer candidates than k give
fewer rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakfold.llm.common import Scratch, maybe_broadcast

TILE, QUERIES, RINGS, NEAR = 1 << 15, 1 << 14, 32, 1 << 13
LEAST = -(2**63)
#: Squares of greater components aren't finite.
HUGE = 1e150


def pack(q: np.ndarray) -> bytes:
    """Integers as 32 bits each where they fit, else as the doubles they are; the last byte tells which."""
    if (np.abs(q) < 2**31).all():
        return q.astype(np.int32).tobytes() + b"i"
    return q.tobytes() + b"d"


def unpack(blobs, dim: int) -> np.ndarray:
    out = np.zeros((len(blobs), dim), np.float64)
    for i, b in enumerate(blobs):
        v = np.frombuffer(b[:-1], np.int32 if b[-1:] == b"i" else np.float64)
        out[i, : len(v)] = v
    return out


def quantised(vectors: DataFrame, column: str, ident: str) -> DataFrame:
    """vec_id, v (packed integers), dim of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, blobs, dims = [], [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1)):
                if i is None or not v.is_valid:
                    continue
                x = v.values
                if x.null_count:
                    continue
                with np.errstate(over="ignore"):
                    q = np.floor(256 * np.asarray(x, dtype=np.float64))
                if np.isfinite(q).all() and (np.abs(q) < HUGE).all():
                    ids.append(i)
                    blobs.append(pack(q))
                    dims.append(len(q))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary()), pa.array(dims, pa.int32())], names=["vec_id", "v", "dim"])

    return vectors.select(F.col(ident).cast("long"), F.col(column).cast("array<double>")).mapInArrow(run, "vec_id long, v binary, dim int")


def fit_pivots(x: np.ndarray, cells: int, rounds: int = 5, seed: int = 9) -> np.ndarray:
    """Centres of a few rounds of k-means over the sample."""
    rng = np.random.default_rng(seed)
    p = x[rng.permutation(len(x))[:cells]].copy()
    for _ in range(rounds):
        near = distances(x, p).argmin(1)
        for k in range(len(p)):
            if (near == k).any():
                p[k] = x[near == k].mean(0)
    return p


def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """From every row of x to every row of p; from the differences, so that large norms cost no digits."""
    return np.stack([np.linalg.norm(x - c, axis=1) for c in p], 1)


def integer_products(q: np.ndarray, x: np.ndarray) -> list[int]:
    """Exact inner products of q with the rows of x, cut to 64 bits."""
    whole = [int(a) for a in q.tolist()]
    return [min(max(sum(a * int(b) for a, b in zip(whole, row)), LEAST), -LEAST - 1) for row in x.tolist()]


def floor_of(least: np.ndarray) -> np.ndarray:
    """Scores to reach, as doubles that are no greater; LEAST stands for none."""
    return np.where(least == LEAST, -np.inf, least.astype(np.float64) - 2048)


def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vec_id, score) of each query's k best of x with a score of at least `least`."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    width = max(1, q.shape[1])
    s = q @ x.T
    other = q_ids[:, None] != ids[None, :]
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * width < 2**52:
        s = s.astype(np.int64)
        r, c = np.nonzero((s >= least[:, None]) & other)
        v = s[r, c]
    else:
        # Doubles only bound these scores; those that may be among the k best are computed as integers.
        slack = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :] * width * 2.0**-50 + 1
        low = np.where(other, s - slack, -np.inf)
        cut = np.partition(low, -k, axis=1)[:, -k] if len(x) >= k else np.full(len(q), -np.inf)
        cut = np.where(cut < -(2.0**62), -np.inf, np.minimum(cut, 2.0**62))  # what is cut to 64 bits ties
        r, c = np.nonzero(other & (s + slack >= np.maximum(cut, floor_of(least))[:, None]))
        v = np.zeros(len(r), np.int64)
        for i in np.unique(r):
            at = np.flatnonzero(r == i)
            v[at] = integer_products(q[i], x[c[at]])
        ok = v >= least[r]
        r, c, v = r[ok], c[ok], v[ok]
    o = np.lexsort((c, ~v, r))  # ids are sorted, so ties go to the smaller vec_id
    r, c, v = r[o], c[o], v[o]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    keep = place < k
    return r[keep], ids[c[keep]], v[keep]


def query_blocks(counts: dict[int, int], pivots: np.ndarray) -> dict[int, tuple[int, int]]:
    """(first block, number of blocks) of the queries of each cell.  Queries of a cell, and of cells whose pivots are next to each
    other along one axis, ask for much the same annuli, so they share blocks of about QUERIES; a large cell has several."""
    axis = np.linalg.svd(pivots - pivots.mean(0), full_matrices=False)[2][0]
    out, first, held = {}, 0, 0
    for c in sorted(counts, key=lambda c: float(pivots[c] @ axis)):
        if held and held + counts[c] > QUERIES:
            first, held = first + 1, 0
        many = -(-counts[c] // QUERIES)
        out[c] = (first, many)
        first, held = (first, held + counts[c]) if many == 1 else (first + many, 0)
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, cells: int = 16, sample: int = 4096, column: str = "embedding", ident: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id, score.  `is_query`: condition on vec_id.  Pivots are fitted on about `sample` vectors, of a small enough hash, at most twice as many."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    rows = scratch.save(quantised(vectors, column, ident).withColumn("row", F.monotonically_increasing_id()), "rows")
    u = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) / (1 << 30)
    known = rows.where(u < sample / max(rows.count(), 1)).select("vec_id", "v").limit(2 * sample).collect()  # bounded by `sample`
    known = sorted(known or rows.select("vec_id", "v").limit(sample).collect())
    schema = "query_id long, rank int, vec_id long, score long"
    if not known:
        return spark.createDataFrame([], schema)
    dim = max(1, rows.agg(F.max("dim")).first()[0])  # vectors may all be empty
    s_ids, s = np.array([r["vec_id"] for r in known]), unpack([r["v"] for r in known], dim)
    pivots = fit_pivots(s, cells)
    reach = distances(s, pivots).min(1)
    low, step = float(reach.min()), max(float(reach.max() - reach.min()) / (RINGS - 2), 1e-9)
    shared = spark.sparkContext.broadcast((pivots, s_ids, s))  # bounded by `sample` and `cells`

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value[0]
        for b in batches:
            x = unpack(b.v, dim)
            d = distances(x, p)
            cell = d.argmin(1)
            r = d[np.arange(len(x)), cell]
            ring = np.clip((r - low) // step + 1, 0, RINGS - 1)
            yield pd.DataFrame({"part": (cell * RINGS + ring).astype(np.int32), "dist": r, "norm": np.linalg.norm(x, axis=1), "vec_id": b.vec_id, "row": b.row, "v": b.v})

    index = scratch.save(rows.mapInPandas(place, "part int, dist double, norm double, vec_id long, row long, v binary"), "index")
    rings = index.groupBy("part").agg(F.min("dist").alias("a"), F.max("dist").alias("b"), F.max("norm").alias("norm"), F.count(F.lit(1)).alias("n")).orderBy("part").toPandas()  # at most cells * RINGS rows
    n = int(rings.n.sum())
    tiles = {int(p): int(np.ceil(c / TILE)) for p, c in zip(rings.part, rings.n)}
    asked = scratch.save(index.where(is_query).select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.floor(F.col("part") / RINGS).cast("int").alias("cell")), "asked")
    blocks = query_blocks({r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}, pivots)  # a row a cell
    table = spark.sparkContext.broadcast(rings)

    def bounds(q: np.ndarray) -> np.ndarray:
        p, t = shared.value[0], table.value
        d = distances(q, p)[:, t.part.to_numpy() // RINGS]
        gap = np.maximum(np.maximum(d - t.b.to_numpy(), t.a.to_numpy() - d), 0)
        own, most = np.linalg.norm(q, axis=1)[:, None] ** 2, t.norm.to_numpy()[None, :] ** 2
        return (own + most - gap**2) / 2 + 1e-9 * (own + most) + 1

    def expand(first: bool):
        """Rows (part, tile, block, query) of the annuli to search; the first round takes the nearest of them."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            _, ids, x = shared.value
            t = table.value
            for whole in batches:
                for a in range(0, len(whole), 256):
                    b = whole.iloc[a : a + 256]
                    q, q_ids = unpack(b.q, dim), b.query_id.to_numpy()
                    ub = bounds(q)
                    order = np.argsort(-ub, axis=1, kind="stable")
                    ahead = np.cumsum(t.n.to_numpy()[order], axis=1) - t.n.to_numpy()[order]
                    near = np.zeros(ub.shape, bool)
                    np.put_along_axis(near, order, ahead < max(NEAR, n // 20), axis=1)
                    if first:
                        r, _, v = best(q_ids, q, ids, x, np.full(len(q), LEAST), k)
                        least = np.full(len(q), LEAST)
                        full = np.bincount(r, minlength=len(q)) >= k
                        np.minimum.at(low_of := np.full(len(q), np.iinfo(np.int64).max), r, v)
                        least[full] = low_of[full]
                    else:
                        least = b.least.to_numpy()
                    go = (near if first else ~near) & (ub >= floor_of(least)[:, None])
                    i, j = np.nonzero(go)
                    parts = t.part.to_numpy()[j]
                    many = np.array([tiles[int(p)] for p in parts], np.int64)
                    i, parts = np.repeat(i, many), np.repeat(parts, many)
                    tile = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
                    cell, query = b.cell.to_numpy(), b["query"].to_numpy()
                    block = [blocks[c][0] + ((w * 0x9E3779B97F4A7C15) % (1 << 64) >> 33) % blocks[c][1] for c, w in zip(cell.tolist(), query.tolist())]
                    yield pd.DataFrame({"part": parts.astype(np.int32), "tile": tile.astype(np.int32), "block": np.array(block, np.int64)[i], "query": query[i], "query_id": q_ids[i], "q": b.q.to_numpy()[i], "least": least[i]})

        return run

    many = F.create_map(*[F.lit(x) for kv in tiles.items() for x in kv])
    cut = index.select("part", F.pmod(F.xxhash64("row"), many[F.col("part")].cast("long")).cast("int").alias("tile"), "vec_id", "v")
    key = ["part", "tile", "block"]

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64),) * 4]
        if len(left) and len(right):
            x, ids = unpack(right.v, dim), right.vec_id.to_numpy()
            for a in range(0, len(left), 256):
                b = left.iloc[a : a + 256]
                r, c, v = best(b.query_id.to_numpy(), unpack(b.q, dim), ids, x, b.least.to_numpy(), k)
                out.append((b["query"].to_numpy()[r], b.query_id.to_numpy()[r], c, v))
        return pd.DataFrame({c: np.concatenate(x) for c, x in zip(("query", "query_id", "vec_id", "score"), zip(*out))})

    def searched(spread: DataFrame, name: str) -> DataFrame:
        """A tile goes to the blocks that ask for it."""
        wanted = scratch.save(spread.select(*key).distinct(), f"{name}-tiles")
        sent = cut.join(maybe_broadcast(wanted, wanted.count()), ["part", "tile"])
        return spread.groupBy(*key).cogroup(sent.groupBy(*key)).applyInPandas(search, "query long, query_id long, vec_id long, score long")

    wide = "part int, tile int, block long, query long, query_id long, q binary, least long"
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    one = searched(asked.mapInPandas(expand(True), wide), "first")
    one = scratch.save(one.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).drop("rank"), "near")
    # The k-th best so far; without k of them nothing can be ruled out.
    least = one.groupBy("query").agg(F.min("score").alias("m"), F.count(F.lit(1)).alias("c"))
    again = asked.join(least, "query", "left").withColumn("least", F.when(F.col("c") >= k, F.col("m")).otherwise(F.lit(LEAST))).select("query", "query_id", "q", "cell", "least")
    two = searched(again.mapInPandas(expand(False), wide), "rest")
    both = one.unionByName(two).withColumn("rank", F.row_number().over(ranked).cast("int"))
    return both.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
