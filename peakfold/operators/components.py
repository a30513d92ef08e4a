"""Connected components of a bridge table, by alternating large-star and small-star rounds, all as joins."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Pairs of an item and a group that a task links at once.
LINKED = 1 << 20


def checkpointed(df: DataFrame) -> DataFrame:
    """Checkpointed, in a folder of our own where a local session has none; on a cluster spark.checkpoint.dir must name a shared one."""
    spark = df.sparkSession
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="peakfold-"))
    return df.checkpoint()


def _star(edges: DataFrame) -> DataFrame:
    """Both directions of a, b with the least neighbour (or itself) of a."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that each of n numbers is linked to by pairs a, b."""
    root = np.arange(n)
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return root


def _linked(pairs: DataFrame) -> DataFrame:
    """a, b with the components of pairs i, a: tasks link the groups of each item, and give each group of LINKED pairs with
    the least that it is linked to there.  So they give no more rows than groups, however many items join them, and mostly the same ones."""
    kind = dict(pairs.dtypes)["a"]
    schema = StructType.fromDDL(f"a {kind}, b {kind}")
    wanted = to_arrow_schema(schema)

    def links(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        i, a = t["i"].combine_chunks(), t["a"].combine_chunks().dictionary_encode()
        same = np.flatnonzero(np.asarray(pc.fill_null(pc.equal(i[1:], i[:-1]), False)))
        order = pc.sort_indices(a.dictionary)
        groups, rank = a.dictionary.take(order), np.empty(len(order), np.int64)
        rank[np.asarray(order)] = np.arange(len(order))
        at = rank[np.asarray(a.indices)]
        return pa.RecordBatch.from_arrays([groups, groups.take(pa.array(_roots(len(groups), at[same], at[same + 1])))], schema=wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= LINKED:
                yield links(held)
                # The last row links its item to what comes.
                held, n = [b.slice(b.num_rows - 1)], 1
        if n:
            yield links(held)

    return pairs.repartition("i", F.when(F.col("i").isNull(), F.col("a"))).sortWithinPartitions("i").mapInArrow(run, schema)


def bridge_components(bridge: DataFrame, item: str, group: str, most_rounds: int = 100) -> DataFrame:
    """group, component (the least group reached over shared items) of every group of the bridge; null items join nothing.

    Rounds grow with the logarithm of the longest path, and go on until nothing changes."""
    pairs = bridge.select(F.col(item).alias("i"), F.col(group).alias("a")).where("a is not null")
    begun = checkpointed(_linked(pairs).distinct())
    # The shuffles of what was checkpointed stay on disk until the driver collects its garbage.
    bridge.sparkSession.sparkContext._jvm.System.gc()
    now = begun.where("a <> b")
    mark = None
    for _ in range(most_rounds):
        large = _star(now).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        now = checkpointed(small)
        seen = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    known = now.select(F.col("a").alias("__a"), F.col("b").alias("component"))
    return begun.select(F.col("a").alias(group)).distinct().join(known, F.col(group) == F.col("__a"), "left").select(group, F.coalesce("component", F.col(group)).alias("component"))
