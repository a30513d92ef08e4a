"""Connected components by alternating large-star and small-star rounds, all as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakfold.llm.common import Scratch


def _star(edges: DataFrame) -> DataFrame:
    """Both directions of a, b with the least neighbour (or itself) of a."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a")


def components(edges: DataFrame, scratch: Scratch, tag: str, rows: int | None = None, most_rounds: int = 50) -> DataFrame:
    """edges: a, b; `rows`: a bound on their number, if known.  Returns node, component (its least node) for every node on an edge between two nodes."""
    now = scratch.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{tag}-0", rows)
    count, mark = now.count(), None
    if not count:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for k in range(1, most_rounds + 1):
        large = _star(now).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        both = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        small = both.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        after = scratch.save(small, f"{tag}-{k}", count)
        scratch.drop(now)
        now = after
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"), F.countDistinct("a").alias("d")).first()
        if mark == (seen["n"], seen["s"]) or (seen["n"] == seen["d"] and now.join(now.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty()):
            break
        count, mark = seen["n"], (seen["n"], seen["s"])
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
