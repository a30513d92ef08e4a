"""Running sums, minima and ranks over one long order, without one task seeing it all.

Rows are cut into ranges of the order at approximate quantiles; a range is sorted in a task, and what precedes it comes from
the ranges' totals, of which there are as many as ranges.  Equal values fall in one range, so ties stay together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakfold.operators.joins import SMALL


def ranges_for(df: DataFrame, rows: int = 5_000_000) -> int:
    """Ranges of about `rows` rows; a count of a plain scan reads the files' footers only."""
    return 1 + df.count() // rows


def few_groups(df: DataFrame, group: list[str], most: int = SMALL) -> bool:
    """Whether a table of one row a group may be broadcast, by a count that stops at the bound."""
    return df.select(*group).distinct().limit(most + 1).count() <= most


def with_ranges(df: DataFrame, group: list[str], order: str, ranges: int, few: bool = False) -> DataFrame:
    """Adds __range: the number of cuts at or below the value.  Cuts are quantiles per group, `ranges` numbers a group; they
    are broadcast for `few` groups, so that rows aren't dealt out by them."""
    shares = F.array(*[F.lit((k + 1) / ranges) for k in range(ranges - 1)]) if ranges > 1 else None
    if shares is None:
        return df.withColumn("__range", F.lit(0))
    cuts = df.groupBy(*group).agg(F.approx_percentile(order, shares, F.lit(10 * ranges)).alias("__cuts"))
    return df.join(F.broadcast(cuts) if few else cuts, group).withColumn("__range", F.size(F.filter("__cuts", lambda c: c <= F.col(order)))).drop("__cuts")


def running(df: DataFrame, group: list[str], order: str, what: dict[str, tuple[str, Column]], descending: bool = False, ranges: int = 1) -> DataFrame:
    """Adds columns: name -> ("sum" or "min", value), over all rows up to the row's order value, equal values included."""
    kinds = {"sum": F.sum, "min": F.min}
    named = {f"__v{i}": (out, kind, value) for i, (out, (kind, value)) in enumerate(what.items())}
    few = ranges > 1 and few_groups(df, group, SMALL // ranges)
    x = with_ranges(df, group, order, ranges, few).withColumns({v: value for v, (_, _, value) in named.items()})
    by = F.desc(order) if descending else F.asc(order)
    inside = Window.partitionBy(*group, "__range").orderBy(by).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    if ranges == 1:
        return x.withColumns({out: kinds[kind](v).over(inside) for v, (out, kind, _) in named.items()}).drop("__range", *named)
    before = Window.partitionBy(*group).orderBy(F.desc("__range") if descending else F.asc("__range")).rowsBetween(Window.unboundedPreceding, -1)
    totals = x.groupBy(*group, "__range").agg(*[kinds[kind](v).alias(f"{v}t") for v, (_, kind, _) in named.items()])
    totals = totals.select(*group, "__range", *[kinds[kind](f"{v}t").over(before).alias(f"{v}b") for v, (_, kind, _) in named.items()])
    x = x.withColumns({f"{v}i": kinds[kind](v).over(inside) for v, (_, kind, _) in named.items()}).join(F.broadcast(totals) if few else totals, [*group, "__range"])
    add = {out: (F.coalesce(F.col(f"{v}b"), F.lit(0)) + F.col(f"{v}i")) if kind == "sum" else F.least(f"{v}b", f"{v}i") for v, (out, kind, _) in named.items()}
    return x.withColumns(add).drop("__range", *[f"{v}{s}" for v in named for s in ("", "i", "b")])
