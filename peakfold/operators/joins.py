"""Joins that Spark has no operator for, written as equi-joins on bins so that they shuffle and never compare all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most rows of a dimension table that may be broadcast.
SMALL = 100_000


def small_side(df: DataFrame, most: int = SMALL) -> DataFrame:
    """Broadcast a dimension after its rows were counted (no further than the bound); else leave the join to Spark."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float, extra: Column | None = None, how: str = "inner") -> DataFrame:
    """Rows of points inside rows of ranges (closed).  `width`: bin of the equi-join, about the length of a range.

    Column names of the two sides must differ.  A range is repeated for each bin it meets, a point is in one bin, so a pair
    meets once.
    """
    p = points.withColumn("__bin", F.floor(F.col(at) / width))
    r = ranges.withColumn("__bin2", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    on = (F.col("__bin") == F.col("__bin2")) & (F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))
    return p.join(r, on if extra is None else on & extra, how).drop("__bin", "__bin2")


def range_semi(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float, extra: Column | None = None) -> DataFrame:
    return range_join(points, ranges, at, low, high, width, extra, "left_semi")


def band_join(left: DataFrame, right: DataFrame, a: str, b: str, ppm: float, extra: Column | None = None, how: str = "inner", deal: tuple[int, list[str], list[str]] | None = None) -> DataFrame:
    """Rows with |a - b| <= ppm of the larger; positive values.  Bins are on the log scale, where the tolerance is a constant, and
    twice as wide, so a right row goes to the one or two bins that its band meets.

    Spark takes the repeated rows for no more bytes than the rows, so it is told not to broadcast them.  `deal` = (tasks, left
    columns, right columns that `extra` holds equal) deals both sides out to that many tasks, for joins that give far more rows than they read.
    """
    import math

    reach = -math.log1p(-ppm * 1e-6) * (1 + 1e-9) + 1e-12
    step = 2 * reach
    place = lambda c, d=0.0: F.floor((F.ln(F.col(c)) + d) / step)
    x = left.withColumn("__bin", place(a))
    y = right.withColumn("__bin2", F.explode(F.array_distinct(F.array(place(b, -reach), place(b, reach))))).hint("merge")
    if deal:
        tasks, own, other = deal
        x, y = x.repartition(tasks, "__bin", *own), y.repartition(tasks, "__bin2", *other).hint("merge")
    on = (F.col("__bin") == F.col("__bin2")) & (F.abs(F.col(a) - F.col(b)) <= F.greatest(F.col(a), F.col(b)) * (ppm * 1e-6))
    return x.join(y, on if extra is None else on & extra, how).drop("__bin", "__bin2")


def band_anti(left: DataFrame, right: DataFrame, a: str, b: str, ppm: float, extra: Column | None = None) -> DataFrame:
    return band_join(left, right, a, b, ppm, extra, "left_anti")


def match_once(left: DataFrame, right: DataFrame, key: list[str], a: str, b: str, ppm: float, weight: str) -> DataFrame:
    """Band join where each row of the right side is used once, by the nearest left row, and each left row takes its
    heaviest match."""
    both = band_join(left, right.select(*[F.col(k).alias(f"__{k}") for k in key], b, weight), a, b, ppm, _equal(key))
    near = Window.partitionBy(*key, b).orderBy(F.abs(F.col(a) - F.col(b)), a)
    heavy = Window.partitionBy(*key, a).orderBy(F.desc(weight), b)
    both = both.withColumn("__n", F.row_number().over(near)).where("__n = 1").withColumn("__h", F.row_number().over(heavy)).where("__h = 1")
    return both.drop("__n", "__h", *[f"__{k}" for k in key])


def _equal(key: list[str]) -> Column:
    on = F.lit(True)
    for k in key:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return on


def outer_match(left: DataFrame, right: DataFrame, key: list[str], a: str, b: str, ppm: float, x: str, y: str) -> DataFrame:
    """Full outer match of two peak tables: key, mz, x, y with 0 where one side has no peak."""
    inner = match_once(left, right, key, a, b, ppm, y)
    only_left = left.join(inner.select(*key, a), [*key, a], "left_anti").select(*key, F.col(a).alias("mz"), x, F.lit(0.0).alias(y))
    only_right = right.join(inner.select(*key, b), [*key, b], "left_anti").select(*key, F.col(b).alias("mz"), F.lit(0.0).alias(x), y)
    return inner.select(*key, F.col(a).alias("mz"), x, y).unionByName(only_left).unionByName(only_right)


def asof_nearest(left: DataFrame, right: DataFrame, key: list[str], at: str, payload: list[str], within: float | None = None) -> DataFrame:
    """Left rows with the payload of the right row nearest in `at` (a number), ties to the earlier; null when none.

    One sort of both sides together by key, in place of a join; with `within`, farther rows don't count.  Payload columns
    come back as near_<name> and near_<at>.
    """
    both = left.withColumn("__l", F.lit(True)).withColumn("__p", F.lit(None).cast(_struct(right, at, payload)))
    probe = right.select(*key, at, F.struct(F.col(at), *payload).alias("__p")).withColumn("__l", F.lit(False))
    both = both.unionByName(probe, allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(at, F.col("__l").cast("int"))
    before = F.last("__p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("__p", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    both = both.withColumn("__b", before).withColumn("__a", after).where("__l")
    gap_b, gap_a = F.col(at) - F.col("__b")[at], F.col("__a")[at] - F.col(at)
    near = F.when(F.col("__a").isNull() | (gap_b <= gap_a), F.col("__b")).otherwise(F.col("__a"))
    both = both.withColumn("__n", near)
    if within is not None:
        both = both.withColumn("__n", F.when(F.abs(F.col("__n")[at] - F.col(at)) <= within, F.col("__n")))
    return both.select(*left.columns, *[F.col("__n")[c].alias(f"near_{c}") for c in [at, *payload]])


def _struct(df: DataFrame, at: str, payload: list[str]) -> str:
    types = dict(df.dtypes)
    return "struct<" + ",".join(f"{c}:{types[c]}" for c in [at, *payload]) + ">"


def left_rollup(entries: DataFrame, bridge: DataFrame, entry_key: list[str], on: str, accession: str, keep: Column | None = None) -> DataFrame:
    """Entries with the ;-joined sorted accessions of their bridge rows; entries without one keep null.

    The bridge is grouped before the join, so entries are not multiplied and then grouped again.
    """
    b = bridge if keep is None else bridge.where(keep)
    b = b.groupBy(on).agg(F.array_join(F.array_sort(F.collect_set(accession)), ";").alias("accessions"))
    return entries.join(b, on, "left")


def passing(rows: DataFrame, ids: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(ids.select(*key), key, "left_semi")


def anchors(df: DataFrame, key: str, run: str, value: str) -> DataFrame:
    """Pairs of runs that share a key: key, run_a, run_b, value_a, value_b with run_a < run_b; one row for each run of a key."""
    a = df.select(F.col(key), F.col(run).alias("run_a"), F.col(value).alias("value_a"))
    b = df.select(F.col(key), F.col(run).alias("run_b"), F.col(value).alias("value_b"))
    return a.join(b, key).where(F.col("run_a") < F.col("run_b"))


def substring_join(pieces: DataFrame, whole: DataFrame, piece: str, text: str, k: int = 6) -> DataFrame:
    """Pairs where a piece occurs in a text: an equi-join on the piece's first k letters against the text's k-mers, then
    a check at that place.  Adds `position`, from 0; a piece shorter than k can't match.

    Spark takes the k-mers for no more bytes than their texts, so it is told not to broadcast them; counted few pieces are.
    """
    grams = whole.withColumn("__at", F.explode(F.sequence(F.lit(0), F.greatest(F.length(text) - k, F.lit(0)))))
    grams = grams.withColumn("__g", F.substr(F.col(text), F.col("__at") + 1, F.lit(k))).hint("merge")
    p = small_side(pieces.where(F.length(piece) >= k)).withColumn("__h", F.substr(F.col(piece), F.lit(1), F.lit(k)))
    hit = p.join(grams, (F.col("__h") == F.col("__g")) & (F.substr(F.col(text), F.col("__at") + 1, F.length(piece)) == F.col(piece)))
    return hit.withColumn("position", F.col("__at")).drop("__at", "__g", "__h")


def covered_share(hits: DataFrame, key: list[str], text: str, piece: str) -> DataFrame:
    """Per text: pieces, unique pieces (in one text only) and the share of its letters that pieces cover."""
    single = hits.groupBy(piece).agg(F.countDistinct(*key).alias("__t"))
    spots = hits.withColumn("__p", F.explode(F.sequence(F.col("position"), F.col("position") + F.length(piece) - 1)))
    cover = spots.groupBy(*key).agg((F.countDistinct("__p") / F.max(F.length(text))).alias("coverage"))
    counts = hits.select(*key, piece).distinct().join(single, piece).groupBy(*key).agg(F.count(F.lit(1)).alias("pieces"), F.count(F.when(F.col("__t") == 1, 1)).alias("unique_pieces"))
    return counts.join(cover, key)


def near_keys(texts: DataFrame, most: int, blocks: int) -> DataFrame:
    """__c (given), __len, __k, __rest: keys of which two texts of a length with at most `most` mismatches share one.  By pigeonhole on
    `blocks` = most + 1 parts and five more, they are the same in all but `most` parts: a key is what is left without these."""
    from itertools import combinations

    assert blocks == most + 1
    parts = blocks + 5
    n = F.length("__c")
    cut = [(F.floor(n * k / parts) + 1).cast("int") for k in range(parts + 1)]
    rest = lambda out: F.concat_ws("\u0000", *[F.substr("__c", cut[k], cut[k + 1] - cut[k]) for k in range(parts) if k not in out])
    return texts.select("__c", n.alias("__len"), F.posexplode(F.array(*[rest(out) for out in combinations(range(parts), most)])).alias("__k", "__rest"))


def similar_sequences(df: DataFrame, ident: str, sequence: str, most: int = 2, blocks: int = 3) -> DataFrame:
    """Pairs of equal length with at most `most` mismatches, similar residues equal.  Only different texts are joined, by
    `near_keys`; rows that share a text are paired afterwards, by their text."""
    from peakfold.functions.sequences import collapse_similar, mismatches

    rows = df.select(F.col(ident).alias("__i"), F.col(sequence).alias("__s"), collapse_similar(F.col(sequence)).alias("__c")).where("__c IS NOT NULL").distinct()
    keys = near_keys(rows.select("__c").distinct(), most, blocks)
    # The sides below are larger than Spark takes them for, so none is broadcast.
    a, b = (keys.select(F.col("__c").alias(c), "__len", "__k", "__rest").hint("merge") for c in ("__a", "__b"))
    near = a.join(b, ["__len", "__k", "__rest"]).where(F.col("__a") < F.col("__b")).select("__a", "__b")
    # Texts with one mismatch meet in one key, others in several.
    near = (near if most == 1 else near.distinct()).withColumn("mismatches", mismatches(F.col("__a"), F.col("__b"))).where(F.col("mismatches") <= most)
    x, y = (rows.select(F.col("__c").alias(c), F.col("__i").alias(i)).hint("merge") for c, i in (("__a", "__x"), ("__b", "__y")))
    apart = near.join(x, "__a").join(y, "__b").where(F.col("__x") != F.col("__y"))
    apart = apart.select(F.least("__x", "__y").alias("id_a"), F.greatest("__x", "__y").alias("id_b"), "mismatches")
    same = x.join(y, F.col("__a") == F.col("__b")).where(F.col("__x") < F.col("__y")).select(F.col("__x").alias("id_a"), F.col("__y").alias("id_b"), F.lit(0).alias("mismatches"))
    return apart.unionByName(same)


def first_match(rows: DataFrame, lookup: DataFrame, key: list[str], order: list) -> DataFrame:
    """Rows with the first lookup row of their key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.join(lookup.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r"), key)
