"""Operator 6: sharding by balanced label propagation.  DataFrame functions only.

Documents of equal text are linked (each to its group, never to each other pair by pair).  Shards start from a hash.  In
every round a linked document asks for the shard where most of its neighbours are; a shard admits as many as its quota
leaves, whole groups in turn; a group larger than a shard asks in parts.  Documents without neighbours cut no edge wherever they are: they fill the shards up at the
end, so that row counts are at most one apart (law `rows`).

Cases: null texts have 0 bytes and are a group of their own kind (null links only with null); a null doc_id is a value
like any other; repeated rows are linked as equal texts; ties between shards go to the greater mixed hash of group and shard; an empty table gives an
empty result; only doc_id, text and the columns asked for are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakfold.llm.common import Scratch, dense_index, maybe_broadcast

#: Rows of one group that are ordered in one task.
GROUP_ROWS = 512


def parts_of(n: Column) -> Column:
    """Parts of about GROUP_ROWS rows of a group of n."""
    return F.ceil(n / GROUP_ROWS).cast("long")


def part_key(n: Column, group_hash: Column, part: Column) -> Column:
    """Key of a group's part: the group's hash itself where there is one part."""
    return F.when(n > GROUP_ROWS, F.xxhash64(group_hash, part)).otherwise(group_hash)


def row_part(n: Column, row_hash: Column) -> Column:
    return F.pmod(row_hash, parts_of(n))


def mixed_bucket(n: Column, group_hash: Column, row_hash: Column, bits: int = 10) -> Column:
    """Bucket in the order of group hashes; a large group is spread over buckets of its own."""
    high = F.shiftrightunsigned(group_hash, 64 - bits)
    inner = row_part(n, row_hash)
    return F.when(n > GROUP_ROWS, F.format_string("%016x-%08d", group_hash, inner)).otherwise(F.format_string("%05x", high))


def shard_documents(docs: DataFrame, shards: int = 40, rounds: int = 4, seed: int = 6, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, and the columns of `keep`.  size: UTF-8 bytes plus 16."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "shard")
    text = F.col("text")
    rows = docs.select(
        F.col("doc_id").alias("doc_id"), (F.coalesce(F.octet_length(text).cast("long"), F.lit(0)) + 16).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.sha2(text.cast("binary"), 256), F.lit(seed)).alias("g"), *[F.col(c) for c in keep],
    )
    rows = rows.withColumn("h", F.xxhash64("doc_id", "g", F.lit(seed), *keep))
    # Group sizes: counted once; rows of groups of one never join again.
    rows = scratch.save(rows, "rows")
    total = rows.count()
    # A shard's rows are ordered in 2^bits buckets, of about GROUP_ROWS rows or, in small tables, fewer.
    bits = max(10, min(20, (total // shards // GROUP_ROWS).bit_length()))
    groups = scratch.save(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "groups", total)
    # A group of more rows than a shard should give it moves in as many parts as it needs shards.
    quota = total // shards
    # Sizes of large groups, of which there are at most a row in GROUP_ROWS, come by a broadcast; the others' rows are shuffled.
    large = groups.where(F.col("n") > GROUP_ROWS).withColumnRenamed("n", "__n")
    state = rows.join(maybe_broadcast(large, total // GROUP_ROWS), "g", "left").withColumn("__k", F.when(F.col("__n").isNull(), F.col("g")).otherwise(F.col("h")))
    state = state.join(groups.where(F.col("n") <= GROUP_ROWS).withColumnRenamed("g", "__k"), "__k", "left").withColumn("n", F.coalesce("__n", "n", F.lit(1))).drop("__k", "__n")
    state = state.withColumn("g", F.when(F.col("n") > 0.8 * quota, F.xxhash64("g", F.pmod("h", F.ceil(F.col("n") / max(1.0, 0.8 * quota)).cast("long")))).otherwise(F.col("g")))
    state = scratch.save(state.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int")), "start", total)

    alone = state.where("n = 1")
    linked = state.where("n > 1")
    for k in range(rounds):
        near = linked.groupBy("g", "shard").agg(F.count(F.lit(1)).alias("near"), F.max("n").alias("size_of"))
        held = linked.groupBy("shard").agg(F.count(F.lit(1)).alias("held"))
        # A shard that is over its quota attracts nobody.
        near = near.join(F.broadcast(held), "shard").withColumn("pull", F.when(F.col("held") < quota + 1, F.col("near")).otherwise(F.lit(-1)))  # one row a shard
        best = near.groupBy("g").agg(F.max("size_of").alias("size_of"), F.max(F.struct("pull", F.xxhash64("g", "shard").alias("tie"), "shard")).alias("b"), F.max(F.struct("near", F.xxhash64("g", "shard").alias("tie"), "shard")).alias("m"))
        best = best.select(F.col("g").alias("__g"), "size_of", F.when(F.col("b.pull") >= 0, F.col("b.shard")).otherwise(F.col("m.shard")).alias("to"))
        # The answer goes to every part of a group, so that no task gets all rows of a large one.
        best = best.withColumn("__p", F.explode(F.sequence(F.lit(0).cast("long"), parts_of(F.col("size_of")) - 1))).select(part_key(F.col("size_of"), F.col("__g"), F.col("__p")).alias("__k"), "to")
        asked = linked.withColumn("__k", part_key(F.col("n"), F.col("g"), row_part(F.col("n"), F.col("h")))).join(best, "__k").drop("__k").withColumn("stays", F.col("shard") == F.col("to"))
        stay = asked.groupBy("shard").agg(F.count(F.when(F.col("stays"), 1)).alias("stay"))
        movers = asked.where("not stays")
        movers = dense_index(movers, ["to"], mixed_bucket(F.col("n"), F.col("g"), F.col("h"), bits), [F.col("g"), F.col("h")], "rank")
        room = stay.withColumnRenamed("shard", "to")
        movers = movers.join(F.broadcast(room), "to", "left")  # one row a shard
        movers = movers.withColumn("shard", F.when(F.coalesce("stay", F.lit(0)) + F.col("rank") < quota, F.col("to")).otherwise(F.col("shard")))
        names = linked.columns
        after = scratch.save(asked.where("stays").select(*names).unionByName(movers.select(*names)), f"round{k}", total)
        if k:
            scratch.drop(linked)
        linked = after

    # Every shard keeps the first `quota` of its linked rows, groups in turn, large groups last; the rest fills the gaps.
    ranked = dense_index(linked, ["shard"], F.concat((F.col("n") > GROUP_ROWS).cast("int").cast("string"), mixed_bucket(F.col("n"), F.col("g"), F.col("h"), bits)), [F.col("g"), F.col("h")], "rank")
    ranked = scratch.save(ranked, "ranked", total)
    names = [c for c in state.columns]
    fixed = ranked.where(F.col("rank") < quota)
    free = ranked.where(F.col("rank") >= quota).select(*names).unionByName(alone.select(*names))
    free = dense_index(free.withColumn("__one", F.lit(0)), ["__one"], mixed_bucket(F.col("n"), F.col("g"), F.col("h"), bits + 4), [F.col("g"), F.col("h")], "at").drop("__one")
    held = spark.range(shards).select(F.col("id").cast("int").alias("shard")).join(F.broadcast(fixed.groupBy("shard").agg(F.count(F.lit(1)).alias("held"))), "shard", "left")  # one row a shard
    gap = held.withColumn("gap", F.lit(quota) + (F.col("shard") < total - quota * shards).cast("long") - F.coalesce("held", F.lit(0)))
    ends = gap.withColumn("end", F.sum("gap").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.agg(F.array_sort(F.collect_list(F.struct("end", "shard"))).alias("ends"))  # one row, an entry a shard
    free = free.withColumn("__k", F.lit(0)).join(F.broadcast(ends.withColumn("__k", F.lit(0))), "__k")
    free = free.withColumn("shard", F.element_at(F.filter("ends", lambda e: e["end"] > F.col("at")), 1)["shard"])
    placed = scratch.save(fixed.select(*names).unionByName(free.select(*names)), "placed", total)
    out = dense_index(placed, ["shard"], mixed_bucket(F.col("n"), F.col("g"), F.col("h"), bits), [F.col("g"), F.col("h")], "slot")
    return out.select("doc_id", "size", "text_crc32", "shard", "slot", *keep)


def shard_corpus(docs: DataFrame, shards: int = 40, **how) -> DataFrame:
    """The rows of docs with their shard and slot; rows equal in doc_id and text share out their slots."""
    scratch = Scratch(docs.sparkSession, "corpus")
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    keyed = docs.select(*names).withColumn("__h", F.xxhash64("text"))
    placed = shard_documents(keyed, shards, keep=("__h",), **how)
    spots = placed.groupBy(F.col("doc_id").alias("__d"), F.col("__h").alias("__t")).agg(F.array_sort(F.collect_list(F.struct("shard", "slot"))).alias("__s"))
    spots = scratch.save(spots, "spots", keyed.count())
    if spots.where(F.size("__s") > 1).isEmpty():
        keyed = keyed.withColumn("__k", F.lit(1))
    else:
        keyed = keyed.withColumn("__k", F.row_number().over(Window.partitionBy("doc_id", "__h").orderBy("__h")))
    both = keyed.join(maybe_broadcast(spots, spots.count()), F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__h") == F.col("__t")))
    return both.select(*names, F.element_at("__s", F.col("__k"))["shard"].alias("shard"), F.element_at("__s", F.col("__k"))["slot"].alias("slot"))
