"""Operator 5: mixing sources to target weights.  DataFrame functions only.

Every source's documents form one stream of words, cut into blocks of a fixed number of words.  The mix is `shards` output
shards whose slots differ by one at most.  The counts of the sources in a shard are drawn: they are multinomial with the
targets' shares as odds, given that over all shards each source adds up to its target.  That draw is a pseudorandom
permutation of all slots of all sources (swap-or-not, so no table and no sort), dealt to the shards in turn.  Slot k of a source takes block
perm(k mod blocks), by a permutation of the source's block indices, and slots meet blocks in a join on (source, block).

Cases: null or empty texts have size 0 and take nothing; a null source is a source of its own, after all others; repeated
rows are documents of their own in `mix_plan` and one document in `mix_documents`; an empty table gives an empty result;
columns other than those of `documents` are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakfold.llm.common import Scratch, dense_index, partitions

#: Bytes that separate words; every other byte belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a source that are put in order in one task, about.
BUCKET_ROWS = 100_000
ROUNDS = 24
#: Slots that are made from one row.
CHUNK = 16384


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_key(source: Column) -> Column:
    """Never null; sorts by code point with the null source last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """sizes: skey, source_size, one row per source.  Adds `target`.

    Water filling in one pass: sources ordered by cap / weight are capped from the front while the level that the rest
    would get is above their cap.  That is where repeated resharing of the excess ends.
    """
    total = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("__n", F.row_number().over(total.orderBy("skey")) - 1)
    ranked = ranked.withColumn("__w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__n") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("__cap", most * F.col("source_size")).withColumn("__r", F.col("__cap") / F.col("__w"))
    before = total.orderBy("__r", "skey").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    level = ranked.withColumn("__t", share * F.sum("source_size").over(total)).withColumn("__all", F.sum("__w").over(total))
    level = level.withColumn("__left", F.col("__t") - F.coalesce(F.sum("__cap").over(before), zero)).withColumn("__wl", F.col("__all") - F.coalesce(F.sum("__w").over(before), zero))
    level = level.withColumn("__capped", F.col("__left") * F.col("__w") >= F.col("__cap") * F.col("__wl"))
    c = F.when(F.col("__capped"), F.col("__cap")).otherwise(zero)
    w = F.when(F.col("__capped"), F.col("__w")).otherwise(zero)
    level = level.withColumn("__rest", (F.col("__t") - F.sum(c).over(total)) / (F.col("__all") - F.sum(w).over(total)))
    return level.select("skey", "source_size", F.when(F.col("__capped"), F.col("__cap")).otherwise(F.col("__rest") * F.col("__w")).alias("target"))


def permuted(k: Column, n: Column, key: Column, inverse: bool = False) -> Column:
    """Pseudorandom permutation of 0..n-1 (swap-or-not shuffle); a bijection for every n and key."""
    rounds = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)

    def step(x, i):
        y = F.pmod(F.pmod(F.xxhash64(key, i), n) + n - x, n)
        top = F.greatest(x, y)
        return F.when(F.xxhash64(key, i, top).bitwiseAND(F.lit(1)) == 1, y).otherwise(x)

    return F.aggregate(F.array(*[F.lit(i) for i in rounds]), k.cast("long"), step)


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block_words: int = 64, shards: int = 64, seed: int = 5, keep: tuple[str, ...] = (), distinct: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The mix as four tables: placed documents, targets, taken word ranges and slots.

    placed: skey, doc_id, size, start (in the source's stream of words) and the columns of `keep`; targets: skey,
    source_size, target; taken: a placed document, slot, shard and its words [first, first + n); slots: skey, slot, shard,
    block, words.  Sizes are counted once and written to the shared folder; `distinct` takes
    rows that are equal in all of these as one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    base = docs.select(F.col("doc_id").alias("doc_id"), source_key(F.col("source")).alias("skey"), word_count(F.col("text")).alias("size"), *[F.col(c) for c in keep])
    base = scratch.save(base.distinct() if distinct else base, "sizes")
    rows = base.count()
    order = F.xxhash64(F.col("doc_id"), F.lit(seed))
    placed = dense_index(base, ["skey"], F.pmod(order, F.lit(max(64, rows // BUCKET_ROWS))), [order, F.col("doc_id"), F.col("size"), *[F.col(c) for c in keep]], "start", F.col("size"))
    placed = scratch.save(placed, "placed", rows)
    sizes = base.groupBy("skey").agg(F.sum("size").alias("source_size"))
    targets = scratch.save(source_targets(sizes, weights, share, most), "targets", rows)

    plan = targets.withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long")).withColumn("cap", F.floor(most * F.col("source_size")).cast("long"))
    plan = plan.withColumn("want", F.least(F.round("target"), F.col("cap")).cast("long")).where("want > 0")
    plan = plan.withColumn("tail", F.col("source_size") - (F.col("blocks") - 1) * block_words)
    plan = plan.withColumn("key", F.xxhash64("skey", F.lit(seed)))
    plan = plan.withColumn("tail_at", permuted(F.col("blocks") - 1, F.col("blocks"), F.col("key"), inverse=True))
    # Words of the first k slots of an epoch: k whole blocks, less what the short last block lacks.
    plan = plan.withColumn("epochs", F.expr("want div source_size")).withColumn("part", F.expr("want % source_size"))
    short = block_words - F.col("tail")
    plain = F.ceil(F.col("part") / block_words).cast("long")
    with_tail = F.ceil((F.col("part") + short) / block_words).cast("long")
    extra = F.when(plain <= F.col("tail_at"), plain).otherwise(F.greatest(with_tail, F.col("tail_at") + 1))
    plan = plan.withColumn("n_slots", F.col("epochs") * F.col("blocks") + F.when(F.col("part") > 0, extra).otherwise(0))
    sources = targets.count()
    plan = dense_index(plan, [], F.pmod(F.col("key"), F.lit(max(16, sources // BUCKET_ROWS))), [F.col("skey")], "base", F.col("n_slots"))
    plan = scratch.save(plan, "plan", rows)
    in_all = plan.agg(F.sum("n_slots")).first()[0] or 0

    # Slots are made in chunks, dealt over all tasks, so that a hot source's list is nowhere in one place.  The number of
    # tasks is given, or Spark would merge them for the few rows that chunks are.
    chunks = plan.where("n_slots > 0").select("skey", "n_slots", "base", "blocks", "key", "epochs", "part", "tail", "tail_at")
    chunks = chunks.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_slots - 1) div {CHUNK}")))).repartition(partitions(spark), "skey", "c")
    slots = chunks.withColumn("slot", F.explode(F.sequence(F.col("c") * CHUNK, F.least((F.col("c") + 1) * CHUNK, F.col("n_slots")) - 1)))
    at = F.expr("slot % blocks")
    full = F.when(F.expr("slot % blocks") == F.col("tail_at"), F.col("tail")).otherwise(F.lit(block_words))
    ahead = at * block_words - F.when(F.col("tail_at") < at, short).otherwise(0)
    limit = F.when(F.expr("slot div blocks") < F.col("epochs"), full).otherwise(F.least(full, F.greatest(F.col("part") - ahead, F.lit(0))))
    slots = slots.withColumn("block", permuted(at, F.col("blocks"), F.col("key"))).withColumn("words", limit.cast("long"))
    place = permuted(F.col("base") + F.col("slot"), F.lit(in_all).cast("long"), F.xxhash64(F.lit(seed + 1), F.lit(shards)))
    slots = slots.withColumn("shard", F.pmod(place, F.lit(shards)).cast("int")).withColumn("epoch", F.expr("slot div blocks")).select("skey", "slot", "epoch", "shard", "block", "words")

    spans = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}"))))
    # Spark takes what a generator makes to be as small as what it reads and would broadcast it: slots are shuffled.
    hit = spans.join(slots.hint("merge"), ["skey", "block"])
    begin = F.greatest(F.col("start"), F.col("block") * block_words)
    end = F.least(F.col("start") + F.col("size"), F.col("block") * block_words + F.col("words"))
    hit = hit.withColumn("first", begin - F.col("start")).withColumn("n", end - begin).where("n > 0")
    return placed, targets, hit, slots


def mix_rows(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    placed, targets, hit, _ = mix_plan(docs, **how)
    taken = hit.groupBy(F.col("skey").alias("__k"), F.col("start").alias("__s"), F.col("doc_id").alias("__d")).agg(F.sum("n").alias("taken"))
    # Rows of size 0 share their start with the next document and take nothing.
    key = (F.col("skey") == F.col("__k")) & (F.col("start") == F.col("__s")) & F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("size") > 0)
    rows = placed.join(taken, key, "left").select("skey", "doc_id", "size", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return rows.join(targets, "skey").select("doc_id", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix as documents: each text holds the words that the mix takes of it, as often as it takes them.

    Documents of which nothing is taken go.  Rows equal in doc_id, source and text are one document.  White space after a
    word stays with it, white space before the first and after the last word goes.  n_chars is counted anew.  Only the
    columns of `documents` are returned: others need not be the same in rows that are one document.
    """
    names = [c for c in ("doc_id", "text", "lang", "source", "n_chars") if c in docs.columns]
    identity = ["__s", "__n", "__d", "__h"]
    keyed = docs.select(*names).withColumns({"__s": source_key(F.col("source")), "__n": F.col("doc_id").isNull(), "__d": F.coalesce("doc_id", F.lit(0)), "__h": F.xxhash64("text")})
    _, _, hit, _ = mix_plan(keyed, keep=("__h",), distinct=True, **how)
    pieces = hit.groupBy(F.col("skey").alias("__s"), F.col("doc_id").isNull().alias("__n"), F.coalesce("doc_id", F.lit(0)).alias("__d"), "__h").agg(F.array_sort(F.collect_list(F.struct("epoch", "first", "n"))).alias("__p"))
    # One shuffle of the texts: they are grouped by what they are joined on.
    both = keyed.dropDuplicates(identity).join(pieces, identity).select(*names, "__p")
    words = F.regexp_extract_all("text", F.lit(WORD[:-1] + r"+[\x20\x09-\x0D]*"), F.lit(0))
    both = both.withColumn("__w", words)
    def piece(p):
        said = F.array_join(F.slice("__w", (p["first"] + 1).cast("int"), p["n"].cast("int")), "")
        return F.when(p["first"] + p["n"] == F.size("__w"), F.concat(said, F.lit("\n"))).otherwise(said)

    both = both.withColumn("text", F.rtrim(F.array_join(F.transform("__p", piece), ""), F.lit(" \n\t\r\x0b\x0c")))
    out = {c: F.col(c) for c in names}
    if "n_chars" in names:
        out["n_chars"] = F.length("text").cast("long")
    return both.select(*[out[c].alias(c) for c in names])
