"""Operator 7: exact n-gram Jaccard join and its components.

A text is the set of its hashed word shingles (64 bits; two shingles of a corpus of 10^8 collide with odds of 1 in 4000).
Equal sets are one node.  Two sets can only link if their prefixes meet: the n - ceil(t n) + 1 first elements of any order
of all shingles.  The order puts the lowest hashes (a fixed share) first, and of these the rarest: a shingle that no other
node has is in the prefix but needs no tile, so copied passages and boilerplate rarely bring texts together that are not
near copies.  Prefix shingles are joined within overlapping bands of set size; what meets, directly or not, forms a cell.

In a cell, sets are compared in tiles by size: a parity bitmap of each set (one bit flipped by each element's hash) bounds
the overlap from above, since bits in which two bitmaps differ are elements in which the sets differ; what the bound
leaves is counted exactly on the sorted arrays.  Sets already in one component are not compared.  A cell over BLOCK
elements is cut into blocks, each with the leading set of every size band; what then isn't in the cell's main component is
compared with all other blocks, tile by tile.  So no link is lost, and no group's pairs are ever listed.

Cases: null, empty and blank texts have an empty set and link with nothing; shorter texts are one shingle of all their
words; repeated rows and equal texts are one node; rows that share a doc_id are separate rows; a null doc_id is never a
component's name unless all its rows have none; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakfold.llm.common import LEAST_FILES, Scratch, maybe_broadcast, partitions
from peakfold.llm.graph import components
from peakfold.llm.words import as_strings, slices, split_words

#: Elements of the sets of one tile.
BLOCK = 2_000_000
#: Nodes with one shingle beyond which it is counted apart, and the share of nodes by which such shingles are found.
HOT, HOT_SHARE = 4096, 64
#: Share of all hashes that come first in the order.
FIRST = 0.3
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; only A-Z are lower-cased, which is what bytes.lower does."""
    codes, ends, vocabulary = split_words(texts)
    w = np.array([xxhash.xxh3_64_intdigest(x.encode().lower()) for x in vocabulary], np.uint64)[codes]
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)

    def run(n: int) -> np.ndarray:
        h = np.full(max(0, len(w) - n + 1), n, np.uint64)
        for k in range(n):
            h = (h + w[k : k + len(h)]) * BASE
            h ^= h >> np.uint64(32)
        h *= MIX
        return h ^ (h >> np.uint64(29))

    full = run(words)
    short = {n: run(n) for n in range(1, words) if ((ends - starts) == n).any()}
    out = []
    for a, b in zip(starts.tolist(), ends.tolist()):
        n = b - a
        out.append(np.unique(full[a : b - words + 1]) if n >= words else short[n][a : a + 1] if n else np.zeros(0, np.uint64))
    return out


def band_starts(percent: int) -> np.ndarray:
    """First size of each band; sizes that can link are in the same band or in neighbours."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 100 // percent + 1)
    return np.array(out)


def node_of(s: np.ndarray) -> int:
    h = xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s))
    return h - (1 << 64) if h >= 1 << 63 else h


def lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))


def compare(sets: list[np.ndarray], label: np.ndarray, new: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join components: pairs (i, j) of sets; each is compared if one of the two is `new`.

    label: components so far, updated in place.
    """
    n = np.array([len(s) for s in sets])
    order = np.argsort(n, kind="stable")
    bits = int(min(4096, max(64, 64 * -(-int(np.median(n)) // 64))))
    bitmap = np.zeros((len(sets), bits // 64), np.uint64)
    for k, s in enumerate(sets):
        at = (s >> np.uint64(20)) % np.uint64(bits)
        odd = np.flatnonzero(np.bincount(at.astype(np.int64), minlength=bits) & 1)
        np.bitwise_or.at(bitmap[k], odd // 64, np.uint64(1) << (odd % 64).astype(np.uint64))
    sizes, out = n[order], []
    low = np.searchsorted(sizes, -(-sizes * percent // 100), "left")
    for k in range(len(order)):
        i = order[k]
        near = order[low[k] : k]
        if not new[i]:
            near = near[new[near]]
        near = near[label[near] != label[i]]
        if not len(near):
            continue
        differ = np.bitwise_count(bitmap[near] ^ bitmap[i]).sum(1, dtype=np.int64)
        both = n[near] + n[i]
        # overlap <= (sizes - differing bits) / 2 must reach percent / (100 + percent) of the sizes
        near = near[((both - differ) // 2) * (100 + percent) >= percent * both]
        for j in near[np.argsort(-n[near], kind="stable")]:
            if label[j] == label[i]:
                continue
            spot = np.searchsorted(sets[j], sets[i])
            spot[spot == len(sets[j])] = 0
            shared = int((sets[j][spot] == sets[i]).sum())
            if 100 * shared >= percent * (n[i] + n[j] - shared):
                out.append((int(i), int(j)))
                label[label == label[j]] = label[i]
    return out


def tile_links(tiles: DataFrame, key: list[str], percent: int, spread: int) -> DataFrame:
    """tiles: key, node, s (the set), new (compare with all; false: with new ones only), part (component so far)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None

        def close() -> pa.RecordBatch:
            seen: dict[int, tuple] = {}
            for r in held:  # a set that came twice counts once, as new if either is
                seen[r[0]] = (r[1], r[2] or (r[0] in seen and seen[r[0]][1]), r[3])
            nodes = list(seen)
            names = {p: k for k, p in enumerate(dict.fromkeys(seen[x][2] for x in nodes))}
            links = compare([np.frombuffer(seen[x][0], np.uint64) for x in nodes], np.array([names[seen[x][2]] for x in nodes]), np.array([seen[x][1] for x in nodes]), percent) if len(nodes) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in links], pa.int64()), pa.array([nodes[j] for _, j in links], pa.int64())], names=["a", "b"])

        for b in batches:
            for *k, node, s, new, part in zip(*[b.column(c).to_pylist() for c in (*key, "node", "s", "new", "part")]):
                if last is not None and k != last:
                    yield close()
                    held = []
                last = k
                held.append((node, s, new, part))
        if held:
            yield close()

    return tiles.select(*key, "node", "s", "new", "part").repartition(spread, *key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long")


def with_frequency(posted: DataFrame, scratch: Scratch) -> DataFrame:
    """posted (node, h) with df, the number of rows of each h.

    An h that very many nodes have shows in a fixed share of the nodes; such ones are counted by an aggregation and their counts
    brought to the rows, so that no task gets all rows of an h.  Whether an h is told apart that way changes no count.
    """
    some = posted.where(F.pmod(F.xxhash64("node", F.lit(7)), F.lit(HOT_SHARE)) == 0)
    hot = scratch.save(some.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > HOT / HOT_SHARE / 2).select("h"), "hot", LEAST_FILES)
    n = hot.count()
    count = F.count(F.lit(1))
    if not n:
        return posted.withColumn("df", count.over(Window.partitionBy("h")))
    hot = maybe_broadcast(hot, n)
    counted = scratch.save(posted.join(hot, "h", "left_semi").groupBy("h").agg(count.alias("df")), "often", n)
    rest = posted.join(hot, "h", "left_anti").withColumn("df", count.over(Window.partitionBy("h")))
    return rest.unionByName(posted.join(maybe_broadcast(counted, n), "h").select(*rest.columns))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, text_hash (xxhash64 of the text), n_shingles, node, component_id."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    spread = partitions(spark)
    starts = band_starts(percent)
    limit = np.uint64(int(FIRST * 2**64))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                s = shingle_sets(as_strings(b.column("text")), words)
                n = np.array([len(x) for x in s], np.int64)
                first = np.array([int(np.searchsorted(x, limit)) for x in s], np.int64)
                prefix = n - (percent * n + 99) // 100 + 1
                yield pa.RecordBatch.from_arrays([
                    b.column("doc_id"), b.column("text_hash"), pa.array(n), pa.array([node_of(x) if len(x) else None for x in s], pa.int64()), pa.array(prefix), pa.array((np.searchsorted(starts, n, "right") - 1).astype(np.int32)),
                    pa.array(first), lists([x[:f] for x, f in zip(s, first.tolist())]), lists([x[f:p] if p > f else x[:0] for x, f, p in zip(s, first.tolist(), prefix.tolist())]),
                ], names=["doc_id", "text_hash", "n", "node", "prefix", "band", "first", "h1", "h2"])

    schema = "doc_id long, text_hash long, n long, node long, prefix long, band int, first long, h1 array<long>, h2 array<long>"
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"))
    rows = scratch.save(given.mapInArrow(sets, schema), "sets")
    slim = rows.select("doc_id", "text_hash", "n", "node", "prefix", "band", "first")
    total = slim.count()
    classes = slim.where("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("r"), F.min(F.when(F.col("doc_id").isNotNull(), F.col("doc_id"))).alias("least"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("band").alias("band"), F.first("first").alias("first"))
    classes = scratch.save(classes.select("node", "r.doc_id", "r.text_hash", "least", "n", "prefix", "band", "first"), "classes", total)

    # Copies of a class's row are left out; they are all that makes a node come twice.
    copies = slim.where("n > 0").join(classes.select("node", F.col("doc_id").alias("d"), F.col("text_hash").alias("t")), "node").where(~(F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t"))))
    copies = scratch.save(copies.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")), "copies", total)
    own = rows.where("n > 0").join(maybe_broadcast(copies, copies.count()), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left_anti")
    shared = with_frequency(own.select("node", F.explode("h1").alias("h")), scratch).where("df > 1")
    by_node = Window.partitionBy("node")
    shared = shared.join(classes.select("node", "prefix", "first"), "node")
    shared = shared.withColumn("alone", F.col("first") - F.count(F.lit(1)).over(by_node)).withColumn("place", F.row_number().over(by_node.orderBy("df", "h")))
    keys = shared.where(F.col("place") <= F.col("prefix") - F.col("alone")).select("h", "node")
    keys = keys.unionByName(own.select(F.explode("h2").alias("h"), "node")).join(classes.select("node", "band"), "node")
    keys = keys.select("h", "node", F.explode(F.array(F.col("band") - 1, F.col("band"))).alias("band"))
    keys = scratch.save(keys, "keys")
    posted_keys = keys.count()
    leaders = keys.groupBy("h", "band").agg(F.min("node").alias("b"), F.max("node").alias("c")).where("b <> c").drop("c")
    cells = components(keys.join(leaders, ["h", "band"]).select(F.col("node").alias("a"), "b").where("a <> b"), scratch, "cells", posted_keys)
    cells = cells.withColumnRenamed("component", "cell").join(classes, "node")
    cells = scratch.save(cells.select("cell", "node", "doc_id", "text_hash", "n", "band"), "cells", total)
    scratch.drop(keys, copies)

    weight = cells.groupBy("cell").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    cells = scratch.save(cells.join(weight, "cell"), "blocks", total)
    found = cells.count()

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                s = shingle_sets(as_strings(b.column("text")), words)
                ok = [len(x) and node_of(x) == k for x, k in zip(s, b.column("node").to_pylist())]
                keep = pa.array(ok, pa.bool_())
                cols = [pc.filter(b.column(c), keep) for c in ("cell", "node", "band", "blocks")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([x.tobytes() for x, k in zip(s, ok) if k], pa.binary())], names=["cell", "node", "band", "blocks", "s"])

    side = maybe_broadcast(cells.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "cell", "node", "band", "blocks"), found)
    full = given.join(side, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t"))).select("text", "cell", "node", "band", "blocks").mapInArrow(again, "cell long, node long, band int, blocks int, s binary")
    full = scratch.save(full, "full")
    spot = F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")
    tiles = full.select("cell", spot.alias("block"), "node", "s", F.lit(True).alias("new"), F.col("node").alias("part"))
    many = full.where("blocks > 1")
    lead = many.join(many.groupBy("cell", "band").agg(F.min("node").alias("node")), ["cell", "band", "node"])
    lead = lead.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "node", "s", F.lit(True).alias("new"), F.col("node").alias("part"))
    links = scratch.save(tile_links(tiles.unionByName(lead), ["cell", "block"], percent, spread), "links", found)
    if not many.isEmpty():
        parts = components(links, scratch, "parts", found)
        state = many.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
        state = scratch.save(state, "state")
        sizes = state.groupBy("cell", "part").agg(F.count(F.lit(1)).alias("m"), F.sum(F.length("s") / 8).alias("e"))
        main = sizes.groupBy("cell").agg(F.max(F.struct("m", "part")).alias("x")).select("cell", F.col("x.part").alias("main"))
        rest = sizes.join(main, "cell").where("part <> main").groupBy("cell").agg(F.ceil(F.sum("e") / BLOCK).cast("int").alias("others"))
        state = state.join(main, "cell").join(rest, "cell")
        every = state.select("cell", spot.alias("block"), F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("other"), "node", "s", F.lit(False).alias("new"), "part")
        minor = state.where("part <> main").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("node"), F.col("others").cast("long")).cast("int").alias("other"), "node", "s", F.lit(True).alias("new"), "part")
        links = links.unionByName(tile_links(every.unionByName(minor), ["cell", "block", "other"], percent, spread))
    joined = components(links, scratch, "joined", found)
    ids = classes.select("node", "least").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = ids.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = ids.join(named, "component").select("node", "component_id")
    out = slim.join(ids, "node", "left")
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "node", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without near copies: of each component the row of the smallest doc_id, then text hash.

    Rows with an empty set all stay; a row that is repeated as a whole stays once.
    """
    scratch = Scratch(docs.sparkSession, "keep")
    total = docs.count()
    found = scratch.save(near_duplicates(docs, words, percent), "found", total)
    one = found.where("n_shingles > 0").groupBy(F.coalesce("component_id", "node").alias("c"), F.col("component_id").isNull().alias("z")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_hash")).alias("r"))
    one = one.select(F.col("r.doc_id").alias("__d"), F.col("r.text_hash").alias("__t")).unionByName(found.where("n_shingles = 0").select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__t")).distinct())
    one = scratch.save(one, "one", total)
    kept = docs.withColumn("__h", F.xxhash64("text")).join(maybe_broadcast(one, one.count()), F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__h") == F.col("__t")), "left_semi")
    if found.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        return kept.drop("__h")
    return kept.dropDuplicates(["doc_id", "__h"]).drop("__h")
