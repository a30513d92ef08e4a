"""Operator 13: removing repeated passages of words by prefix-partitioned suffix trees.

A suffix starts at a word, and a passage is its first `least` words.  Suffixes that share a passage share its anchor, the run of GRAM
words of least hash in it, at the same place.  So the tree is cut at anchors: a context holds an anchor and the words of
all passages it is the anchor of, and contexts go to the group of a prefix of the suffix that starts at the anchor.  Prefixes have variable
length: one word, and two, four or eight where a group of fewer would hold more than LEAVES suffixes.  Groups of small prefixes share
a bundle, so every task gets memory-sized pieces.  Where eight words are not enough, prefixes take the whole passage: a
prefix of `least` words is a deep node by itself, and its least document is an aggregation.

A group builds its subtree: suffixes are the leaves, edges carry blocks of up to GRAM words, and an internal node
of depth `least` or more whose parent is less deep is a repeat; all its occurrences are its leaves, whose least document decides.
Words of a passage are removed from every document with a larger id.

Only anchors that two documents have are looked at, equal contexts are one row, and equal texts are told apart first, so that
a passage which very many documents share is one context, sent once for each page (documents packed to about PAGE bytes).
Words and blocks are compared by 64-bit hashes.  Pages are a bucketed table whose ids are chosen so that every
task writes to one bucket: writing them shuffles nothing, and neither do the joins that bring answers to pages.

Cases: null and empty texts and texts of white space have no words; texts under `least` words lose nothing, nor do rows of the
smallest doc_id of a passage; rows that share a doc_id never remove each other; a null doc_id counts as the largest; an
empty table gives an empty result; other columns are not read.  A task needs memory for its largest document.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakfold.llm.common import Scratch, maybe_broadcast, partitions
from peakfold.llm.repeats import grouped, ids_in_bucket, page_rows, release

PAGE = 1 << 20
#: Words of an anchor, a power of two, and of a block.
GRAM = 8
#: Suffixes of a group of prefixes, about.
LEAVES = 400_000
LAST = (1 << 63) - 1
BASE = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
U = np.uint64
#: A number for each byte.
BYTES = np.random.default_rng(13).integers(0, 2**64, 256, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(29))


def words_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end byte of every word; end of every document in words) of documents that lie end to end."""
    live = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[ends] = cut[0] = True
    first, last = live.copy(), live.copy()
    first[1:] &= ~live[:-1] | cut[1:-1]
    last[:-1] &= ~live[1:] | cut[1:-1]
    a, z = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(a):
        return np.zeros(0, U), a, z, np.zeros(len(ends), np.int64)
    size = z - a
    power = np.cumprod(np.concatenate([[U(1)], np.full(int(size.max()), U(BASE))]))
    place = np.zeros(len(data), np.int64)
    place[a[0] :] = np.arange(a[0], len(data)) - np.repeat(a, np.diff(np.append(a, len(data))))
    value = BYTES[data] * power[np.minimum(place, len(power) - 1)]
    value[~live] = 0
    h = np.add.reduceat(value, a)
    return mixed(h + size.astype(U) * U(0x94D049BB133111EB)), a, z, np.searchsorted(a, ends)


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from every place, along the last axis, from runs of powers of two."""
    width = h.shape[-1] - n + 1
    total, done, run, size = np.zeros((*h.shape[:-1], max(width, 0)), U), 0, h, 1
    while width > 0:
        if n & size:
            total = total * U(pow(BASE, size, 1 << 64)) + run[..., done : done + width]
            done += size
        if size * 2 > n:
            break
        run = run[..., :-size] * U(pow(BASE, size, 1 << 64)) + run[..., size:]
        size *= 2
    return mixed(total)


def anchors(h: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, first start, last start, document) of every anchor: of the passages that start from first to last, the
    anchor's run has the least hash, the leftmost of equal ones."""
    none = np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    long = np.flatnonzero(ends - starts >= least)
    if not len(long):
        return none, none.astype(U), none, none, none
    g = run_hashes(h, GRAM)
    v, off, size, w = (g >> U(32)).astype(np.uint32), np.zeros(len(g), np.int16), 1, least - GRAM + 1
    while size < w:
        d = min(size, w - size)
        right = v[d:] < v[:-d]
        off = np.where(right, off[d:] + np.int16(d), off[:-d])
        v = np.minimum(v[d:], v[:-d])
        size += d
    inside, new = np.zeros(len(off) + 1, bool), np.ones(len(off) + 1, bool)
    new[1:-1] = off[1:] != off[:-1] - 1
    for a, z in zip(starts[long].tolist(), (ends[long] - least + 1).tolist()):
        inside[a:z] = True
        new[a] = True
    first = np.flatnonzero(new[:-1] & inside[:-1])
    last = np.flatnonzero(inside[:-1] & (new[1:] | ~inside[1:]))
    at = first + off[first]
    return at, g[at], first, last, np.searchsorted(ends, first, "right")


def contexts(h: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, least: int) -> np.ndarray:
    """A row for each anchor: 256 x (passages less one) + the anchor's place, then the words of its passages, 0 after them."""
    wide = 2 * least - GRAM
    padded = np.concatenate([h, np.zeros(wide, U)])
    rows = padded[first[:, None] + np.arange(wide)[None, :]]
    rows[np.arange(wide)[None, :] >= (last - first + least)[:, None]] = 0
    return np.concatenate([((last - first) * 256 + at - first).astype(U)[:, None], rows], 1)


def context_keys(rows: np.ndarray) -> np.ndarray:
    power = np.cumprod(np.full(rows.shape[1], U(BASE)))
    return mixed((rows * power[None, :]).sum(1, dtype=U)).view(np.int64)


def leaves(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in it) of every suffix of the contexts."""
    count = (rows[:, 0] // U(256)).astype(np.int64) + 1
    row = np.repeat(np.arange(len(rows)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)


def subtree(rows: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaves of the contexts' suffix tree in its order, and the depth in words, to `least` at most, at which each parts from the
    leaf before: (row, place, depth).

    Edges carry blocks: of GRAM words, and at the end the last GRAM words of the passage, which may overlap.  A node lies at
    the end of a block; within a block no depth is told, since only nodes of depth `least` count.
    """
    row, place = leaves(rows)
    block = run_hashes(rows[:, 1:], GRAM)
    begins = [*range(0, least - GRAM, GRAM), least - GRAM]
    cols = [block[row, place + b] for b in begins]
    order = np.lexsort(cols[::-1]) if len(row) else row
    depth, same = np.zeros(len(row), np.int64), np.ones(max(0, len(row) - 1), bool)
    for b, c in zip(begins, cols):
        same &= c[order][1:] == c[order][:-1]
        depth[1:][same] = b + GRAM
    return row[order], place[order], depth


def deep_nodes(depth: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(first leaf, end) of the nodes of depth `least` or more whose parents are less deep, and of the leaves in none."""
    first = np.flatnonzero(depth < least)
    return first, np.concatenate([first[1:], [len(depth)]]).astype(np.int64)[: len(first)]


def least_documents(rows: np.ndarray, low: np.ndarray, least: int) -> list[np.ndarray]:
    """For every context the least document of each of its passages."""
    row, place, depth = subtree(rows, least)
    count = (rows[:, 0] // U(256)).astype(np.int64) + 1
    out = np.empty(len(row), np.int64)
    if len(row):
        first, end = deep_nodes(depth, least)
        out[(np.cumsum(count) - count)[row] + place] = np.repeat(np.minimum.reduceat(low[row], first), end - first)
    return np.split(out, np.cumsum(count)[:-1]) if len(rows) else []


def as_rows(blobs: list[bytes], least: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), U).reshape(len(blobs), 2 * least - GRAM + 1)


def packed_pages(rows: DataFrame, scratch: Scratch, spread: int) -> DataFrame:
    """page, ids, sizes, gs, data: the rows' (d, text, g) end to end, in a table bucketed by page."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial = ids_in_bucket(TaskContext.get().partitionId(), spread)
        held, size = [], 0

        def page() -> pa.RecordBatch:
            nonlocal held, size
            ids, texts, gs = zip(*held)
            held, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array([next(serial)], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([b"".join(gs)], pa.binary()), pa.array([b"".join(texts)], pa.binary())], names=["page", "ids", "sizes", "gs", "data"])

        for b in batches:
            for row in zip(*[b.column(c).to_pylist() for c in ("d", "text", "g")]):
                if held and size + len(row[1]) > PAGE:
                    yield page()
                held.append(row)
                size += len(row[1])
        if held:
            yield page()

    name = f"passages_{uuid.uuid4().hex}"
    Scratch.tables.append(name)
    out = rows.select("d", "text", "g").mapInArrow(pack, "page long, ids array<long>, sizes array<long>, gs binary, data binary")
    out.write.bucketBy(spread, "page").option("path", f"{scratch.root}/pages").option("compression", "zstd").saveAsTable(name)
    return rows.sparkSession.table(name)


def send_anchors(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, page, lo, hi: the distinct anchors of each page with the least and greatest document of each."""
    for page, ids, ends, data, _ in page_rows(batches, ()):
        h, _, _, stop = words_of(data, ends)
        _, g, _, _, doc = anchors(h, stop, least)
        u, back = np.unique(g, return_inverse=True)
        lo, hi = np.full(len(u), LAST), np.full(len(u), -(1 << 63))
        np.minimum.at(lo, back, ids[doc])
        np.maximum.at(hi, back, ids[doc])
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.full(len(u), page)), pa.array(lo), pa.array(hi)], names=["h", "page", "lo", "hi"])


def send_contexts(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page, key, p1, p2, p4, p8 (hashes of the anchor's first words), n (passages), low, ctx of each shared anchor's context."""
    for page, ids, ends, data, (shared,) in page_rows(batches, ("shared",)):
        h, _, _, stop = words_of(data, ends)
        at, g, first, last, doc = anchors(h, stop, least)
        live = np.isin(g, np.array(shared, np.int64).view(U))
        at, g, first, last, low = at[live], g[live], first[live], last[live], ids[doc[live]]
        prefixes = [run_hashes(h, n)[at].view(np.int64) for n in (1, 2, 4)] + [g.view(np.int64)]
        for a in range(0, len(at), 2048):
            s = slice(a, a + 2048)
            rows = contexts(h, at[s], first[s], last[s], least)
            n = len(rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, page)), pa.array(context_keys(rows)), *[pa.array(p[s]) for p in prefixes], pa.array(last[s] - first[s] + 1), pa.array(low[s]), pa.array([r.tobytes() for r in rows], pa.binary())], names=["page", "key", "p1", "p2", "p4", "p8", "n", "low", "ctx"])


def grow(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, p8, lows of the contexts of each bundle of prefixes: the least documents of their passages."""
    for _, held in grouped(batches, "bundle", ("key", "p8", "low", "ctx")):
        lows = least_documents(as_rows([x[3] for x in held], least), np.array([x[2] for x in held], np.int64), least)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], pa.int64()), pa.array(lows, pa.list_(pa.int64()))], names=["key", "p8", "lows"])


def whole_prefixes(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, p8, place, w, low: a row for each passage, w the hash of all its words."""
    for b in batches:
        rows = as_rows(b.column("ctx").to_pylist(), least)
        row, place = leaves(rows)
        w = run_hashes(rows[:, 1:], least)[row, place].view(np.int64)
        at = pa.array(row)
        yield pa.RecordBatch.from_arrays([b.column("key").take(at), b.column("p8").take(at), pa.array(place.astype(np.int32)), pa.array(w), b.column("low").take(at)], names=["key", "p8", "place", "w", "low"])


def remove(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rg, n_words, n_removed, kept_sha256, spans of every text of the pages."""
    for _, ids, ends, data, (answers, gs) in page_rows(batches, ("told", "gs")):
        h, a, z, stop = words_of(data, ends)
        mark = np.zeros(len(h) + 1, np.int64)
        if answers:
            at, _, first, last, doc = anchors(h, stop, least)
            keys = np.concatenate([context_keys(contexts(h, at[k : k + 2048], first[k : k + 2048], last[k : k + 2048], least)) for k in range(0, len(at), 2048)])
            known = np.array([x["key"] for x in answers], np.int64)
            order = np.argsort(known)
            spot = np.minimum(np.searchsorted(known[order], keys), len(known) - 1)
            hit = np.flatnonzero(known[order][spot] == keys)
            lows = [answers[i]["lows"] for i in order.tolist()]
            size = np.array([len(x) for x in lows], np.int64)
            flat, base = np.concatenate([np.asarray(x, np.int64) for x in lows]), np.cumsum(size) - size
            n = size[spot[hit]]
            o = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            gone = flat[np.repeat(base[spot[hit]], n) + o] < np.repeat(ids[doc[hit]], n)
            t = (np.repeat(first[hit], n) + o)[gone]
            mark += np.bincount(t, minlength=len(mark)) - np.bincount(t + least, minlength=len(mark))
        covered = np.cumsum(mark[:-1]) > 0
        kept = np.flatnonzero(~covered)
        size = z[kept] - a[kept] + 1  # with the space after each word
        at = np.cumsum(size)
        text = np.full(int(at[-1]) if len(at) else 0, 0x20, np.uint8)
        live = np.arange(len(text)) - np.repeat(at - size, size)
        source = np.repeat(a[kept], size) + live
        inner = live < np.repeat(size - 1, size)
        text[inner] = data[source[inner]]
        begin = np.concatenate([[0], stop[:-1]]).astype(np.int64)
        before = np.concatenate([[0], np.cumsum(~covered)])  # kept words before each word
        byte = np.concatenate([[0], at])[before]  # and their bytes
        whole, out = text.tobytes(), []
        for k, (s, e) in enumerate(zip(begin.tolist(), stop.tolist())):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], covered[s:e].view(np.int8), [0]])))
            out.append((gs[32 * k : 32 * k + 32], e - s, int(covered[s:e].sum()), hashlib.sha256(whole[byte[s] : max(byte[s], byte[e] - 1)]).hexdigest(), ",".join(f"{x}:{y}" for x, y in edge.reshape(-1, 2).tolist())))
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["rg", "n_words", "n_removed", "kept_sha256", "spans"])


def answers(contexts_: DataFrame, scratch: Scratch, least: int, spread: int, most: int) -> DataFrame:
    """key, p8, lows of distinct contexts, by groups of variable-length prefixes."""
    total = contexts_.agg(F.sum("n")).first()[0] or 0
    level = ["p1", "p2", "p4", "p8"]
    now, key, open_ = contexts_, F.lit(None).cast("long"), F.lit(True)
    for p in level:
        over = scratch.save(contexts_.groupBy(p).agg(F.sum("n").alias("leaves")).where(F.col("leaves") > most).select(p, F.lit(True).alias(f"{p}_over")), f"over-{p}")
        many = over.count()
        if many:
            now = now.join(maybe_broadcast(over, many), p, "left")
        split = F.coalesce(F.col(f"{p}_over"), F.lit(False)) if many else F.lit(False)
        key, open_ = F.when(open_ & ~split, F.xxhash64(F.lit(p), F.col(p))).otherwise(key), open_ & split
        if not many:
            break
    bundles = max(spread, -(-2 * total // most))
    now = now.withColumn("bundle", F.pmod(key, F.lit(bundles)))
    small = now.where("bundle IS NOT NULL").select("bundle", "key", "p8", "low", "ctx")
    told = small.repartition(spread, "bundle").sortWithinPartitions("bundle").mapInArrow(functools.partial(grow, least), "key long, p8 long, lows array<long>")
    if many:
        each = now.where("bundle IS NULL").select("key", "p8", "low", "ctx").mapInArrow(functools.partial(whole_prefixes, least), "key long, p8 long, place int, w long, low long")
        each = scratch.save(each, "whole")
        nodes = each.groupBy("w").agg(F.min("low").alias("m"))
        back = each.join(nodes, "w").groupBy("key", "p8").agg(F.array_sort(F.collect_list(F.struct("place", "m"))).alias("x"))  # a context has at most `least` passages
        told = told.unionByName(back.select("key", "p8", F.col("x.m").alias("lows")))
    return told


def dedup(docs: DataFrame, least: int = 50, most: int = LEAVES) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, spans (first:end of removed words, comma-joined)."""
    assert GRAM < least < 250
    spark = docs.sparkSession
    scratch = Scratch(spark, "passages")
    spread = partitions(spark)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumn("g", F.unhex(F.sha2("text", 256)))
    slim = scratch.save(rows.select("d", "doc_id", "g"), "slim")
    rows_in = slim.count()
    slim = scratch.save(slim.join(slim.groupBy("g").agg(F.min("d").alias("f")), "g"), "first", rows_in)
    copies = scratch.save(slim.where("d > f").select(F.col("d").alias("cd"), F.col("g").alias("cg")).distinct(), "copies", rows_in)
    own = rows.join(maybe_broadcast(copies, copies.count()), (F.col("d") == F.col("cd")) & (F.col("g") == F.col("cg")), "left_anti")
    pages = packed_pages(own, scratch, spread)

    known = scratch.save(pages.select("page", "ids", "sizes", "data").mapInArrow(functools.partial(send_anchors, least), "h long, page long, lo long, hi long"), "anchors")
    shared = known.groupBy("h").agg(F.min("lo").alias("a"), F.max("hi").alias("b")).where("a < b").select("h")
    shared = scratch.save(shared, "shared")
    some = known.select("h", "page").join(maybe_broadcast(shared, shared.count()), "h")
    own_anchors = scratch.save(some.groupBy("page").agg(F.collect_list("h").alias("shared")), "own")  # a page's anchors
    scratch.drop(known)
    release(docs)
    marked = pages.join(own_anchors.hint("shuffle_hash"), "page").select("page", "ids", "sizes", "data", "shared")
    sent = scratch.save(marked.mapInArrow(functools.partial(send_contexts, least), "page long, key long, p1 long, p2 long, p4 long, p8 long, n long, low long, ctx binary"), "contexts")
    distinct = scratch.save(sent.groupBy("ctx").agg(F.min("low").alias("low"), *[F.first(c).alias(c) for c in ("key", "p1", "p2", "p4", "p8", "n")]), "distinct")
    release(docs)
    told = scratch.save(answers(distinct, scratch, least, spread, most), "told")
    asked = sent.groupBy("page", "key", "p8").agg(F.max("low").alias("hi"))
    back = asked.join(told, ["key", "p8"]).where(F.array_min("lows") < F.col("hi"))
    back = scratch.save(back.groupBy("page").agg(F.collect_list(F.struct("key", "lows")).alias("told")), "back")  # a page's anchors
    scratch.drop(sent, distinct)
    release(docs)

    full = pages.join(back.hint("shuffle_hash"), "page", "left").select("page", "ids", "sizes", "data", "told", "gs")
    done = scratch.save(full.mapInArrow(functools.partial(remove, least), "rg binary, n_words long, n_removed long, kept_sha256 string, spans string"), "done").dropDuplicates(["rg"])
    # Copies of a smaller document lose all, if they hold a passage.
    copy = (F.col("d") > F.col("f")) & (F.col("n_words") >= least)
    out = slim.join(done, F.col("g") == F.col("rg"))
    return out.select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(copy, F.concat(F.lit("0:"), F.col("n_words").cast("string"))).otherwise(F.col("spans")).alias("spans"),
    )
