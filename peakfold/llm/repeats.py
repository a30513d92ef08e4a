"""Operator 8: removing repeated passages by a distributed enhanced suffix array.

A suffix belongs to the bucket of the anchor of its first `least` bytes: the gram of least hash among those bytes.  That is
a function of these bytes alone, so equal passages meet in one bucket and every interval of the global suffix array of
depth `least` or more lies within one.  Only anchors that two documents have are looked at: pages (documents packed to about
PAGE bytes) first send the distinct anchor keys of each bucket and get back one bit a key, then the distinct
contexts of shared anchors with the least doc_id that has each.  A bucket sorts its suffixes, finds the common prefixes of
neighbours, and stack-scans the common-prefix intervals; an interval with several bytes to its left is a maximal
repeat.  For `dedup` an outermost interval that passes this test begins a group, whose least document is that of all its
occurrences.  One that fails it has one byte to its left: its occurrences are among those of the passage one byte before,
and are all of them if that passage's interval is deeper than `least`, so then the group goes on; where the interval branches
there, each branch begins a group.  Pages get back the least documents of the groups, and remove what starts in a smaller
document.

Buckets travel in bundles, one row a page and bundle.  Pages and bundles grow with the root of the text, so that these rows
grow about as the text does and not with its square (see `layout`).

Pages are a bucketed table whose ids are chosen so that every task writes a stripe of STRIPE bytes to one bucket and the next to
another: writing them shuffles nothing, neither do the two joins that bring answers to pages, and a table of few large files is
still read by many tasks.

A passage or anchor that very many documents share is sent once a page, whatever the number of its documents.  Equal
texts are told apart by a digest first: all but the first are removed whole.

Cases: null and empty texts have 0 bytes and lose nothing; texts under `least` bytes lose nothing, nor do rows of the
smallest doc_id of a passage; rows that share a doc_id never remove each other; a null doc_id counts as the largest; an
empty table gives an empty result; other columns are not read.  A task needs memory for its largest document.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import itertools
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakfold.llm.common import Scratch, maybe_broadcast, partitions

#: Bytes of a page of a text of GROWS bytes or less; at most PAGE_GROWS times that in a larger one.
PAGE, GROWS, PAGE_GROWS = 1 << 20, 1 << 30, 8
#: Bytes of pages that a task writes to one bucket.
STRIPE = 1 << 25
#: Bytes of a gram; anchors are the least of least - GRAM + 1 neighbouring grams.
GRAM = 20
#: Anchors of a bucket, about.
BUCKET = 150_000
#: Anchors of a bundle of buckets, about, and how many times that at most in a larger text.
BUNDLE, BUNDLE_GROWS = 500_000, 4
KEY = np.uint64((1 << 40) - 1)
LAST = (1 << 63) - 1
#: In place of a left byte: several, or the start of a document.
DIVERSE = -2
BASE = 0x9E3779B97F4A7C15


def layout(total: int, spread: int, least: int) -> tuple[int, int, int]:
    """(bytes of a page, buckets, buckets of a bundle) for `total` bytes of text and `spread` tasks."""
    grown = max(1.0, total / GROWS) ** 0.5
    count = -(-total * 2 // (least - GRAM + 2))
    bundles = max(2 * spread, math.ceil(count / (BUNDLE * min(grown, BUNDLE_GROWS))))
    per = max(1, -(-count // (bundles * BUCKET)))
    return int(PAGE * min(grown, PAGE_GROWS)), bundles * per, per


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from every position, by doubling."""
    m = [pow(BASE, 1 << k, 1 << 64) for k in range(5)]
    h = data.astype(np.uint64) + np.uint64(1)
    four = h
    for k in range(4):
        step = 1 << k
        h = h[:-step] * np.uint64(m[k]) + h[step:]
        four = h if step == 2 else four
    h = h[: len(data) - GRAM + 1] * np.uint64(m[2]) + four[16 : 16 + len(data) - GRAM + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def least_grams(data: np.ndarray, least: int, block: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every gram, distance from every passage's start to its gram of least hash, the leftmost of equal ones).

    Block by block, so that what is worked on stays in the cache.
    """
    w = least - GRAM + 1
    n = len(data) - least + 1
    hashes, out = np.zeros(len(data) - GRAM + 1, np.uint64), np.zeros(n, np.uint8)
    for a in range(0, n, block):
        z = min(n, a + block)
        h = gram_hashes(data[a : z + least - 1])
        hashes[a : a + len(h)] = h
        place = np.arange(len(h), dtype=np.uint64)
        v, size = (h >> np.uint64(32) << np.uint64(32)) | place, 1  # of equal hashes the leftmost is the least
        while size < w:
            d = min(size, w - size)
            v = np.minimum(v[d:], v[:-d])
            size += d
        out[a:z] = (v & np.uint64(0xFFFFFFFF)) - place[: len(v)]
    return hashes, out


def anchors(data: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash, first start, last start, document) of every anchor: of the passages of `least` bytes that start
    from first to last, the anchor's gram has the least hash (the leftmost of equal ones)."""
    none = np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    long = np.flatnonzero(ends - starts >= least)
    if not len(long):
        return none, none.astype(np.uint64), none, none, none
    h, off = least_grams(data, least)
    inside = np.zeros(len(off) + 1, bool)
    new = np.ones(len(off) + 1, bool)
    new[1:-1] = off[1:] != off[:-1] - np.uint8(1)
    for a, z in zip(starts[long].tolist(), (ends[long] - least + 1).tolist()):
        inside[a:z] = True
        new[a] = True
    first = np.flatnonzero(new[:-1] & inside[:-1])
    last = np.flatnonzero(inside[:-1] & (new[1:] | ~inside[1:]))
    at = first + off[first]
    return at, h[at], first, last, np.searchsorted(ends, first, "right")


def distinct_keys(h: np.ndarray, doc: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct bucket << 40 | key, whether two documents have it, place of each anchor among them)."""
    full = ((h >> np.uint64(40)) % np.uint64(buckets) << np.uint64(40)) | (h & KEY)
    u, back = np.unique(full, return_inverse=True)
    lo, hi = np.full(len(u), LAST), np.full(len(u), -1)
    np.minimum.at(lo, back, doc)
    np.maximum.at(hi, back, doc)
    return u, lo < hi, back


def by_bucket(u: np.ndarray, per: int = 1) -> Iterator[tuple[int, int, int]]:
    """(bucket, begin, end) of each bucket in sorted keys, or of each bundle of `per` buckets."""
    b = (u >> np.uint64(40)) // np.uint64(per)
    cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else []
    for a, z in zip(cut, [*cut[1:], len(b)]):
        yield int(b[a]), int(a), int(z)


def contexts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, doc: np.ndarray, least: int, extra: int = 0) -> np.ndarray:
    """A row of bytes for each anchor: passages less one, anchor's place, twice the number of bytes (at most `extra`) after
    the last passage plus whether a byte is to the left, it, the bytes."""
    wide = 2 * least - GRAM + 1 + extra
    out = np.zeros((len(at), wide + 3), np.uint8)
    out[:, 0], out[:, 1] = last - first, at - first
    after = np.minimum(ends[doc] - last - least, extra)
    out[:, 2] = (first > starts[doc]) + 2 * after
    size = (last - first + least + after).astype(np.int64)
    if len(at):
        near = np.lib.stride_tricks.sliding_window_view(np.pad(data, (1, wide)), wide)[first]  # from the byte to the left
        near *= np.arange(wide) <= size[:, None]
        near[:, 0] *= out[:, 2] % 2
        out[:, 3:] = near
    return out


def shared_contexts(data, ends, ids, bits: dict[int, bytes], buckets: int, least: int, extra: int = 0, per: int = 1):
    """Distinct contexts of a page's shared anchors: (bucket of each, context rows, least doc_id, and of every shared
    anchor: first start, document, place of its context).  Bits are by bundle of `per` buckets."""
    at, h, first, last, doc = anchors(data, ends, least)
    u, _, back = distinct_keys(h, doc, buckets)
    keep = np.zeros(len(u), bool)
    for b, a, z in by_bucket(u, per):
        if b in bits:
            keep[a:z] = np.unpackbits(np.frombuffer(bits[b], np.uint8), count=z - a).astype(bool)
    live = keep[back] if len(back) else np.zeros(0, bool)
    at, first, last, doc, bucket = at[live], first[live], last[live], doc[live], (u[back[live]] >> np.uint64(40)).astype(np.int64)
    rows = contexts(data, np.concatenate([[0], ends[:-1]]), ends, at, first, last, doc, least, extra)
    order, place = distinct_rows(rows, bucket)
    low = np.full(len(order), LAST)
    np.minimum.at(low, place, ids[doc])
    return bucket[order], rows[order], low, first, doc, place


def distinct_rows(rows: np.ndarray, lead: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index of one row of each kind, kind of each row), kinds sorted by `lead` and then by a hash of their bytes."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pad = -rows.shape[1] % 8
    words = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, pad)))).view(">u8").astype(np.uint64)
    key = np.zeros(len(rows), np.uint64)
    for c in words.T:
        key = (key ^ c) * np.uint64(BASE)
        key ^= key >> np.uint64(32)
    if lead is not None:
        key = (lead.astype(np.uint64) << np.uint64(40)) | (key >> np.uint64(24))
    order = sorted_by([key, *words.T])
    new = (words[order][1:] != words[order][:-1]).any(1)
    if lead is not None:
        new |= lead[order][1:] != lead[order][:-1]
    kind = np.concatenate([[0], np.cumsum(new)])
    place = np.empty(len(rows), np.int64)
    place[order] = kind
    return order[np.concatenate([[True], new])], place


def sorted_by(cols: list[np.ndarray]) -> np.ndarray:
    """Order by the columns in turn: by the first, then those groups again in which a later one differs."""
    order = np.argsort(cols[0])
    again, own = np.arange(len(order)), cols[0][order]  # places that may still change, what they are grouped by
    for k in range(1, len(cols)):
        tied = own[1:] == own[:-1]
        differ = np.zeros(len(tied), bool)
        for c in cols[k:]:
            v = c[order[again]]
            differ |= v[1:] != v[:-1]
        group = np.concatenate([[0], np.cumsum(~tied)]) if len(again) else again
        mixed = np.zeros(len(again), bool)
        mixed[group[1:][differ & tied]] = True
        live = mixed[group]
        if not live.any():
            break
        again, group = again[live], group[live]
        v = cols[k][order[again]]
        by = np.lexsort([v, group])
        order[again], v = order[again][by], v[by]
        own = np.concatenate([[0], np.cumsum((v[1:] != v[:-1]) | (group[1:] != group[:-1]))])  # by is a permutation within groups
    return order


def suffix_array(rows: np.ndarray, least: int, extra: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted suffixes of contexts: (row, passage, common prefix with the suffix before, byte to the left or -1).

    Suffixes are compared to least + extra bytes, where extra doesn't leave the 8-byte word that least ends in; common
    prefixes are exact from `least` to there and else 0.
    """
    words = -(-(least + extra) // 8)
    assert 8 * (words - 1) <= least
    count = rows[:, 0].astype(np.int64) + 1
    row = np.repeat(np.arange(len(rows)), count)
    o = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    padded = np.pad(rows, ((0, 0), (0, 8 * words)))
    eight = np.ndarray((max(0, padded.size - 7),), ">u8", padded.tobytes(), strides=(1,))  # of the bytes from every place
    spot = row * padded.shape[1] + 4 + o
    cols = [eight[spot + 8 * j].astype(np.uint64) for j in range(words)]
    del eight, padded
    over = 8 * words - (least + extra)
    cols[-1] = cols[-1] >> np.uint64(8 * over) << np.uint64(8 * over)
    order = sorted_by(cols)
    same = np.ones(max(0, len(order) - 1), bool)
    lcp = np.zeros(len(order), np.int64)
    for c in cols[:-1]:
        same &= c[order][1:] == c[order][:-1]
    x = cols[-1][order][1:] ^ cols[-1][order][:-1]
    equal = np.full(len(x), 8 * words - over)
    for b in range(7, -1, -1):
        equal = np.where((x >> np.uint64(8 * (7 - b))) & np.uint64(255) != 0, 8 * (words - 1) + b, equal)
    has = (least + rows[row, 0].astype(np.int64) - o + rows[row, 2] // 2)[order]  # bytes of the suffix in its context
    equal = np.minimum(equal, np.minimum(has[1:], has[:-1]))
    lcp[1:] = np.where(same & (equal >= least), equal, 0)
    left = np.where((o > 0) | (rows[row, 2] % 2 > 0), rows[row, 3 + o].astype(np.int64), -1)
    return row[order], o[order], lcp, left[order]


def scan(lcp: np.ndarray, left: np.ndarray, least: int, extra: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(depth, first, end, whether bytes to the left differ or are none) of all common-prefix intervals of depth `least` or more
    in a suffix array.  Runs of suffixes equal to the full depth are one step of the stack scan."""
    top = least + extra
    first = np.flatnonzero(lcp < top)  # of classes of suffixes equal to the full depth
    end = np.concatenate([first[1:], [len(lcp)]]).astype(np.int64)
    depth = np.where(lcp[first] >= least, lcp[first], 0)
    low, high = (f.reduceat(left, first) if len(first) else left for f in (np.minimum, np.maximum))
    own = np.where((low == high) & (low >= 0), low, DIVERSE)
    ahead = np.concatenate([depth[1:], [0]]).astype(np.int64) if len(first) else depth
    busy = (depth > 0) | (ahead > 0)  # of other classes only the class itself can be a repeat
    many = end - first > 1
    out: list[tuple[int, int, int, bool]] = []
    stack: list[list[int]] = []  # depth, first suffix, byte to the left or DIVERSE
    for a, z, mark, deep in zip(first[busy].tolist(), end[busy].tolist(), own[busy].tolist(), ahead[busy].tolist()):
        begin = a
        while stack and stack[-1][0] > deep:
            d, begin, seen = stack.pop()
            mark = mark if mark == seen else DIVERSE
            out.append((d, begin, z, mark == DIVERSE))
        if stack and stack[-1][0] == deep:
            stack[-1][2] = mark if mark == stack[-1][2] else DIVERSE
        elif deep:
            stack.append([deep, begin, mark])
    found = np.array(out, np.int64).reshape(-1, 4)
    return tuple(np.concatenate([x, y]) for x, y in zip((np.full(many.sum(), top), first[many], end[many], own[many] == DIVERSE), (*found[:, :3].T, found[:, 3] > 0)))


def intervals(lcp: np.ndarray, left: np.ndarray, least: int, extra: int = 0) -> list[tuple[int, int, int]]:
    """Maximal repeats (length, first, end) in a suffix array: the intervals that pass the left-extension test."""
    depth, first, end, diverse = scan(lcp, left, least, extra)
    return list(zip(depth[diverse].tolist(), first[diverse].tolist(), end[diverse].tolist()))


def outermost(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Indices of the intervals that lie in no other, in order."""
    order = np.lexsort((-end, first))
    return order[np.concatenate([[True], first[order][1:] >= np.maximum.accumulate(end[order])[:-1]])] if len(order) else order


def least_documents(rows: np.ndarray, low: np.ndarray, least: int, extra: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, least doc_id of the repeat group) of every passage of the rows, in order."""
    row, o, lcp, left = suffix_array(rows, least, extra)
    count = rows[:, 0].astype(np.int64) + 1
    place = (np.cumsum(count) - count)[row] + o
    depth, first, end, diverse = scan(lcp, left, least, extra)
    groups = outermost(first, end)
    depth, first, end, diverse = depth[groups], first[groups], end[groups], diverse[groups]
    # Suffixes in no interval are groups of their own.
    document, reach, begins = low[row], np.full(len(row), least + extra), np.ones(len(row), bool)
    if len(groups):
        least_of = np.minimum.reduceat(np.append(document, LAST), np.stack([first, end], 1).ravel())[::2]
        n = end - first
        inside = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        document[inside], reach[inside], begins[inside] = np.repeat(least_of, n), np.repeat(depth, n), np.repeat(diverse, n)
    out, before, new = np.empty(len(row), np.int64), np.empty(len(row), np.int64), np.empty(len(row), bool)
    out[place], before[place], new[place] = document, reach, begins
    if len(row):
        new[1:] |= before[:-1] == least  # it branches right after the passage before
        new[np.cumsum(count) - count] = True
    last = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)) if len(new) else place
    return np.repeat(np.arange(len(rows)), count), out[last]


def answers_by_bucket(own: np.ndarray, rows: np.ndarray, low: np.ndarray, least: int, extra: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Answers to contexts of several buckets (`own` of each), bucket by bucket: runs of passages of one context with one least
    doc_id.  (number of runs of each context, its first run, passages of each run, least doc_id of each)."""
    runs, begin = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    sizes, documents, base = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)], 0
    order = np.argsort(own, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], own[order][1:] != own[order][:-1], [True]])) if len(own) else order
    for a, z in zip(cut[:-1].tolist(), cut[1:].tolist()):
        at = order[a:z]
        part = rows[at]
        one, place = distinct_rows(part)
        m = np.full(len(one), LAST)
        np.minimum.at(m, place, low[at])
        row, doc = least_documents(part[one], m, least, extra)
        first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (doc[1:] != doc[:-1])]))
        n = np.bincount(row[first], minlength=len(one))
        runs[at], begin[at] = n[place], (base + np.cumsum(n) - n)[place]
        sizes.append(np.diff(np.append(first, len(row))).astype(np.uint8))
        documents.append(doc[first])
        base += len(first)
    return runs, begin, np.concatenate(sizes), np.concatenate(documents)


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket in which Spark's bucketBy puts a long: its Murmur3 hash (fixed constants) modulo the buckets."""
    u32 = np.uint32
    with np.errstate(over="ignore"):
        rot = lambda x, r: (x << u32(r)) | (x >> u32(32 - r))
        h = np.full(len(ids), 42, u32)
        raw = ids.astype(np.int64).view(np.uint64)
        for k in (raw & np.uint64(0xFFFFFFFF), raw >> np.uint64(32)):
            h = rot(h ^ (rot(k.astype(u32) * u32(0xCC9E2D51), 15) * u32(0x1B873593)), 13) * u32(5) + u32(0xE6546B64)
        h ^= u32(8)
        h = (h ^ (h >> u32(16))) * u32(0x85EBCA6B)
        h = (h ^ (h >> u32(13))) * u32(0xC2B2AE35)
        h ^= h >> u32(16)
    return h.view(np.int32).astype(np.int64) % buckets


def ids_in_bucket(task: int, buckets: int, stripe: int | None = None) -> Iterator[int]:
    """Distinct ids of a task, all of one bucket, or with `stripe` that many of one bucket and as many of the next, which lies far
    from it; all buckets have their turn."""
    stride = next(k for k in itertools.count(max(1, int(buckets * 0.618))) if math.gcd(k, buckets) == 1)
    start, bucket, left = task << 40, task % buckets, stripe
    while True:
        ids = np.arange(start, start + 16 * buckets)
        for i in ids[bucket_of(ids, buckets) == bucket].tolist():
            yield i
            if stripe:
                left -= 1
                if not left:
                    bucket, left = (bucket + stride) % buckets, stripe
                    break
        start += len(ids)


def grouped(batches: Iterator[pa.RecordBatch], key: str, columns: tuple[str, ...]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of each key, from batches sorted by it."""
    last, held = None, []
    for b in batches:
        for k, *row in zip(*[b.column(c).to_pylist() for c in (key, *columns)]):
            if k != last and held:
                yield last, held
                held = []
            last = k
            held.append(tuple(row))
    if held:
        yield last, held


def release(df: DataFrame) -> None:
    """Let Spark drop the shuffle files of finished jobs."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def page_rows(batches: Iterator[pa.RecordBatch], rest: tuple[str, ...]):
    for b in batches:
        for i in range(b.num_rows):
            ids = np.asarray(b.column("ids")[i].values)
            ends = np.cumsum(np.asarray(b.column("sizes")[i].values))
            yield b.column("page")[i].as_py(), ids, ends, np.frombuffer(b.column("data")[i].as_buffer(), np.uint8), [b.column(c)[i].as_py() for c in rest]


@dataclass
class Shared:
    """What the documents share, page by page: slim (d, doc_id, g, n_bytes, f: least d of the text), pages, bits of their
    shared anchors, both joined as marked."""

    scratch: Scratch
    slim: DataFrame
    pages: DataFrame
    bits: DataFrame
    marked: DataFrame
    buckets: int
    per: int
    spread: int
    total: int


def shared_anchors(docs: DataFrame, least: int, within: bool = False) -> Shared:
    """Anchors that two documents have, or with `within` those that are in two places."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    spread = partitions(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("g", F.unhex(F.sha2("text", 256)))
    slim = scratch.save(rows.select("d", "doc_id", "g", F.length("text").cast("long").alias("n_bytes")), "slim")
    rows_in = slim.count()
    first = slim.groupBy("g").agg(F.min("d").alias("f"))
    slim = scratch.save(slim.join(first, "g"), "first", rows_in)
    copies = scratch.save(slim.where("d > f").select(F.col("d").alias("cd"), F.col("g").alias("cg")).distinct(), "copies", rows_in)
    total = slim.where("d = f").agg(F.sum("n_bytes")).first()[0] or 0
    most, buckets, per = layout(total, spread, least)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial = ids_in_bucket(TaskContext.get().partitionId(), spread, max(1, STRIPE // most))
        held, size = [], 0

        def page():
            nonlocal held, size
            out = pa.RecordBatch.from_arrays([pa.array([next(serial)], pa.int64()), pa.array([[d for d, _, _ in held]], pa.list_(pa.int64())), pa.array([[len(t) for _, t, _ in held]], pa.list_(pa.int64())), pa.array([b"".join(g for *_, g in held)], pa.binary()), pa.array([b"".join(t for _, t, _ in held)], pa.binary())], names=["page", "ids", "sizes", "gs", "data"])
            held, size = [], 0
            return out

        for b in batches:
            for d, t, g in zip(*[b.column(c).to_pylist() for c in ("d", "text", "g")]):
                if held and size + len(t) > most:
                    yield page()
                held.append((d, t, g))
                size += len(t)
        if held:
            yield page()

    own = rows.join(maybe_broadcast(copies, copies.count()), (F.col("d") == F.col("cd")) & (F.col("g") == F.col("cg")), "left_anti").where(F.length("text") >= least)
    packed = own.select("d", "text", "g").mapInArrow(pack, "page long, ids array<long>, sizes array<long>, gs binary, data binary")
    name = f"pages_{uuid.uuid4().hex}"
    Scratch.tables.append(name)
    packed.write.bucketBy(spread, "page").option("path", f"{scratch.root}/pages").option("compression", "zstd").saveAsTable(name)
    pages = spark.table(name)

    def send_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for page, _, ends, data, _ in page_rows(batches, ()):
            _, h, _, _, doc = anchors(data, ends, least)
            u, two, back = distinct_keys(h, doc, buckets)
            if within:
                two = np.bincount(back, minlength=len(u)) > 1
            low = np.ascontiguousarray(u.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5]
            parts = list(by_bucket(u, per))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in parts], pa.int32()), pa.array([page] * len(parts), pa.int64()), pa.array([low[a:z].tobytes() for _, a, z in parts], pa.binary()), pa.array([np.packbits(two[a:z]).tobytes() for _, a, z in parts], pa.binary())], names=["bucket", "page", "keys", "two"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held in grouped(batches, "bucket", ("page", "keys", "two")):
            n = [len(k) // 5 for _, k, _ in held]
            raw = np.frombuffer(b"".join(k for _, k, _ in held), np.uint8).reshape(-1, 5)
            key = np.zeros((len(raw), 8), np.uint8)
            key[:, :5] = raw
            _, back, often = np.unique(key.view("<u8").ravel(), return_inverse=True, return_counts=True)
            shared = often > 1
            two = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=k) for (_, _, t), k in zip(held, n)]).astype(bool)
            shared[back[two]] = True
            bit = shared[back]
            cut = np.concatenate([[0], np.cumsum(n)])
            got = [(p, np.packbits(bit[a:z]).tobytes()) for (p, _, _), a, z in zip(held, cut, cut[1:]) if bit[a:z].any()]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in got], pa.int64()), pa.array([bucket] * len(got), pa.int32()), pa.array([x for _, x in got], pa.binary())], names=["page", "bucket", "bits"])

    sent = pages.select("page", "ids", "sizes", "data").mapInArrow(send_keys, "bucket int, page long, keys binary, two binary")
    bits = sent.repartition(spread, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "page long, bucket int, bits binary")
    bits = scratch.save(bits.groupBy("page").agg(F.collect_list(F.struct("bucket", "bits")).alias("bits")), "bits", total // PAGE * 2000)
    release(bits)
    marked = pages.join(bits.hint("shuffle_hash"), "page")  # bits of a page are a few kB
    return Shared(scratch, slim, pages, bits, marked, buckets, per, spread, total)


def dedup(docs: DataFrame, least: int = 50) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start:end of removed bytes, comma-joined)."""
    x = shared_anchors(docs, least)
    extra = -least % 8
    scratch, slim, pages, bits, marked, buckets, per, spread, total = x.scratch, x.slim, x.pages, x.bits, x.marked, x.buckets, x.per, x.spread, x.total

    def send_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for page, ids, ends, data, (own_bits,) in page_rows(batches, ("bits",)):
            bucket, ctx, low, *_ = shared_contexts(data, ends, ids, {x["bucket"]: x["bits"] for x in own_bits}, buckets, least, extra, per)
            parts = list(by_bucket(bucket.astype(np.uint64) << np.uint64(40), per))
            own = (bucket % per).astype("<u2")
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in parts], pa.int32()), pa.array([page] * len(parts), pa.int64()), *[pa.array([x[a:z].tobytes() for _, a, z in parts], pa.binary()) for x in (own, ctx, low)]], names=["bucket", "page", "own", "ctx", "low"])

    width = 2 * least - GRAM + 4 + extra

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held in grouped(batches, "bucket", ("page", "own", "ctx", "low")):
            own = np.frombuffer(b"".join(x for _, x, *_ in held), "<u2")
            ctx = np.frombuffer(b"".join(c for *_, c, _ in held), np.uint8).reshape(-1, width)
            low = np.frombuffer(b"".join(x for *_, x in held), np.int64)
            cut = np.cumsum([0, *(len(x) // 2 for _, x, *_ in held)])
            pages_ = [p for p, *_ in held]
            held.clear()
            runs, begin, sizes, docs_ = answers_by_bucket(own, ctx, low, least, extra)
            got = []
            for page, a, z in zip(pages_, cut, cut[1:]):
                r = runs[a:z]
                spot = np.repeat(begin[a:z] - (np.cumsum(r) - r), r) + np.arange(r.sum())
                got.append((page, r.astype(np.uint8).tobytes(), sizes[spot].tobytes(), docs_[spot].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([bucket] * len(got), pa.int32()), *[pa.array([g[j] for g in got], pa.binary()) for j in (1, 2, 3)]], names=["page", "bucket", "runs", "sizes2", "docs"])

    asked = marked.select("page", "ids", "sizes", "data", "bits").mapInArrow(send_contexts, "bucket int, page long, own binary, ctx binary, low binary")
    told = asked.repartition(spread, "bucket").sortWithinPartitions("bucket").mapInArrow(decide, "page long, bucket int, runs binary, sizes2 binary, docs binary")
    told = scratch.save(told.groupBy("page").agg(F.collect_list(F.struct("bucket", "runs", "sizes2", "docs")).alias("told")), "told", total // PAGE * 2000)
    release(told)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, ends, data, (own_bits, answers, gs) in page_rows(batches, ("bits", "told", "gs")):
            mark = np.zeros(len(data) + 1, np.int64)
            if answers:
                _, ctx, _, begin, doc, place = shared_contexts(data, ends, ids, {x["bucket"]: x["bits"] for x in own_bits}, buckets, least, extra, per)
                answers = sorted(answers, key=lambda x: x["bucket"])  # as shared_contexts sorts them
                runs = np.frombuffer(b"".join(x["runs"] for x in answers), np.uint8).astype(np.int64)
                sizes = np.frombuffer(b"".join(x["sizes2"] for x in answers), np.uint8).astype(np.int64)
                docs_ = np.frombuffer(b"".join(x["docs"] for x in answers), np.int64)
                low = np.repeat(docs_, sizes)  # of every passage of every context
                count = ctx[:, 0].astype(np.int64) + 1
                assert len(runs) == len(ctx) and len(low) == count.sum()
                base = np.cumsum(count) - count
                n = count[place]
                o = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                gone = low[np.repeat(base[place], n) + o] < np.repeat(ids[doc], n)
                t = (np.repeat(begin, n) + o)[gone]
                mark += np.bincount(t, minlength=len(mark)) - np.bincount(t + least, minlength=len(mark))
            covered = np.cumsum(mark[:-1]) > 0
            out = []
            for k, (a, z) in enumerate(zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist())):
                c = covered[a:z]
                edge = np.diff(np.concatenate([[0], c.view(np.int8), [0]]))
                s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                out.append((gs[32 * k : 32 * k + 32], int(c.sum()), len(s), hashlib.sha256(data[a:z][~c].tobytes()).hexdigest(), ",".join(f"{x}:{y}" for x, y in zip(s.tolist(), e.tolist()))))
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["rg", "n_removed", "n_spans", "kept_sha256", "spans"])

    full = pages.join(bits.join(told, "page", "left").hint("shuffle_hash"), "page", "left")
    done = full.select("page", "ids", "sizes", "data", "bits", "told", "gs").mapInArrow(remove, "rg binary, n_removed long, n_spans long, kept_sha256 string, spans string")
    done = scratch.save(done, "done").dropDuplicates(["rg"])
    # Short texts lose nothing, copies of a smaller document lose all.
    copy = (F.col("d") > F.col("f")) & (F.col("n_bytes") >= least)
    empty = hashlib.sha256(b"").hexdigest()
    out = slim.join(done, (F.col("g") == F.col("rg")), "left")
    return out.select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"), F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(empty)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("g")))).alias("kept_sha256"), F.when(copy, F.concat(F.lit("0:"), F.col("n_bytes").cast("string"))).otherwise(F.coalesce("spans", F.lit(""))).alias("spans"),
    )


def refined(rows: list[tuple[bytes, int, int]], depth: int, step: int) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Groups that agree on `depth` bytes, told apart by the next `step`: rows (bytes that follow, fewer at a text's end; byte
    to the left; group).  (order of the rows, maximal repeats of `depth` bytes or more in that order); one of depth + step bytes
    may go on."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][2], rows[i][0]))
    group = np.array([rows[i][2] for i in order])
    left = np.array([rows[i][1] for i in order])
    has = np.array([len(rows[i][0]) for i in order])
    m = np.frombuffer(b"".join(rows[i][0].ljust(step, b"\0") for i in order), np.uint8).reshape(len(rows), step)
    differ = m[1:] != m[:-1]
    equal = np.where(differ.any(1), differ.argmax(1), step)
    lcp = np.zeros(len(rows), np.int64)
    lcp[1:] = np.where(group[1:] == group[:-1], depth + np.minimum(equal, np.minimum(has[1:], has[:-1])), 0)
    return order, intervals(lcp, left, depth, step)


def repeat_groups(docs: DataFrame, least: int = 50) -> DataFrame:
    """Maximal repeats of `least` bytes or more with all their occurrences, within a text too: repeat, length, doc_id, start, a
    row each.

    One row stands for all rows of a text (the least doc_id).  Suffixes that agree on all bytes of their contexts and have
    different bytes to the left are compared further, by at most twice the depth a round, until every repeat has ended.
    `repeat` numbers them within the result.  Unlike `dedup` this sends every occurrence to its bucket, so a passage that very
    many documents hold makes a large bucket; a text of one short period has rows by the square of its length.
    """
    x = shared_anchors(docs, least, within=True)
    extra = -least % 8
    buckets, per, spread = x.buckets, x.per, x.spread
    schema = "repeat long, length long, doc_id long, start long, page long, at long, more boolean"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for page, ids, ends, data, (own_bits,) in page_rows(batches, ("bits",)):
            bucket, ctx, _, begin, doc, place = shared_contexts(data, ends, ids, {b["bucket"]: b["bits"] for b in own_bits}, buckets, least, extra, per)
            starts = np.concatenate([[0], ends[:-1]])
            yield pa.RecordBatch.from_arrays([pa.array(bucket[place].astype(np.int32)), pa.array([r.tobytes() for r in ctx[place]], pa.binary()), pa.array(ids[doc]), pa.array(begin - starts[doc]), pa.array(np.full(len(doc), page)), pa.array(begin)], names=["bucket", "ctx", "d", "start", "page", "at"])

    def told(found: list[tuple[int, int, int]], top: int, serial: Iterator[int], d, start, page, at, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
        """Rows of the intervals; of those of depth `top` it isn't known yet where they end."""
        k = 0
        while k < len(found):
            size, part = 0, []
            while k < len(found) and (not part or size < most):
                part.append(found[k])
                size += found[k][2] - found[k][1]
                k += 1
            n = np.array([z - a for _, a, z in part])
            i = np.concatenate([np.arange(a, z) for _, a, z in part])
            length = np.repeat(np.array([n for n, _, _ in part]), n)
            name = np.repeat(np.array([next(serial) for _ in part]), n)
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(length), pa.array(d[i]), pa.array(start[i]), pa.array(page[i]), pa.array(at[i]), pa.array(length == top)], names=["repeat", "length", "doc_id", "start", "page", "at", "more"])

    def serials() -> Iterator[int]:
        from pyspark import TaskContext

        return itertools.count(TaskContext.get().partitionId() << 32)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = serials()
        for _, held in grouped(batches, "bucket", ("ctx", "d", "start", "page", "at")):
            rows = np.frombuffer(b"".join(h[0] for h in held), np.uint8).reshape(len(held), -1)
            d, start, page, at = (np.array([h[j] for h in held]) for j in range(1, 5))
            row, o, lcp, left = suffix_array(rows, least, extra)
            yield from told(intervals(lcp, left, least, extra), least + extra, serial, d[row], start[row] + o, page[row], at[row] + o)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for page, held in grouped(batches, "page", ("repeat", "at")):
            yield pa.RecordBatch.from_arrays([pa.array([page], pa.int64()), *[pa.array([np.array([h[j] for h in held], np.int64).tobytes()], pa.binary()) for j in range(2)]], names=["page", "repeats", "ats"])

    def fetching(depth: int, step: int):
        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for page, ids, ends, data, (repeats, ats) in page_rows(batches, ("repeats", "ats")):
                repeat, at = np.frombuffer(repeats, np.int64), np.frombuffer(ats, np.int64)
                doc = np.searchsorted(ends, at, "right")
                starts = np.concatenate([[0], ends[:-1]])[doc]
                left = np.where(at > starts, data[at - 1].astype(np.int64), -1)
                begin = at + depth
                stop = np.minimum(begin + step, ends[doc])
                some = max(1, (1 << 22) // step)
                for a in range(0, len(at), some):
                    cut = slice(a, a + some)
                    rest = [data[b:e].tobytes() for b, e in zip(begin[cut].tolist(), stop[cut].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(repeat[cut]), pa.array(rest, pa.binary()), pa.array(left[cut]), pa.array(ids[doc[cut]]), pa.array((at - starts)[cut]), pa.array(np.full(len(rest), page)), pa.array(at[cut])], names=["repeat", "rest", "left", "d", "start", "page", "at"])

        return fetch

    def refining(depth: int, step: int):
        def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            serial = serials()

            def tell(held):
                order, found = refined([(h[0], h[1], h[-1]) for h in held], depth, step)
                yield from told(found, depth + step, serial, *(np.array([held[i][j] for i in order]) for j in range(2, 6)))

            held: list[tuple] = []  # of whole groups
            for repeat, rows in grouped(batches, "repeat", ("rest", "left", "d", "start", "page", "at")):
                if held and (len(held) + len(rows)) * step > 1 << 23:
                    yield from tell(held)
                    held = []
                held += [(*r, repeat) for r in rows]
            if held:
                yield from tell(held)

        return refine

    sent = x.marked.select("page", "ids", "sizes", "data", "bits").mapInArrow(send, "bucket int, ctx binary, d long, start long, page long, at long")
    now = x.scratch.save(sent.repartition(spread, "bucket").sortWithinPartitions("bucket", "d", "start").mapInArrow(groups, schema), "groups")
    depth, base, parts = least + extra, 0, []
    while True:
        parts.append(now.where("not more").select((F.col("repeat") + base).alias("repeat"), "length", F.when(F.col("doc_id") < LAST, F.col("doc_id")).alias("doc_id"), "start"))
        open_ = now.where("more")
        size = open_.groupBy("repeat").count().agg(F.sum("count").alias("n"), F.max("count").alias("largest")).first()
        if not size["n"]:
            break
        # A round compares 64 bytes at least; what it sends beyond that stays within the texts' size, a group within 64 MB.
        step = int(max(64, min(depth, (1 << 26) // size["largest"], max(x.total, 1 << 26) // size["n"])))
        asked = open_.select("page", "repeat", "at").repartition(spread, "page").sortWithinPartitions("page").mapInArrow(pack, "page long, repeats binary, ats binary")
        met = x.pages.select("page", "ids", "sizes", "data").join(asked.hint("shuffle_hash"), "page")
        rest = met.mapInArrow(fetching(depth, step), "repeat long, rest binary, left long, d long, start long, page long, at long")
        now = x.scratch.save(rest.repartition(spread, "repeat").sortWithinPartitions("repeat", "d", "start").mapInArrow(refining(depth, step), schema), "groups")
        release(now)
        depth, base = depth + step, base + (spread << 32)
    return functools.reduce(DataFrame.unionByName, parts)
