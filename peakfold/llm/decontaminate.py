"""Operator 2: benchmark decontamination by greedy string tiling.

Texts are words in lower case without punctuation at their ends.  Documents and benchmark items meet in the hash join of
their `seed`-word runs.  Each pair whose seeds could cover enough of the item is tiled by running Karp-Rabin: a round hashes
all unmarked runs of one length in item and document, a search over lengths finds the longest that both have, its matches are
compared word by word and marked in both where they overlap no earlier one, and the next round looks at what is left unmarked,
while a match has `seed` words.  Tiles may lie in any order, so an item whose sentences were moved about is still covered.  A
document is contaminated by an item if tiles cover at least `threshold` of the item's words.

The benchmark is the side that is broadcast, in blocks of at most BLOCK_BYTES of text, one after the other; a larger benchmark
takes more passes, never a larger broadcast.  A document's tiling is its own task's work: no shuffle, no group.

Cases: null and empty texts match nothing; an item of fewer than `seed` words is one run of all its words, to be found as a
whole with word boundaries, if these have `short` characters or more (24 unless told otherwise, for whole passages of scripts
without spaces; 0 takes every item, and then an item of one common word contaminates what holds that word), and else takes no part; an
item without words takes none; equal items, or rows, each give their own result; ties between matches go to the first place in the item,
then in the document; rows with a null doc_id are judged like others; other columns stay as they are.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakfold.llm.common import Scratch, bounded_batches, maybe_broadcast
from peakfold.llm.words import as_strings, slices, split_words

BLOCK_BYTES = 8 << 20
SHORT = 24
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def bare(word: str) -> str:
    return word.lower().strip(".,;:!?\"'()[]{}") or word


class Rolling:
    """Karp-Rabin hashes of the runs of ids, of any length at once from prefix sums (modulo 2^64, so powers have inverses)."""

    def __init__(self, ids: np.ndarray):
        n = len(ids) + 1
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, BASE)]))
        self.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, INVERSE)]))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * MIX * power[:-1])])

    def runs(self, n: int) -> np.ndarray:
        """Hash of the run of n ids from every place."""
        if len(self.sums) <= n:
            return np.zeros(0, np.uint64)
        h = (self.sums[n:] - self.sums[:-n]) * self.inverse[: len(self.sums) - n]
        return h ^ (h >> np.uint64(31))


@dataclass
class Items:
    """ids: words of each item as numbers; seeds: sorted hashes of seed runs, with item and position of each, by run length."""

    names: list
    ids: list[np.ndarray]
    vocabulary: dict[str, int]
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    seed: int


def index_items(names: list, texts: list[str], seed: int, short: int = SHORT) -> Items:
    vocabulary: dict[str, int] = {}
    ids, keep = [], []
    codes, ends, words = split_words(pa.array(texts, pa.large_string()))
    known = np.array([vocabulary.setdefault(bare(w), len(vocabulary)) for w in words], np.int64)
    for name, a, z in zip(names, np.concatenate([[0], ends[:-1]]).tolist() if len(ends) else [], ends.tolist()):
        if z - a >= seed or (z > a and sum(len(words[c]) for c in codes[a:z]) >= short):
            keep.append(name)
            ids.append(known[codes[a:z]])
    seeds = {}
    for n in sorted({min(seed, len(x)) for x in ids}):
        at = [i for i, x in enumerate(ids) if min(seed, len(x)) == n]
        hashes = [Rolling(ids[i]).runs(n) for i in at]
        h, item, place = np.concatenate(hashes), np.repeat(at, [len(x) for x in hashes]), np.concatenate([np.arange(len(x)) for x in hashes])
        order = np.argsort(h, kind="stable")
        seeds[n] = h[order], item[order], place[order]
    return Items(keep, ids, vocabulary, seeds, seed)


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: (item start, document start, length), longest first."""
    out = []
    own, other = Rolling(item), Rolling(doc)
    marked, gone = np.zeros(len(item) + 1, np.int64), np.zeros(len(doc) + 1, np.int64)  # marks before each place

    def unmarked(r: Rolling, marks: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(marks[n:] == marks[:-n])
        return at, r.runs(n)[at]

    def common(n: int) -> bool:
        return bool(np.isin(unmarked(own, marked, n)[1], unmarked(other, gone, n)[1]).any())

    longest = min(len(item), len(doc))
    while longest >= least and common(least):
        low, high = least, longest  # of the longest run that both have
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if common(middle) else (low, middle - 1)
        at, h = unmarked(own, marked, low)
        there, g = unmarked(other, gone, low)
        order = np.argsort(g, kind="stable")
        begin, end = np.searchsorted(g[order], h, "left"), np.searchsorted(g[order], h, "right")
        found, skip = 0, {}  # skip: how many of the document's places of a hash are used up
        taken, used = np.zeros(len(item) + 1, bool), np.zeros(len(doc) + 1, bool)
        for i, x, z in zip(at[end > begin].tolist(), begin[end > begin].tolist(), end[end > begin].tolist()):
            if taken[i] or taken[i + low - 1]:
                continue
            k = skip.get(x, x)
            while k < z:
                d = int(there[order[k]])
                if not (used[d] or used[d + low - 1]):
                    if np.array_equal(item[i : i + low], doc[d : d + low]):
                        break
                k += 1
            skip[x] = k
            if k < z:
                out.append((i, d, low))
                taken[i : i + low], used[d : d + low] = True, True
                found += 1
        marked += np.concatenate([[0], np.cumsum(taken[:-1])])
        gone += np.concatenate([[0], np.cumsum(used[:-1])])
        longest = low if found else low - 1
    return out


def matches(index: Items, codes: np.ndarray, ends: np.ndarray, words: list[str], threshold: float) -> list[tuple[int, int, float, list[tuple[int, int, int]]]]:
    """(text, item, coverage, tiles) of every pair at or above the threshold."""
    if not index.seeds or not len(codes):
        return []
    ids = np.array([index.vocabulary.get(bare(w), -1) for w in words], np.int64)[codes]
    starts = np.concatenate([[0], ends[:-1]])
    rolling, known = Rolling(ids), np.concatenate([[0], np.cumsum(ids >= 0)])
    lengths = np.array([len(x) for x in index.ids])
    out = []
    for n, (seeds, item, place) in index.seeds.items():
        at = np.flatnonzero(known[n:] - known[:-n] == n)
        owner = np.searchsorted(ends, at, "right")
        at, owner = (x[at + n <= ends[owner]] for x in (at, owner))
        # The different seeds of each text, and where items have them.
        h = rolling.runs(n)[at]
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]) if len(h) else np.zeros(0, bool)
        h, owner = h[new], owner[new]
        a, b = np.searchsorted(seeds, h, "left"), np.searchsorted(seeds, h, "right")
        n_each = b - a
        spot = np.repeat(a - (np.cumsum(n_each) - n_each), n_each) + np.arange(n_each.sum())
        text, which, where = np.repeat(owner, n_each), item[spot], place[spot]
        # What no tiling can cover needs no tiling: words under seeds, of each pair.
        order = np.lexsort((where, which, text))
        text, which, where = text[order], which[order], where[order]
        same = (text[1:] == text[:-1]) & (which[1:] == which[:-1])
        cover = np.full(len(text), n, np.int64)
        cover[1:][same] = np.minimum(where[1:] - where[:-1], n)[same]
        first = np.flatnonzero(np.concatenate([[True], ~same])) if len(text) else np.zeros(0, np.int64)
        under = np.add.reduceat(cover, first) if len(first) else cover
        for k in first[under >= threshold * lengths[which[first]]].tolist() if len(first) else []:
            t, i = int(text[k]), int(which[k])
            got = tiles(ids[starts[t] : ends[t]], index.ids[i], n)
            share = sum(x[2] for x in got) / len(index.ids[i])
            if got and share >= threshold:
                out.append((t, i, share, got))
    return sorted(out, key=lambda x: x[:2])


def blocks(bench: DataFrame, seed: int, short: int = SHORT) -> tuple[int, Iterator[Items]]:
    """The benchmark's items in blocks of about BLOCK_BYTES, each small enough to broadcast: their number, and one by one."""
    items = bench.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    n = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))

    def made() -> Iterator[Items]:
        for k in range(n):
            rows = sorted(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect(), key=lambda r: (r["item_id"] is None, r["item_id"], r["text"]))
            yield index_items([r["item_id"] for r in rows], [r["text"] for r in rows], seed, short)

    return n, made()


def contaminated(docs: DataFrame, bench: DataFrame, seed: int = 5, threshold: float = 0.5, short: int = SHORT) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles, tiles ("item start:document start:words", comma-joined): a row for each pair."""
    schema = "doc_id long, item_id long, coverage double, n_tiles int, tiles string"
    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def search(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                ids = b.column("doc_id").to_pylist()
                found = matches(shared.value, *split_words(as_strings(b.column("text"))), threshold)
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[t] for t, *_ in found], pa.int64()), pa.array([shared.value.names[i] for _, i, *_ in found], pa.int64()), pa.array([c for _, _, c, _ in found], pa.float64()),
                    pa.array([len(g) for *_, g in found], pa.int32()), pa.array([",".join(f"{i}:{d}:{n}" for i, d, n in sorted(g)) for *_, g in found], pa.string()),
                ], names=["doc_id", "item_id", "coverage", "n_tiles", "tiles"])

    return by_blocks(given, bench, seed, search, schema, short)


def by_blocks(given: DataFrame, bench: DataFrame, seed: int, search: Callable, schema: str, short: int = SHORT) -> DataFrame:
    """What `search` finds in `given`, block by block of the benchmark.  Of several blocks each is searched, its result is written
    and its index is let go before the next one is made."""
    spark = given.sparkSession
    bounded_batches(spark)
    n, made = blocks(bench, seed, short)
    scratch, parts = Scratch(spark, "decontaminate"), []
    for index in made:
        shared = spark.sparkContext.broadcast(index)  # bounded by BLOCK_BYTES
        part = given.mapInArrow(functools.partial(search, shared), schema)
        if n == 1:
            return part
        parts.append(scratch.save(part, "part"))
        shared.destroy()
    return functools.reduce(DataFrame.unionByName, parts)


def decontaminate(docs: DataFrame, bench: DataFrame, seed: int = 5, threshold: float = 0.5, short: int = SHORT) -> DataFrame:
    """The rows of docs that no item contaminates; columns unchanged."""
    bounded_batches(docs.sparkSession)
    n, made = blocks(bench, seed, short)
    bad = lambda shared, b: {t for t, *_ in matches(shared.value, *split_words(as_strings(b.column("text"))), threshold)}

    if n == 1:
        shared = docs.sparkSession.sparkContext.broadcast(next(made))  # bounded by BLOCK_BYTES

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in slices(whole, "text"):
                    gone = bad(shared, b)
                    yield b.filter(pa.array([i not in gone for i in range(b.num_rows)], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)

    # With several blocks the texts to drop are written by their digests, block by block, and then left out.
    def search(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                yield b.select(["__g"]).take(pa.array(sorted(bad(shared, b)), pa.int64()))

    digest = F.sha2(F.col("text").cast("binary"), 256)
    gone = by_blocks(docs.select(digest.alias("__g"), F.col("text").cast("string").alias("text")), bench, seed, search, "__g string", short).distinct()
    return docs.withColumn("__h", digest).join(maybe_broadcast(gone, gone.count()), F.col("__h") == F.col("__g"), "left_anti").drop("__h")
