"""Operator 12: ranked lexical search over compressed postings, a document at a time.

Documents are indexed where they lie: a shard is a run of a task's documents of about SHARD bytes of text, its documents in
the order of doc_id, and a term's postings are the gaps between the places of its documents and its occurrences there, both as
variable-length bytes.  A search merges an item's lists in a shard with a heap of cursors, so that a document's score is
complete when the merge leaves it, and keeps the best in a bounded heap by (score, smaller doc_id).  Lists whose greatest
gains together can't reach the worst of the kept scores aren't merged but asked for the documents that the other lists
name, which changes no result.  A task's shards share an item's heap; the tasks' heaps meet in one window.

A term's weight and a document's length factor come from the document counts of the index, over all documents.  Items are
broadcast in blocks of about BLOCK bytes of text, one after the other; a larger set of items takes more passes over the
index, which is written once.

Cases: null texts and texts without a term are no documents, null items and items of unknown terms have no results; every row of documents is a
document, equal rows too; every row of items is an item of its own, with its own ranks; equal scores go to the smaller
doc_id, and a null doc_id comes last; an empty table gives an empty result; other columns are not read.  A task's memory is its
largest shard's; one text larger than SHARD is a shard of its own.
"""

from __future__ import annotations

import functools
import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakfold.llm.common import Scratch, partitions
from peakfold.llm.words import as_strings, split_words

SHARD, BLOCK = 8 << 20, 8 << 20
#: Stands for a null doc_id, after all others.
LAST = 2**63 - 1
#: Bytes that are part of a term, in lower case; all others end one.
LETTERS = np.full(256, 0x20, np.uint8)
LETTERS[0x30:0x3A], LETTERS[0x61:0x7B], LETTERS[0x80:] = np.arange(0x30, 0x3A), np.arange(0x61, 0x7B), np.arange(0x80, 0x100)
LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)


def term_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(codes, ends, terms): codes of all terms in order, end of each text in codes, and the distinct terms."""
    texts = pa.concat_arrays([texts])  # buffers of their own, from offset 0
    _, offsets, data = texts.buffers()
    low = LETTERS[np.frombuffer(data, np.uint8)] if data is not None else np.zeros(0, np.uint8)
    return split_words(pa.LargeStringArray.from_buffers(len(texts), offsets, pa.py_buffer(low.tobytes())))


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, end of each number in them): seven bits a byte, least first, the high bit on all bytes of a number but its last."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        size += v >> np.uint64(7 * k) > 0
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        live = size > k
        out[(ends - size)[live] + k] = ((v[live] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | ((size[live] > k + 1).astype(np.uint8) << 7)
    return out, ends


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128) + 1
    starts = np.concatenate([[0], ends[:-1]])[: len(ends)]
    out = np.zeros(len(ends), np.uint64)
    for k in range(int((ends - starts).max(initial=0))):
        live = ends - starts > k
        out[live] |= (raw[starts[live] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return out


def shard_rows(ids: np.ndarray, texts: pa.Array, shard: int) -> pa.RecordBatch | None:
    """Index rows of one shard: for each term its document frequency and postings, and under a null term the documents."""
    order = np.argsort(ids, kind="stable")
    codes, ends, words = term_codes(texts.take(pa.array(order)))
    size = np.diff(np.concatenate([[0], ends]))
    live = np.flatnonzero(size)
    if not len(live):
        return None
    place = np.cumsum(size > 0) - 1
    key, tf = np.unique(codes * len(live) + np.repeat(place, size), return_counts=True)
    term, doc = key // len(live), key % len(live)
    gap = doc.copy()
    same = term[1:] == term[:-1]
    gap[1:][same] -= doc[:-1][same]
    data, at = pack(np.stack([gap, tf], 1).ravel())
    last = np.concatenate([np.flatnonzero(~same), [len(term) - 1]])
    held = ids[order][live]
    steps = np.diff(held.view(np.uint64), prepend=np.uint64(0))  # modulo 2^64; ids ascend
    own, _ = pack(np.stack([steps, size[live].astype(np.uint64)], 1).ravel())
    cut = at[2 * last + 1]
    blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cut), [None, pa.py_buffer(np.concatenate([[0], cut]).astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())
    df = np.diff(np.concatenate([[-1], last]))
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(len(df) + 1, shard, np.int64)), pa.array([None, *[words[t] for t in term[last].tolist()]], pa.string()), pa.array(np.concatenate([[len(live)], df])),
        pa.array(np.concatenate([[int(size.sum())], np.zeros(len(df), np.int64)])), pa.concat_arrays([pa.array([own.tobytes()], pa.binary()), blobs]),
    ], names=["shard", "term", "df", "tokens", "postings"])


def index(docs: DataFrame, ident: str = "doc_id", column: str = "text") -> DataFrame:
    """shard, term, df, tokens, postings; the row of a null term holds a shard's documents: their number in df, their terms in tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal ids, texts, held, serial
            rows = shard_rows(np.concatenate(ids), pa.concat_arrays(texts), serial) if ids else None
            ids, texts, held, serial = [], [], 0, serial + 1
            if rows is not None:
                for a in range(0, rows.num_rows, 1 << 14):
                    yield rows.slice(a, 1 << 14)

        for b in batches:
            text = as_strings(b.column(1))
            own = np.asarray(pc.fill_null(b.column(0), LAST)).astype(np.int64)
            ends = np.cumsum(np.asarray(pc.binary_length(text)).astype(np.int64))
            a = 0
            while a < len(own):
                base = int(ends[a - 1]) if a else 0
                z = max(a + 1, int(np.searchsorted(ends, base + SHARD - held, "right")))
                ids.append(own[a:z])
                texts.append(text.slice(a, z - a))
                held += int(ends[z - 1]) - base
                a = z
                if held >= SHARD or a < len(own):
                    yield from flush()
        yield from flush()

    return docs.select(F.col(ident).cast("long"), F.col(column).cast("string")).mapInArrow(run, "shard long, term string, df long, tokens long, postings binary")


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


@dataclass
class Block:
    """Items of a block: row, item_id and terms of each; weight of each known term; documents and terms of the whole index."""

    items: list[tuple[int, int | None, list[str]]]
    weights: dict[str, int]
    n: int
    tokens: int


def factors(sizes: np.ndarray, n: int, tokens: int) -> np.ndarray:
    """100 - 90 + (90 size n) div tokens of each document."""
    if 90 * int(sizes.max(initial=0)) * n < 2**63:
        return 10 + (90 * n * sizes) // tokens
    return np.array([10 + (90 * n * int(s)) // tokens for s in sizes.tolist()], np.int64)


class Postings:
    """A term's list in a shard: places of documents, gain of each, the greatest gain, and the k-th greatest (0 if fewer)."""

    __slots__ = ("places", "gains", "most", "kth")

    def __init__(self, data: bytes, weight: int, factor: np.ndarray, k: int):
        raw = unpack(data).reshape(-1, 2).astype(np.int64)
        place, tf = np.cumsum(raw[:, 0]), raw[:, 1]
        gain = weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * factor[place]))
        self.places, self.gains, self.most = place.tolist(), gain.tolist(), int(gain.max())
        self.kth = int(np.partition(gain, -k)[-k]) if len(gain) >= k else 0


def merge(lists: list[Postings], ids: list[int], best: list[tuple[int, int]], k: int) -> None:
    """Put the best documents of a shard into the heap `best` of (score, -doc_id).

    The lists stand in the order of their greatest gains; those from `own` on have cursors in the merge, those before it
    are asked for the documents that the merge names.
    """
    lists = sorted(lists, key=lambda x: x.most)
    reach = np.concatenate([[0], np.cumsum([x.most for x in lists])]).tolist()  # of the lists before each
    # k documents have the k-th gain of any list at least, and so have the kept ones.
    floor = max([x.kth for x in lists] + [best[0][0] if len(best) == k else 1, 1])
    at = [0] * len(lists)
    own = 0
    while own < len(lists) and reach[own + 1] < floor:
        own += 1
    cursors = [(lists[j].places[0], j) for j in range(own, len(lists))]
    heapq.heapify(cursors)
    while cursors:
        place = cursors[0][0]
        score = 0
        while cursors and cursors[0][0] == place:
            j = cursors[0][1]
            x = lists[j]
            score += x.gains[at[j]]
            at[j] += 1
            if at[j] < len(x.places):
                heapq.heapreplace(cursors, (x.places[at[j]], j))
            else:
                heapq.heappop(cursors)
        j = own
        while j and score + reach[j] >= floor:
            j -= 1
            x = lists[j]
            at[j] = i = bisect_left(x.places, place, at[j])
            if i < len(x.places) and x.places[i] == place:
                score += x.gains[i]
        if j or score < floor:
            continue  # the other lists can't bring it up
        found = (score, -ids[place])
        if len(best) < k:
            heapq.heappush(best, found)
        elif found > best[0]:
            heapq.heapreplace(best, found)
        else:
            continue
        if len(best) == k and best[0][0] > floor:
            floor, before = best[0][0], own
            while own < len(lists) and reach[own + 1] < floor:
                own += 1
            if own > before:
                cursors = [c for c in cursors if c[1] >= own]
                heapq.heapify(cursors)


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, dict[str, bytes]]]:
    """(documents, postings by term) of each shard, from rows sorted by (shard, term)."""
    now, docs, lists = None, b"", {}
    for b in batches:
        for shard, term, data in zip(*[b.column(c).to_pylist() for c in ("shard", "term", "postings")]):
            if shard != now and now is not None:
                yield docs, lists
                lists = {}
            now = shard
            if term is None:
                docs = data
            else:
                lists[term] = data
    if now is not None:
        yield docs, lists


def search(shared, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block: Block = shared.value
    best: list[list[tuple[int, int]]] = [[] for _ in block.items]
    by_term: dict[str, list[int]] = {}
    for i, (_, _, terms) in enumerate(block.items):
        for t in terms:
            if block.weights.get(t, 0) > 0:
                by_term.setdefault(t, []).append(i)
    for docs, packed in shards(batches):
        pairs = unpack(docs).reshape(-1, 2)
        ids = np.cumsum(pairs[:, 0]).view(np.int64).tolist()  # modulo 2^64, as they were written
        factor = factors(pairs[:, 1].astype(np.int64), block.n, block.tokens)
        asked: dict[int, list[Postings]] = {}
        for term, data in packed.items():
            if term in by_term:
                x = Postings(data, block.weights[term], factor, k)
                for i in by_term[term]:
                    asked.setdefault(i, []).append(x)
        for i, lists in asked.items():
            merge(lists, ids, best[i], k)
    out = [(block.items[i][0], block.items[i][1], None if -d == LAST else -d, s) for i, heap in enumerate(best) for s, d in heap]
    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(4)], names=["row", "item_id", "doc_id", "score"])


def item_terms(items: DataFrame, ident: str = "item_id", column: str = "text") -> DataFrame:
    """row, item_id, terms (distinct), n_bytes of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, ends, words = term_codes(as_strings(b.column(2)))
            cut = np.concatenate([[0], ends]).astype(np.int64)
            rows = [[words[c] for c in np.unique(codes[a:z]).tolist()] for a, z in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.list_(pa.string())), pa.array([sum(map(len, r)) for r in rows], pa.int64())], names=["row", "item_id", "terms", "n_bytes"])

    rows = items.select(F.monotonically_increasing_id().alias("row"), F.col(ident).cast("long").alias("item_id"), F.col(column).cast("string").alias("text"))
    return rows.mapInArrow(run, "row long, item_id long, terms array<string>, n_bytes long")


def rank(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item, with a score above 0."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ranking")
    whole = scratch.save(index(docs), "index")
    asked = scratch.save(item_terms(items), "items")
    total = whole.where("term IS NULL").agg(F.sum("df").alias("n"), F.sum("tokens").alias("t")).first()
    size = asked.agg(F.sum("n_bytes")).first()[0] or 0
    parts = []
    many = max(1, -(-size // block_bytes))
    for b in range(many) if total["n"] else ():
        mine = asked.where(F.pmod(F.xxhash64("row"), F.lit(many)) == b)
        terms = mine.select(F.explode("terms").alias("term")).distinct()
        # What a block holds is bounded by its bytes: items, their terms, a number for each.
        slim = whole.join(F.broadcast(terms), "term", "left_semi")
        known = {r["term"]: weight(total["n"], r["df"]) for r in slim.groupBy("term").agg(F.sum("df").alias("df")).collect()}
        rows = sorted((r["row"], r["item_id"], r["terms"]) for r in mine.select("row", F.coalesce("item_id", F.lit(LAST)).alias("item_id"), "terms").collect())
        shared = spark.sparkContext.broadcast(Block([(r, None if i == LAST else i, t) for r, i, t in rows], known, total["n"], total["t"]))
        lists = slim.select("shard", "term", "postings").unionByName(whole.where("term IS NULL").select("shard", "term", "postings"))
        dealt = lists.repartition(partitions(spark), "shard").sortWithinPartitions("shard", "term")
        found = dealt.mapInArrow(functools.partial(search, shared, k), "row long, item_id long, doc_id long, score long")
        if many == 1:
            parts.append(found)
        else:
            parts.append(scratch.save(found, "found"))
            shared.destroy()
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    by = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return functools.reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
