"""Operator 11: vectors as short codes of trained codebooks (product quantisation in whole numbers).

A vector's components become floor(256 x) and are cut into `parts` equal pieces; each piece is coded by its nearest entry of
that part's codebook.  Codebooks start as the pieces of the vectors of least ident and are trained in rounds: every Arrow
batch computes all distances by |x|^2 - 2 x c + |c|^2 with products of 64-bit integers and takes the first least one, each task adds up its
pieces by entry, and a grouped shuffle merges the tasks' sums.  The codebooks (parts x entries x width numbers, which depends
on the parameters and the vectors' length only) are what is broadcast and what comes back to the driver.

Cases: vectors that are null, or hold null or non-finite components, are left out; components of any size are exact (beyond
64 bits Python's integers take over); errors beyond 64 bits are the largest 64-bit number; a length that `parts` doesn't
divide, and vectors shorter than the longest, count as padded with zeros at the end; equal idents are told apart by their vectors;
rows without ident are coded but never start a codebook; fewer vectors than entries make a shorter codebook; an empty table
gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakfold.llm.common import Scratch, maybe_broadcast

LARGEST = 2**63 - 1
#: Sums of larger numbers travel in limbs of 40 bits.
WIDE, LIMB = 2**62, 40


def integers(x: np.ndarray) -> list[int]:
    """floor(256 x) of finite doubles of any size."""
    return [int(v) * 256 if abs(v) > 2.0**60 else math.floor(256 * v) for v in x.tolist()]


def kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, label, v, dim: v holds 32-bit integers, or decimal text where one doesn't fit; the last byte tells which."""
    for b in batches:
        lists = b.column(2)
        values, off = lists.values, np.asarray(lists.offsets).astype(np.int64)
        x = np.asarray(values.fill_null(math.nan), dtype=np.float64)
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
        fine = np.asarray(lists.is_valid()) & (bad[off[1:]] == bad[off[:-1]])
        with np.errstate(over="ignore", invalid="ignore"):
            q = np.floor(256 * x)
            large = np.concatenate([[0], np.cumsum(~(np.abs(q) < 2.0**31))])
            small = np.where(np.abs(q) < 2.0**31, q, 0).astype(np.int32)
        blobs = []
        for i in np.flatnonzero(fine).tolist():
            a, z = off[i], off[i + 1]
            blobs.append(small[a:z].tobytes() + b"i" if large[a] == large[z] else ",".join(map(str, integers(x[a:z]))).encode() + b"s")
        at = pa.array(np.flatnonzero(fine))
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(blobs, pa.binary()), pa.array((off[1:] - off[:-1])[fine].astype(np.int32))], names=["vec_id", "label", "v", "dim"])


def unpack(blobs: list[bytes], dim: int) -> np.ndarray:
    """Rows of `dim` integers: 64 bits each, or Python's where a component is larger than 32 bits."""
    if all(v[-1:] == b"i" for v in blobs):
        if all(len(v) == 4 * dim + 1 for v in blobs):
            raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), 4 * dim + 1)[:, :-1]
            return np.ascontiguousarray(raw).view(np.int32).astype(np.int64).reshape(len(blobs), dim)
        out = np.zeros((len(blobs), dim), np.int64)
    else:
        out = np.zeros((len(blobs), dim), object)
    for i, v in enumerate(blobs):
        row = np.frombuffer(v[:-1], np.int32).tolist() if v[-1:] == b"i" else [int(s) for s in v[:-1].split(b",")]
        out[i, : len(row)] = row
    return out


@dataclass
class Codebooks:
    """entries: parts x entries x width whole numbers; dim: length of the vectors they were made of."""

    entries: np.ndarray
    dim: int

    @property
    def width(self) -> int:
        return self.entries.shape[2]

    def padded(self, blobs: list[bytes]) -> np.ndarray:
        return np.pad(unpack(blobs, self.dim), ((0, 0), (0, len(self.entries) * self.width - self.dim)))

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, its squared distance) of every part of every row; the first of equally near ones."""
        books = self.entries
        most = max(int(abs(x).max(initial=0)), int(abs(books).max(initial=0)))
        if max(x.shape[1], 1) * (2 * most) ** 2 >= WIDE:
            x, books = x.astype(object), books.astype(object)
        code, error = np.zeros((len(x), len(books)), np.int64), np.zeros((len(x), len(books)), x.dtype)
        for p, c in enumerate(books):
            own = x[:, p * self.width : (p + 1) * self.width]
            d = (own * own).sum(1)[:, None] - 2 * (own @ c.T) + (c * c).sum(1)[None, :] if self.width else np.zeros((len(x), len(c)), np.int64)
            code[:, p] = d.argmin(1)
            error[:, p] = d[np.arange(len(x)), code[:, p]]
        return code, error

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(v)) for v in self.entries.ravel().tolist()).encode()).hexdigest()


def limbs(value: int) -> list[tuple[int, int]]:
    """(limb, number): the value is the sum of number << LIMB * limb."""
    if abs(value) < WIDE:
        return [(0, value)]
    sign, rest, out = (1 if value > 0 else -1), abs(value), []
    while rest:
        out.append((len(out), sign * (rest & ((1 << LIMB) - 1))))
        rest >>= LIMB
    return out


def keep(vectors: DataFrame, column: str = "embedding", ident: str = "vec_id", label: str = "label") -> DataFrame:
    """vec_id, label, v, dim of the vectors that take part."""
    kind = vectors.schema[label].dataType.simpleString()
    return vectors.select(F.col(ident).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(column).cast("array<double>").alias("v")).mapInArrow(kept_rows, f"vec_id long, label {kind}, v binary, dim int")


def train(kept: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> Codebooks | None:
    """Codebooks of the kept vectors; None if there are none."""
    spark = kept.sparkSession
    dim = kept.agg(F.max("dim")).first()[0]
    first = [r["v"] for r in kept.where("vec_id IS NOT NULL").orderBy("vec_id", "v").select("v").limit(entries).collect()]
    if dim is None or not first:
        return None
    width = -(-dim // parts)
    start = np.pad(unpack(first, dim), ((0, 0), (0, parts * width - dim)))
    books = Codebooks(np.ascontiguousarray(start.reshape(len(first), parts, width).transpose(1, 0, 2)), dim)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)  # parts x entries x width numbers

        def add_up(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            b = shared.value
            shape = b.entries.shape
            total, count = np.zeros(shape, object), np.zeros(shape[:2], np.int64)
            for batch in batches:
                x = b.padded(batch.column(0).to_pylist())
                code, _ = b.assign(x)
                safe = x.dtype != object and int(np.abs(x).max(initial=0)) * max(len(x), 1) < WIDE
                for p in range(shape[0]):
                    sums = np.zeros(shape[1:], np.int64 if safe else object)
                    np.add.at(sums, code[:, p], x[:, p * b.width : (p + 1) * b.width])
                    total[p] += sums.astype(object)
                    count[p] += np.bincount(code[:, p], minlength=shape[1])
            out = []
            for p, e in np.argwhere(count).tolist():
                out.append((p, e, -1, 0, int(count[p, e])))
                out += [(p, e, j, k, n) for j, v in enumerate(total[p, e].tolist()) for k, n in limbs(v)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate([pa.int32()] * 4 + [pa.int64()])], names=["part", "entry", "place", "limb", "n"])

        sums = kept.select("v").mapInArrow(add_up, "part int, entry int, place int, limb int, n long")
        merged = sums.groupBy("part", "entry", "place", "limb").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()  # bounded as the codebooks are
        found: dict[tuple[int, int], dict[int, int]] = {}
        for r in merged:
            own = found.setdefault((r["part"], r["entry"]), {})
            own[r["place"]] = own.get(r["place"], 0) + (int(Decimal(r["n"])) << (LIMB * r["limb"]))
        after = books.entries.astype(object)
        for (p, e), own in found.items():
            for j in range(width):
                after[p, e, j] = own[j] // own[-1]
        small = all(abs(v) < WIDE for v in after.ravel().tolist())
        books = Codebooks(after.astype(np.int64) if small else after, dim)
        shared.destroy()
    return books


def encode(kept: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error."""
    shared = kept.sparkSession.sparkContext.broadcast(books)  # parts x entries x width numbers
    kind = kept.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        for batch in batches:
            code, error = b.assign(b.padded(batch.column("v").to_pylist()))
            digits = [r.tobytes().hex() for r in code.astype(np.uint8)]
            whole = [min(int(e), LARGEST) for e in error.astype(object).sum(1).tolist()] if error.dtype == object else error.sum(1).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(digits, pa.string()), pa.array(whole, pa.int64())], names=["vec_id", "label", "code", "error"])

    return kept.mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, restored: the vectors that codes stand for, `dim` doubles each (the entries over 256); null for a null code."""
    shared = codes.sparkSession.sparkContext.broadcast(books)  # parts x entries x width numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        part = np.arange(len(b.entries))
        for batch in batches:
            given = batch.column(1).to_pylist()
            rows = [None if c is None else (b.entries[part, np.frombuffer(bytes.fromhex(c), np.uint8)].astype(np.float64).ravel()[: b.dim] / 256).tolist() for c in given]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["vec_id", "restored"])

    return codes.select("vec_id", "code").mapInArrow(run, "vec_id long, restored array<double>")


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, column: str = "embedding", ident: str = "vec_id", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error (errors added up over equal labels, rows without label together), codebooks_sha256."""
    assert entries <= 256
    scratch = Scratch(vectors.sparkSession, "codes")
    kept = scratch.save(keep(vectors, column, ident, label), "kept")
    books = train(kept, parts, entries, rounds)
    if books is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = scratch.save(encode(kept, books), "coded")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = scratch.save(coded.groupBy(F.col("label").alias("of")).agg(F.least(total, F.lit(Decimal(LARGEST))).cast("long").alias("label_error")), "sums")
    out = coded.join(maybe_broadcast(sums, sums.count()), F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
