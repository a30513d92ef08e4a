"""Words of whole texts, column-wise: Arrow splits and dictionary-encodes, numpy hashes the distinct words only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Longest piece of a word whose character n-grams are hashed at once; longer words are cut into such pieces.
PIECE = 32


def as_strings(column) -> pa.Array:
    """One large_string array without nulls."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.fill_null(a.cast(pa.large_string()), "")


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(codes, ends, words): codes of all words in order, end of each text in codes, and the distinct words.

    Words are runs of bytes other than space and \\x09-\\x0D.
    """
    parts = pc.ascii_split_whitespace(texts)
    ends = np.asarray(parts.offsets)[1:].astype(np.int64) - parts.offsets[0].as_py()
    coded = parts.flatten().dictionary_encode()
    codes, words = np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_pylist()
    if "" in words:  # white space at the start or end of a text leaves an empty word
        keep = codes != words.index("")
        ends = np.concatenate([[0], np.cumsum(keep)])[ends]
        codes = codes[keep]
    return codes, ends, words


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20):
    """Cut a batch so that the texts of a slice have about `most` bytes; a longer text is a slice of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    group = np.cumsum(sizes) // most
    at = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *at.tolist()], [*at.tolist(), len(sizes)]):
        if b > a:
            yield batch.slice(a, b - a)


def code_matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of "<word>", zero-padded; words of over PIECE characters become several rows.  (matrix, word of row)."""
    rows, owner = [], []
    for i, w in enumerate(words):
        if len(w) <= PIECE:
            rows.append(f"<{w}>")
            owner.append(i)
        else:
            marked = f"<{w}>"
            for a in range(0, len(marked), PIECE):
                rows.append(marked[a : a + PIECE + 2])
                owner.append(i)
    if not rows:
        return np.zeros((0, PIECE + 2), np.uint32), np.zeros(0, np.int64)
    m = np.array(rows, dtype=f"U{PIECE + 2}").view(np.uint32).reshape(len(rows), PIECE + 2)
    return m, np.array(owner)


def grams(words: list[str], sizes: tuple[int, ...], buckets: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every character n-gram of the words and of each word as a whole, by word; memory by chunks."""
    chunk = 1 << 15
    parts = [_grams(words[a : a + chunk], sizes, buckets, whole) for a in range(0, len(words), chunk)]
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate([w + np.int32(i * chunk) for i, (w, _) in enumerate(parts)]), np.concatenate([b for _, b in parts])


def _grams(words: list[str], sizes: tuple[int, ...], buckets: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    m, owner = code_matrix(words)
    m = m.astype(np.uint64)
    width = (m != 0).sum(1)
    who, where = [], []
    for n in sizes:
        h = np.zeros((len(m), m.shape[1] - n + 1), np.uint64)
        for k in range(n):
            h = (h ^ m[:, k : k + h.shape[1]]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        r, c = np.nonzero(np.arange(h.shape[1])[None, :] + n <= width[:, None])
        who.append(owner[r])
        where.append(((h[r, c] + np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)) % np.uint64(buckets))
    if whole:
        h = np.zeros(len(m), np.uint64)
        for k in range(m.shape[1]):
            h = (h ^ m[:, k]) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(31)
        who.append(owner)
        where.append((h >> np.uint64(7)) % np.uint64(buckets))
    who, where = np.concatenate(who).astype(np.int32), np.concatenate(where).astype(np.int32)
    order = np.argsort(who, kind="stable")  # a radix sort on 32 bits
    return who[order], where[order]
