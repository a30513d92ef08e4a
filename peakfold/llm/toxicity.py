"""Operator 1: toxicity by a subword bag.

A word is the mean of the vectors of its character n-grams and of itself; a window of words is the sum of its words over
the window's length; a linear softmax over two classes reads the window.  Vectors and softmax are trained together in
numpy, so a misspelling nobody has seen shares most of its vectors with the word it imitates.  A document's score is that
of its most toxic window.  A toxic document need not be toxic throughout: after each
round, only those windows of toxic documents that the model finds most toxic train on.

Scores are calibrated on training documents that the model at hand has not seen: each half of them is judged by a model of
the other half.  A logistic curve gives the slope, and the cut (0.7) is put where precision and recall of these judgements
balance best (the largest F score, recall counting BETA times), so the score at the cut is a decision, not a probability.

Cases: null and empty texts, and those without words, have the lowest score; null labels don't train; of several labels of
a document the highest counts; with no labels, or of one kind only, every document gets that share as its score; repeated rows are
scored alike, each on its own, and train once; of several texts of a doc_id one trains; a null doc_id is never labelled or
held out; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakfold.llm.common import bounded_batches
from peakfold.llm.words import as_strings, grams, slices, split_words

SIZES = (3, 4, 5)
#: How many times recall counts in choosing the cut.
BETA = 1.2
LEAST = -50.0


@dataclass
class Model:
    """theta: what a bucket adds to the log odds of a window (vectors times softmax); slope and offset: calibration."""

    theta: np.ndarray
    window: int
    slope: float
    offset: float

    def word_values(self, words: list[str]) -> np.ndarray:
        who, where = grams(plain(words), SIZES, len(self.theta))
        n = np.maximum(np.bincount(who, minlength=len(words)), 1)
        return np.bincount(who, self.theta[where], minlength=len(words)) / n

    def evidence(self, codes: np.ndarray, ends: np.ndarray, words: list[str]) -> np.ndarray:
        """Log odds of each text's most toxic window, without the bias; the least for texts without words."""
        best, at = best_windows(self.word_values(words)[codes], ends, self.window)
        return np.where(at < 0, LEAST, np.maximum(best, LEAST))

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.offset, -40, 40)))


def plain(words: list[str]) -> list[str]:
    """Lower case, without punctuation at the ends (a word of punctuation stays as it is)."""
    return [w.lower().strip(".,;:!?\"'()[]{}") or w for w in words]


def best_windows(values: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(largest sum over window, its start) of each text; a shorter text is one window; an empty one is 0 at -1."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    total = np.concatenate([[0.0], np.cumsum(values)])
    best, at = np.zeros(len(ends)), np.full(len(ends), -1, np.int64)
    n = ends - starts
    short = (n > 0) & (n <= window)
    best[short] = (total[ends[short]] - total[starts[short]]) / window
    at[short] = starts[short]
    long = np.flatnonzero(n > window)
    if len(long):
        sums = (total[window:] - total[:-window]) / window
        edges = np.stack([starts[long], ends[long] - window + 1], 1).ravel()
        padded = np.append(sums, -np.inf)
        best[long] = np.maximum.reduceat(padded, edges)[::2]
        for i in long:  # the first window that has it
            a, b = starts[i], ends[i] - window + 1
            at[i] = a + int(np.argmax(sums[a:b]))
    return best, at


def train(texts: list[str], labels: np.ndarray, share: float, window: int = 6, dim: int = 8, buckets: int = 1 << 18, rounds: int = 3, steps: int = 400, batch: int = 512, seed: int = 1, least_docs: int = 6) -> Model:
    """share: of toxic documents among all labelled ones; the sample may have another.  Buckets that fewer than `least_docs`
    documents have stay 0, or the model would know documents by their rare words.  Not calibrated."""
    prior = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    if not len(texts) or labels.min() == labels.max():
        return Model(np.zeros(buckets, np.float32), window, 1.0, prior if len(texts) else 0.0)
    codes, ends, words = split_words(pa.array(texts, pa.large_string()))
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    rng = np.random.default_rng(seed)
    emb = (rng.random((buckets, dim), dtype=np.float32) - 0.5) / dim
    out = (rng.random((dim, 2), dtype=np.float32) - 0.5).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen = np.full(buckets, 1e-4, np.float32)
    seen_out, seen_bias = np.full((dim, 2), 1e-4, np.float32), np.full(2, 1e-4, np.float32)
    who, where = grams(plain(words), SIZES, buckets)
    first = np.searchsorted(who, np.arange(len(words) + 1))
    spread = np.zeros(buckets, np.int64)
    for a, z in zip(starts.tolist(), ends.tolist()):
        w = np.unique(codes[a:z])
        n = first[w + 1] - first[w]
        spread[np.unique(where[np.repeat(first[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())])] += 1
    live = spread >= least_docs
    emb[~live] = 0
    toxic, clean = np.flatnonzero((labels == 1) & (ends > starts)), np.flatnonzero((labels == 0) & (ends > starts))
    if not len(toxic) or not len(clean):
        return Model(np.zeros(buckets, np.float32), window, 1.0, prior)
    chosen = None
    for k in range(rounds):
        for _ in range(steps):
            half = batch // 2
            y = np.repeat([1, 0], [half, batch - half])
            docs = np.concatenate([rng.choice(toxic, half), rng.choice(clean, batch - half)])
            room = np.maximum(ends[docs] - starts[docs] - window, 0)
            begin = starts[docs] + (rng.random(batch) * (room + 1)).astype(np.int64)
            if chosen is not None:
                # half of the clean windows are the ones the model likes least
                hard = np.arange(batch) < half + (batch - half) // 2
                begin = np.where(hard & (chosen[docs] >= 0), chosen[docs], begin)
            stop = np.minimum(begin + window, ends[docs])
            length = stop - begin
            own = np.repeat(np.arange(batch), length)
            flat = np.repeat(begin - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
            w, of = np.unique(codes[flat], return_inverse=True)
            n = first[w + 1] - first[w]
            gram = where[np.repeat(first[w] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
            cut = np.concatenate([[0], np.cumsum(n)[:-1]])
            vec = np.add.reduceat(emb[gram], cut, axis=0) / n[:, None]
            bag = np.zeros((batch, dim), np.float32)
            for d in range(dim):
                bag[:, d] = np.bincount(own, vec[of, d], minlength=batch) / window
            z = bag @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(batch), y] -= 1
            g_bag = (p @ out.T) / window
            g_vec = np.stack([np.bincount(of, g_bag[own, d], minlength=len(w)) for d in range(dim)], 1) / n[:, None]
            g_gram = np.repeat(g_vec, n, axis=0).astype(np.float32)
            gram, g_gram = gram[live[gram]], g_gram[live[gram]]
            u, back = np.unique(gram, return_inverse=True)
            g = np.stack([np.bincount(back, g_gram[:, d], minlength=len(u)) for d in range(dim)], 1).astype(np.float32)
            seen[u] += (g * g).mean(1)
            emb[u] -= 0.3 * (g / np.sqrt(seen[u])[:, None] + 1e-4 * emb[u])
            g_out, g_bias = bag.T @ p / batch, p.mean(0)
            seen_out += g_out**2
            seen_bias += g_bias**2
            out -= 0.1 * g_out / np.sqrt(seen_out)
            bias -= 0.1 * g_bias / np.sqrt(seen_bias)
        model = Model((emb @ (out[:, 1] - out[:, 0])).astype(np.float32), window, 1.0, prior)
        evidence, chosen = best_windows(model.word_values(words)[codes], ends, window)
    return model


def calibrated(model: Model, evidence: np.ndarray, labels: np.ndarray, share: float, threshold: float) -> Model:
    """evidence: of documents that the model's kind had not seen.  Each class is weighted to its true share."""
    if not len(labels) or labels.min() == labels.max():
        return model
    weight = np.where(labels == 1, share / max(1, (labels == 1).sum()), (1 - share) / max(1, (labels == 0).sum()))
    centre, scale = evidence.mean(), evidence.std() + 1e-9
    x = (evidence - centre) / scale
    a, b = 1.0, float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        g = np.array([(weight * (p - labels) * x).sum() + 1e-4 * a, (weight * (p - labels)).sum()])
        v = weight * p * (1 - p)
        h = np.array([[(v * x * x).sum() + 1e-4, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        a, b = max(a - step[0], 1e-6), b - step[1]
    # The largest F score is flat, so the cut is the middle of those within 2 % of it, half way to the next document below.
    order = np.argsort(-evidence, kind="stable")
    e, w = evidence[order], weight[order]
    hits = np.cumsum(w * labels[order])
    f = np.where(np.append(e[1:] < e[:-1], True), hits / (np.cumsum(w) + BETA**2 * share), 0)
    k = int(np.median(np.flatnonzero(f >= 0.98 * f.max())))
    cut = (e[k] + e[min(k + 1, len(e) - 1)]) / 2
    slope = float(a / scale)
    return Model(model.theta, model.window, slope, float(np.log(threshold / (1 - threshold)) - slope * cut))


def half_of(doc_id: int) -> int:
    return zlib.crc32(f"half {doc_id}".encode()) % 2


def taught(docs: DataFrame, labels: DataFrame, learn: Column, most_per_class: int, most_bytes: int) -> tuple[DataFrame, float]:
    """(doc_id, text, y of the documents to train on; share of toxic documents among the labelled ones)."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    marks = marks.where(learn & F.col("y").isin(0, 1)).withColumn("h", F.xxhash64("doc_id"))
    counts = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a label
    n = counts.get(0, 0) + counts.get(1, 0)
    share = counts.get(1, 0) / n if n else 0.5
    picked = None
    for y in (0, 1):
        part = marks.where(F.col("y") == y).orderBy("h", "doc_id").limit(most_per_class)
        picked = part if picked is None else picked.unionByName(part)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # One text of each doc_id, at most 2 * most_per_class of them; then as many as stay within most_bytes.
    sized = given.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "h", "y").agg(F.min(F.struct(F.xxhash64("text").alias("t"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("b"))).alias("r"))
    upto = Window.partitionBy("y").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = sized.withColumn("upto", F.sum("r.b").over(upto)).where(F.col("upto") <= most_bytes).select("doc_id", "y", F.col("r.t").alias("t"))
    out = given.join(F.broadcast(sized), "doc_id").where(F.xxhash64("text") == F.col("t")).dropDuplicates(["doc_id"])
    return out, share


def fit(docs: DataFrame, labels: DataFrame, learn: Column, most_per_class: int, most_bytes: int, threshold: float) -> Model:
    """Train on at most `most_per_class` documents and `most_bytes` of text of each label, chosen by a hash of doc_id: one task
    trains on all, two on a half each.

    Only models and evidence, of bounded size, come to the driver.
    """
    rows_in, share = taught(docs, labels, learn, most_per_class, most_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((i, t or "", y, k) for b in batches for i, t, y, k in zip(*[b.column(c).to_pylist() for c in ("doc_id", "text", "y", "fold")]))
        for k in sorted({r[3] for r in rows}):
            own = [r for r in rows if r[3] == k]
            side = [k == 2 or half_of(r[0]) == k for r in own]
            m = train([r[1] for r, x in zip(own, side) if x], np.array([r[2] for r, x in zip(own, side) if x], np.int64), share)
            unseen = [r for r, x in zip(own, side) if not x]
            e = m.evidence(*split_words(pa.array([r[1] for r in unseen], pa.large_string()))) if unseen else np.zeros(0)
            yield pa.RecordBatch.from_pydict({"fold": [k], "theta": [m.theta.tobytes() if k == 2 else b""], "window": [m.window], "slope": [m.slope], "offset": [m.offset], "evidence": [e.tobytes()], "labels": [np.array([r[2] for r in unseen], np.int64).tobytes()]})

    folds = rows_in.withColumn("fold", F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)]))).select("doc_id", "text", "y", "fold")
    got = folds.repartitionById(3, F.col("fold").cast("int")).mapInArrow(run, "fold long, theta binary, window long, slope double, offset double, evidence binary, labels binary").collect()
    if not got:
        return train([], np.zeros(0, np.int64), share)
    whole = next(r for r in got if r["fold"] == 2)
    evidence, y = (np.concatenate([np.frombuffer(r[c], kind) for r in sorted(got, key=lambda r: r["fold"])]) for c, kind in (("evidence", np.float64), ("labels", np.int64)))
    return calibrated(Model(np.frombuffer(whole["theta"], np.float32), whole["window"], whole["slope"], whole["offset"]), evidence, y, share, threshold)


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted of every row."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for b in slices(whole, "text"):
                s = m.scores(m.evidence(*split_words(as_strings(b.column("text")))))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(score, "doc_id long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, learn: Column, most_per_class: int = 2000, most_bytes: int = 64 << 20, threshold: float = 0.7) -> DataFrame:
    """Train on the labelled documents for which `learn` holds (a condition on doc_id), score all."""
    return score_documents(docs, fit(docs, labels, learn, most_per_class, most_bytes, threshold), threshold)
