"""Operator 4: language identification with spans.

The script of a word (a range of code points) narrows the candidates to the languages that use that script; character
n-grams score the word for each candidate; Viterbi with a penalty for every switch labels the words of a text, so mixed
texts fall into spans.  A text's language is the one with most letters, its score that share of the letters.

`keep_identified` also asks whether a text is in a learned language at all: how likely its different words' n-grams are in the
languages they were labelled with, compared with what texts of these languages show that a model had not seen (each half of
the training documents judged by a model of the other half).  Words of a script that nobody taught count as unlikely.

Cases: texts that are null or have no letter give `und` with score 0; words without a letter take their neighbours'
label; a script nobody taught leaves all languages as candidates; ties go to the language that sorts first; rows without
a language or doc_id don't train; with nothing to learn from, every text is `und`; repeated rows are labelled alike;
other columns are not read.
"""

from __future__ import annotations

import pickle
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakfold.llm.common import bounded_batches
from peakfold.llm.words import as_strings, grams, slices, split_words

SIZES = (1, 2, 3, 4)
#: Log likelihood that a change of language between two words costs.
PENALTY = 6.0
#: First code points of script ranges (Unicode blocks); scripts not listed count as one.
SCRIPTS = [
    (0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"),
    (0x0A00, "Other"), (0x0B80, "Tamil"), (0x0C00, "Other"), (0x0E00, "Thai"), (0x0E80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Other"),
]
STARTS = np.array([a for a, _ in SCRIPTS])
NAMES = sorted({n for _, n in SCRIPTS})
SCRIPT_OF = np.array([NAMES.index(n) for _, n in SCRIPTS])


#: Script of each code point, or 254 for no letter, or 255 for not asked yet.
KIND = np.full(0x110000, 255, np.uint8)


def letters_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(letters, script) of each word; the script is that of most letters, -1 without any."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    for c in np.unique(codes[KIND[codes] == 255]).tolist():
        KIND[c] = SCRIPT_OF[max(0, np.searchsorted(STARTS, c, "right") - 1)] if chr(c).isalpha() else 254
    kind = KIND[codes]
    live = kind < 254
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])[live]
    table = np.bincount(owner * len(NAMES) + kind[live], minlength=len(words) * len(NAMES)).reshape(len(words), len(NAMES))
    n = table.sum(1)
    return n, np.where(n > 0, table.argmax(1), -1)


#: Texts that are judged, and words whose n-grams are counted, at once.
PART, WORDS = 100, 1 << 13


def bare(words: list[str]) -> list[str]:
    return [(w if w.isascii() else unicodedata.normalize("NFC", w)).lower().strip(".,;:!?\"'()[]{}") or w for w in words]


@dataclass
class Model:
    """langs: sorted; score[bucket, lang]: log probability of an n-gram less its mean over languages, base[bucket]; uses[script,
    lang]; normal: how likely the words of texts are, if known."""

    langs: list[str]
    score: np.ndarray
    uses: np.ndarray
    penalty: float
    base: np.ndarray
    normal: "Normal | None" = None

    def likely(self, words: list[str], script: np.ndarray) -> np.ndarray:
        """Mean log probability of the n-grams of every word in every language; that of nothing known for untaught scripts."""
        who, where = grams(bare(words), SIZES, len(self.score))
        n = np.bincount(who, minlength=len(words))
        if not len(words):
            return np.zeros((0, len(self.langs)))
        out = np.add.reduceat(self.score[where] + self.base[where, None], np.cumsum(n) - n, axis=0) / n[:, None]
        out[(script >= 0) & ~self.uses.any(1)[np.maximum(script, 0)]] = self.base.min()
        return out

    def word_scores(self, words: list[str], script: np.ndarray) -> np.ndarray:
        """Log likelihood ratio of every word against the mean language; ruled-out languages get a large negative score."""
        who, where = grams(bare(words), SIZES, len(self.score))
        n = np.bincount(who, minlength=len(words))  # each word has a gram: itself
        out = np.add.reduceat(self.score[where], np.cumsum(n) - n, axis=0) / np.sqrt(n)[:, None] if len(words) else np.zeros((0, len(self.langs)))
        allowed = np.where((script >= 0)[:, None], self.uses[np.maximum(script, 0)], True)
        allowed |= ~allowed.any(1, keepdims=True)
        out = np.where(allowed, out, -1e4).astype(np.float32)
        out[script < 0] = 0
        return out


@dataclass
class Normal:
    """Of words in texts of each language: mean and deviation of their likelihood; how much texts differ; the least z that stays."""

    mean: np.ndarray
    deviation: np.ndarray
    between: float
    least: float

    def z(self, owner: np.ndarray, residual: np.ndarray, texts: int) -> np.ndarray:
        """z of each text's mean over its different words; 0 without any."""
        n = np.bincount(owner, minlength=texts)
        m = np.bincount(owner, residual, minlength=texts) / np.maximum(n, 1)
        return m / np.sqrt(1 / np.maximum(n, 1) + self.between**2)


def different_words(model: Model, labels: np.ndarray, letters: np.ndarray, ends: np.ndarray, codes: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, label, likelihood) of the different words with letters of each text."""
    owner = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
    has = letters > 0
    pair = np.unique((owner[has] * len(words) + codes[has]) * len(model.langs) + labels[has])
    label, pair = pair % len(model.langs), pair // len(model.langs)
    return pair // len(words), label, model.likely(words, letters_of(words)[1])[pair % len(words), label]


def normal_of(judged: list[tuple[np.ndarray, np.ndarray, np.ndarray]], langs: int, share: float = 0.001, margin: float = 1.25, floor: float = 5.0) -> Normal:
    """judged: of texts that a model had not seen.  `share` of them may lie under the least z but for `margin`."""
    texts, label, value = (np.concatenate(x) for x in zip(*[(t + 10**9 * k, y, v) for k, (t, y, v) in enumerate(judged)]))
    n = np.maximum(np.bincount(label, minlength=langs), 1)
    mean = np.bincount(label, value, minlength=langs) / n
    deviation = np.sqrt(np.maximum(np.bincount(label, value**2, minlength=langs) / n - mean**2, 1e-6))
    _, owner = np.unique(texts, return_inverse=True)
    out = Normal(mean, deviation, 0.0, -floor)
    if len(owner):
        residual, count = (value - mean[label]) / deviation[label], np.bincount(owner)
        m = np.bincount(owner, residual) / count
        some = count >= 20
        if some.sum() >= 20:
            out.between = float(np.sqrt(max(1e-4, np.var(m[some]) - (1 / count[some]).mean())))
        out.least = min(-floor, margin * float(np.quantile(out.z(owner, residual, len(count)), share)))
    return out


def viterbi(score: np.ndarray, ends: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every word; texts advance in step, the longest first, so a step is one array operation."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    length = ends - starts
    order = np.argsort(-length, kind="stable")
    length, first = length[order], starts[order]
    label = np.zeros(len(score), np.int16)
    if not len(score):
        return label
    active = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")  # texts with more than t words
    best = score[first[: active[0]]].astype(np.float64)
    back = np.zeros(score.shape, np.int16)
    last = np.zeros(len(length), np.int64)
    own = np.arange(score.shape[1], dtype=np.int16)
    for t in range(1, length[0]):
        n = active[t]
        if n < len(best):
            last[n : len(best)] = best[n:].argmax(1)
            best = best[:n]
        top = best.argmax(1)
        switch = best[np.arange(n), top] - penalty
        stay = best >= switch[:, None]
        at = first[:n] + t
        back[at] = np.where(stay, own, top[:, None])
        best = np.where(stay, best, switch[:, None]) + score[at]
    last[: len(best)] = best.argmax(1)
    state = last.copy()
    for t in range(length[0] - 1, -1, -1):
        n = active[t]
        at = first[:n] + t
        label[at] = state[:n]
        if t:
            state[:n] = back[at, state[:n]]
    return label


def train(texts: list[str], langs: list[str], penalty: float = PENALTY, buckets: int | None = None, alpha: float = 0.5, least_share: float = 0.005) -> Model:
    """Smoothed n-gram frequencies of each language; a language uses the scripts with at least `least_share` of its letters.
    Without `buckets` there are 2^18, and fewer beyond 32 languages, so that the table keeps within 32 MB up to 512 of them."""
    names = sorted(set(langs))
    buckets = buckets or 1 << max(14, min(18, 23 - (max(1, len(names)) - 1).bit_length()))
    counts = np.zeros((buckets, len(names)), np.float64)
    scripts = np.zeros((len(NAMES), len(names)), np.float64)
    for k, lang in enumerate(names):
        codes, _, words = split_words(pa.array([t for t, x in zip(texts, langs) if x == lang], pa.large_string()))
        often = np.bincount(codes, minlength=len(words))
        for a in range(0, len(words), WORDS):
            who, where = grams(bare(words[a : a + WORDS]), SIZES, buckets)
            counts[:, k] += np.bincount(where, np.sqrt(often[a + who]), minlength=buckets)
        n, script = letters_of(words)
        np.add.at(scripts[:, k], np.maximum(script, 0), n * often)
    score = np.log((counts + alpha) / (counts.sum(0) + alpha * buckets))
    base = score.mean(1) if names else np.zeros(buckets)
    score = np.clip(score - base[:, None], -4, 4).astype(np.float32)
    return Model(names, score, scripts >= least_share * np.maximum(scripts.sum(0), 1), penalty, base.astype(np.float32))


def label_words(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(labels, letters of each word, ends, codes, words)."""
    codes, ends, words = split_words(texts)
    n, script = letters_of(words)
    if not model.langs:
        return np.zeros(len(codes), np.int16), n[codes], ends, codes, words
    return viterbi(model.word_scores(words, script)[codes], ends, model.penalty), n[codes], ends, codes, words


def predict(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, share of the letters, z of the likelihood of the words, or 0 where what is normal isn't known)."""
    labels, letters, ends, codes, words = label_words(model, texts)
    owner = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
    k = max(1, len(model.langs))
    mass = np.bincount(owner * k + labels, letters, minlength=len(ends) * k).reshape(len(ends), k)
    total = mass.sum(1)
    none = (total == 0) | (not model.langs)
    z = np.zeros(len(ends))
    if model.normal is not None and model.langs and len(words):
        text, label, value = different_words(model, labels, letters, ends, codes, words)
        z = model.normal.z(text, (value - model.normal.mean[label]) / model.normal.deviation[label], len(ends))
    return ["und" if x else model.langs[j] for x, j in zip(none, mass.argmax(1))], np.where(none, 0.0, mass.max(1) / np.maximum(total, 1)), z


def spans(model: Model, text: str | None) -> list[tuple[str, int, int]]:
    """(language, first word, end) of each maximal run of words of one language."""
    labels, letters, _, _, _ = label_words(model, pa.array([text or ""], pa.large_string()))
    if not model.langs or not letters.sum():
        return []
    cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
    return [(model.langs[labels[a]], a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def judged_by_halves(langs: list[str], rows: list[tuple[str, str]]) -> Normal:
    """rows: (language, text).  What is normal for texts of a model's languages that it hasn't seen."""
    judged = []
    for k in (0, 1):
        m = train([t for _, t in rows[k::2]], [x for x, _ in rows[k::2]])
        other = [(x, t) for x, t in rows[1 - k :: 2] if x in m.langs]
        own = np.array([langs.index(x) for x in m.langs], np.int64)
        for a in range(0, len(other), PART):  # what is looked at at once
            text, label, value = different_words(m, *label_words(m, pa.array([t for _, t in other[a : a + PART]], pa.large_string())))
            judged.append((text, own[label], value))
    return normal_of(judged, len(langs)) if judged else Normal(np.zeros(len(langs)), np.ones(len(langs)), 0.0, -np.inf)


def fit(docs: DataFrame, learn: Column, most: int, normal: bool = False, most_bytes: int = 64 << 20) -> Model:
    """Train on about `most` documents, in equal parts of each language those of the smallest hash of doc_id, in one task; rows
    that share a doc_id count once (the least language and text), and of each language at most an equal part of `most_bytes`, and
    the document that goes beyond it.  `normal`: find out what is normal for texts of the languages, too.

    Only the model comes to the driver: a table of fixed length for each language.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & learn)
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    if not counts:
        return train([], [])
    each = max(1, most // len(counts))
    # A threshold on the hash keeps about `each` rows of a language without any sort.
    limits = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, each / n))])
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    taught = known.where(u < limits[F.col("lang")]).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    taught = taught.groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("x")).select("doc_id", "x.lang", "x.text")
    before = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)  # of about `most` rows
    taught = taught.withColumn("__b", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0))).where(F.col("__b") < most_bytes // len(counts)).drop("__b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((k, i, t or "") for b in batches for i, k, t in zip(*[b.column(c).to_pylist() for c in ("doc_id", "lang", "text")]))
        m = train([t for _, _, t in rows], [k for k, _, _ in rows])
        if normal and m.langs:
            m.normal = judged_by_halves(m.langs, [(k, t) for k, _, t in rows])
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(m)]})

    got = taught.repartition(1).mapInArrow(run, "model binary").collect()  # one row, of a length given by the number of languages
    return pickle.loads(got[0]["model"]) if got else train([], [])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                lang, score, _ = predict(shared.value, as_strings(b.column("text")))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame, learn: Column, most: int = 4000) -> DataFrame:
    return identify(docs, fit(docs, learn, most))


def keep_identified(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The rows of `docs` in a learned language: with letters, one language of at least `least` of them, and words as likely as
    those of other texts of their languages.  Columns are unchanged."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bound = -np.inf if shared.value.normal is None else shared.value.normal.least
        for whole in batches:
            for b in slices(whole, "text"):
                lang, score, z = predict(shared.value, as_strings(b.column("text")))
                yield b.filter(pa.array([x != "und" and s >= least and y >= bound for x, s, y in zip(lang, score, z)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
