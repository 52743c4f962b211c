"""Quality scores: random-indexing word vectors, pooled per document, and a small network.

Fitting uses a bounded sample of labelled documents. Every word of the vocabulary has a
sparse random index vector; its word vector is the sum of the index vectors of its
neighbours in the sample. A document is the mean of its word vectors. A two-layer network
in numpy turns that into a logit, and one temperature, fitted on sample rows that the
network was not trained on, makes the probabilities calibrated.

Only the vocabulary, the word vectors and the pooled sample reach the driver, all bounded
by the parameters of `Settings`. Scoring reads every document whole, in place, no shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from leakloom.llm import common

UNKNOWN, SAME, CAPS, NUMBER = "<unknown>", "<same>", "<caps>", "<number>"
SPECIAL = (UNKNOWN, SAME, CAPS, NUMBER)
_EDGE = "\"'()[]{}<>.,;:!?*#/|$%&@=+-_~^\\`"


class Settings(NamedTuple):
    sample: int = 8_000  # labelled documents that a model is fitted on, at most
    vocabulary: int = 4_096
    size: int = 64  # of a vector
    nonzero: int = 8  # of an index vector
    window: int = 2
    hidden: int = 32
    epochs: int = 60
    rate: float = 3e-3
    decay: float = 1e-4
    cache: int = 400_000  # words that a worker remembers


def parts_of(word: str) -> list[str]:
    """Tokens of a blank-separated word: its core in lower case, marks for case and numbers, runs of signs."""
    core = word.strip(_EDGE)
    at = word.find(core) if core else len(word)
    out = []
    for signs in (word[:at], word[at + len(core) :]):
        i = 0
        while i < len(signs):
            j = i + 1
            while j < len(signs) and signs[j] == signs[i]:
                j += 1
            out.append(f"{signs[i]}{min(j - i, 3)}")
            i = j
    if core:
        if core.isdigit():
            out.append(NUMBER)
        else:
            if len(core) > 1 and core.isupper():
                out.append(CAPS)
            out.append(core.lower())
    return out


def tokens_of(text: str) -> list[str]:
    """All tokens of a text in order; a word that repeats the one before adds a mark."""
    out: list[str] = []
    before = None
    for word in text.split():
        if word == before:
            out.append(SAME)
        out.extend(parts_of(word))
        before = word
    return out


def index_vectors(words: list[str], s: Settings) -> np.ndarray:
    """A sparse vector of +1 and -1 for each word, from the word alone."""
    out = np.zeros((len(words), s.size), np.int32)
    for row, word in zip(out, words):
        rng = np.random.Generator(np.random.PCG64(xxhash.xxh64_intdigest(word.encode(), 1)))
        row[rng.permutation(s.size)[: s.nonzero]] = rng.integers(0, 2, s.nonzero) * 2 - 1
    return out


def _texts(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[str]:
    for batch in batches:
        for text in batch.column(column).to_pylist():
            yield text or ""


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: Counter = Counter()
        for text in _texts(iter([batch])):
            found.update(tokens_of(text))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"]
        )


def _contexts(words: list[str], s: Settings):
    """One row for each task: the sums of its documents' context vectors, as integers."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = {w: i for i, w in enumerate(words)}
        index = index_vectors(words, s)
        sums = np.zeros((len(words), s.size), np.int64)
        for text in _texts(batches):
            seq = np.array([ids.get(w, 0) for w in tokens_of(text)], np.int64)
            for step in range(1, min(s.window, len(seq) - 1) + 1):
                a, b = np.r_[seq[:-step], seq[step:]], np.r_[seq[step:], seq[:-step]]
                order = np.argsort(a, kind="stable")
                a, b = a[order], b[order]
                starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
                sums[a[starts]] += np.add.reduceat(index[b], starts, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

    return add


class Model(NamedTuple):
    """Everything that scoring needs; about one megabyte with the default settings."""

    words: list[str]
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        hidden = np.maximum((pooled - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(pooled) / self.temperature, -40, 40)))


class Pooler:
    """Means of word vectors; a text's tokens are looked up word by word, with a bounded memory."""

    def __init__(self, words: list[str], vectors: np.ndarray, cache: int):
        self._ids = {w: i for i, w in enumerate(words)}
        self._vectors = vectors
        self._known: dict[str, bytes] = {}
        self._cache = cache

    def _look_up(self, words: list[str]) -> np.ndarray:
        known = self._known
        try:
            found = b"".join(map(known.__getitem__, words))
        except KeyError:
            if len(known) > self._cache:
                known.clear()
            for w in set(words):
                if w not in known:
                    known[w] = np.array([self._ids.get(p, 0) for p in parts_of(w)], np.int32).tobytes()
            found = b"".join(map(known.__getitem__, words))
        return np.frombuffer(found, np.int32)

    def __call__(self, text: str) -> np.ndarray:
        words = text.split()
        ids = self._look_up(words)
        same = sum(map(eq, words, words[1:]))
        if not len(ids):
            return np.zeros(self._vectors.shape[1])
        counts = np.bincount(ids, minlength=len(self._vectors)).astype(np.float64)
        counts[1] += same
        used = np.flatnonzero(counts)
        return counts[used] @ self._vectors[used] / counts[used].sum()


def _pooled(words: list[str], vectors: np.ndarray, cache: int):
    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Pooler(words, vectors, cache)
        for batch in batches:
            rows = [of(t).tolist() for t in _texts(iter([batch]))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), batch.column("place"), pa.array(rows, pa.list_(pa.float64()))],
                names=["label", "place", "pooled"],
            )

    return pool


def _train(x: np.ndarray, y: np.ndarray, s: Settings) -> tuple:
    """Adam on the logistic loss; a fixed seed, so equal samples give equal networks."""
    rng = np.random.Generator(np.random.PCG64(5))
    prior = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
    p = [rng.normal(0, (2 / s.size) ** 0.5, (s.size, s.hidden)), np.zeros(s.hidden),
         rng.normal(0, s.hidden**-0.5, s.hidden), np.array(np.log(prior / (1 - prior)))]
    if not len(y):
        p[2] = np.zeros(s.hidden)
    m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for _ in range(s.epochs):
        order = rng.permutation(len(y))
        for low in range(0, len(y), 128):
            xb, yb = x[order[low : low + 128]], y[order[low : low + 128]]
            hidden = np.maximum(xb @ p[0] + p[1], 0)
            error = (1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3], -40, 40))) - yb) / len(yb)
            back = np.outer(error, p[2]) * (hidden > 0)
            t += 1
            for i, g in enumerate((xb.T @ back, back.sum(0), hidden.T @ error, error.sum())):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - s.rate * (m[i] / (1 - 0.9**t) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8) + s.decay * p[i])
    return p[0], p[1], p[2], float(p[3])


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the smallest log loss, by golden section on its logarithm; 1 without rows.

    Targets are drawn in by one row of each class, so that separable rows give no certainty.
    """
    if not len(y):
        return 1.0
    y = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))

    def loss(log_t: float) -> float:
        z = np.clip(logits / np.exp(log_t), -40, 40)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    low, high, ratio = -2.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(50):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """A model of label (0 or 1) from docs (doc_id, text) and labels (doc_id, label).

    The sample is the s.sample labelled ids with the smallest hash; that many rows are
    broadcast to find their texts. Labels other than 0 and 1 and null ids are ignored, an
    id with several labels takes the largest, one with several rows its smallest text. Without
    labelled documents all scores are 0.5.
    """
    usable = labels.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    place = F.xxhash64(F.col("doc_id").cast("string"), F.lit("quality"))
    chosen = usable.select("doc_id", "label", place.alias("place")).orderBy("place", "doc_id").limit(s.sample)
    held = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = held.groupBy("doc_id", "label", "place").agg(F.min("text").alias("text"))  # ids may repeat
    sample = common.saved(one, "quality-sample")
    counts = sample.select("text").mapInArrow(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.where(~F.col("word").isin(*SPECIAL) & (F.col("n") > 1)).orderBy(F.desc("n"), "word").limit(s.vocabulary - len(SPECIAL))
    words = [*SPECIAL, *(r["word"] for r in top.collect())]
    sums = np.zeros((len(words), s.size), np.int64)
    for row in sample.select("text").coalesce(8).mapInArrow(_contexts(words, s), "sums binary").collect():
        sums += np.frombuffer(row["sums"], np.int64).reshape(sums.shape)
    vectors = sums.astype(np.float64)
    bare = ~vectors.any(axis=1)
    vectors[bare] = index_vectors(words, s)[bare]
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    # What all words share says nothing about one document.
    vectors -= vectors.mean(axis=0)
    pooled = sample.select("label", "place", "text").mapInArrow(
        _pooled(words, vectors, s.cache), "label int, place long, pooled array<double>"
    )
    rows = sorted(pooled.collect(), key=lambda r: (r["place"], r["label"], r["pooled"]))
    x = np.array([r["pooled"] for r in rows], np.float64).reshape(-1, s.size)
    y = np.array([r["label"] for r in rows], np.float64)
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(s.size), np.ones(s.size))
    held = np.arange(len(y)) % 5 == 4
    x = (x - mean) / scale
    w1, b1, w2, b2 = _train(x[~held], y[~held], s)
    model = Model(words, vectors, mean, scale, w1, b1, w2, b2, 1.0)
    return model._replace(temperature=_temperature(model.logits(x[held] * scale + mean), y[held]))


def score(model: Model, text: Column, s: Settings = Settings()) -> Column:
    """The probability of label 1 for a text; null and empty texts are documents without words."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = Pooler(model.words, model.vectors, s.cache)
        for texts in batches:
            pooled = np.array([of(t or "") for t in texts.to_pylist()]).reshape(-1, model.vectors.shape[1])
            yield pa.array(model.probabilities(pooled))

    return scored(text.cast("string"))
