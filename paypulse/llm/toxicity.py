"""Toxicity scores from subword-bag embeddings.

A word is the mean of the vectors of its byte n-grams and of itself, hashed into buckets; a bag of words is the mean of its
distinct words and of some neutral ones; a linear softmax gives the log-odds of label 1. Vectors and softmax are trained
together in numpy, on windows of a bounded sample of the labelled rows. An unseen misspelling shares n-gram vectors with
the words it is made of.

A text is scored by the worst of windows that overlap by half, so that a few words count in a long text too, also across a
window's end; a logistic curve, fitted on sampled
rows that the vectors were not trained on, makes that a probability. The model is linear in the words, so scoring needs one
number for each bucket: the broadcast model is of fixed size.
"""

from __future__ import annotations

import logging
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

_LOG = logging.getLogger(__name__)

BUCKETS, DIMENSIONS, GRAMS = 1 << 17, 8, (3, 4, 5)
#: At most so many labelled rows are used for training, those with the smallest hashes of their ids, and of them, in this
#: order, the ones whose texts still fit into so many characters together; others are left out. Every ``CALIBRATE``-th of them only fits the final curve.
SAMPLE_ROWS, SAMPLE_CHARS, CALIBRATE = 5000, 20_000_000, 5
#: Words of fewer sampled texts are left out of the training.
WORD_TEXTS = 2
#: Words of a window, and how many neutral words are added to its distinct ones.
WINDOW, NEUTRAL = 32, 24
EPOCHS, RATE, DECAY = 40, 0.05, 1e-3
#: N-grams of a very long word that are held at a time.
GRAM_BLOCK = 1 << 16
#: Scores are kept for so many words of a worker; beyond that the memory is cleared and filled anew.
CACHED_WORDS = 1 << 19
#: Rows with this remainder are never learnt from.
FOLDS = 5


class Model(NamedTuple):
    """``weights``: log-odds that a bucket's vector gives; score = logistic(slope * worst window + offset); ``rows``: how
    many it is made of."""

    weights: np.ndarray
    slope: float
    offset: float
    rows: int = 0


def bucket_blocks(word: bytes) -> Iterator[list[int]]:
    """Buckets of a word's n-grams, bounds included, and of the word, at most ``GRAM_BLOCK`` at a time."""
    bounded = b"<" + word + b">"
    yield [zlib.crc32(bounded) % BUCKETS]
    for n in GRAMS:
        end = len(bounded) - n + 1
        for at in range(0, end, GRAM_BLOCK):
            yield [zlib.crc32(bounded[i : i + n], n) % BUCKETS for i in range(at, min(at + GRAM_BLOCK, end))]


def buckets(word: bytes) -> np.ndarray | list[int]:
    if len(word) >= GRAM_BLOCK:
        return np.concatenate([np.array(block, np.int32) for block in bucket_blocks(word)])
    bounded = b"<" + word + b">"
    out = [zlib.crc32(bounded) % BUCKETS]
    for n in GRAMS:
        out += [zlib.crc32(bounded[i : i + n], n) % BUCKETS for i in range(len(bounded) - n + 1)]
    return out


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().split()


class _Means(NamedTuple):
    """Sparse rows that take means of other rows: entries sorted by row, and by column for the way back."""

    columns: np.ndarray
    starts: np.ndarray
    values: np.ndarray
    order: np.ndarray
    back_rows: np.ndarray
    back_starts: np.ndarray
    back_columns: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> _Means:
        rows, columns = rows.astype(np.int32), columns.astype(np.int32)
        starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        order = np.argsort(columns, kind="stable").astype(np.int32)
        back = columns[order]
        back_starts = np.flatnonzero(np.append(True, back[1:] != back[:-1]))
        return cls(columns, starts, values[:, None], order, rows[order], back_starts, back[back_starts])

    def forward(self, x: np.ndarray) -> np.ndarray:
        entries = x[self.columns]
        entries *= self.values
        return np.add.reduceat(entries, self.starts)

    def backward(self, grad: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, grad.shape[1]), grad.dtype)
        entries = grad[self.back_rows]
        entries *= self.values[self.order]
        out[self.back_columns] = np.add.reduceat(entries, self.back_starts)
        return out


def _fit_vectors(texts: list[str], labels: np.ndarray, epochs: int) -> np.ndarray:
    vocabulary: dict[bytes, int] = {}
    rows, columns, values, y = [], [], [], []
    spread = Counter(w for text in texts for w in set(words_of(text)))
    for text, label in zip(texts, labels, strict=True):
        words = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text) if spread[w] >= WORD_TEXTS]
        for at in range(0, len(words), WINDOW):
            window = np.unique(words[at : at + WINDOW])
            rows.append(np.full(len(window), len(y), np.int32))
            columns.append(window.astype(np.int32))
            values.append(np.full(len(window), 1 / (len(window) + NEUTRAL), np.float32))
            y.append(label)
    weights = np.zeros(BUCKETS, np.float32)
    if not y:
        return weights
    y = np.array(y, np.float32)
    windows = _Means.of(np.concatenate(rows), np.concatenate(columns), np.concatenate(values))
    del rows, columns, values, spread
    grams = [np.array(buckets(w), np.int32) for w in vocabulary]
    sizes = np.array([len(g) for g in grams])
    used, ids = np.unique(np.concatenate(grams), return_inverse=True)
    words = _Means.of(np.repeat(np.arange(len(grams)), sizes), ids, np.repeat(1 / sizes, sizes).astype(np.float32))
    rng = np.random.default_rng(5)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    params = [
        rng.normal(0, 0.1, (len(used), DIMENSIONS)).astype(np.float32),
        rng.normal(0, 0.3, (DIMENSIONS, 2)).astype(np.float32),
        np.log(np.array([1 - share, share], np.float32)),
    ]
    momentum = [np.zeros_like(p) for p in params]
    target = np.stack([1 - y, y], axis=1)
    # A frequent bucket's gradient sums more noise: its steps are scaled down. Else one rate holds for all of a matrix, so
    # what many windows agree on moves more than what one window needs.
    often = words.backward(windows.backward(np.ones((len(y), 1), np.float32), len(grams)), len(used))
    scales = [1 / np.sqrt(often + 1e-3 * often.max()), 1.0, 1.0]
    for epoch in range(epochs):
        vectors, softmax, bias = params
        means = windows.forward(words.forward(vectors))
        logits = means @ softmax + bias
        odds = np.exp(logits - logits.max(axis=1, keepdims=True))
        error = (odds / odds.sum(axis=1, keepdims=True) - target) / len(y)
        to_words = windows.backward(error @ softmax.T, len(grams))
        for k, grad in enumerate((words.backward(to_words, len(used)), means.T @ error, error.sum(axis=0))):
            momentum[k] += 0.1 * (grad - momentum[k])
            move = momentum[k] * scales[k]
            rate = RATE * (1 - epoch / epochs) / (np.sqrt(np.square(move).mean()) + 1e-12)
            params[k] = params[k] * (1 - DECAY) - rate * move
    vectors, softmax, _ = params
    weights[used] = vectors @ (softmax[:, 1] - softmax[:, 0])
    return weights


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps with a weak pull to a flat one; the slope isn't negative."""
    spread = x.std() or 1.0
    z = np.stack([(x - x.mean()) / spread, np.ones(len(x))], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w = np.array([0.0, np.log(share / (1 - share))])
    pull = np.diag([1e-2, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + pull @ w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + pull + 1e-9 * np.eye(2), grad)
        w -= step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
    slope = max(float(w[0] / spread), 0.0)
    return slope, float(w[1] - slope * x.mean())


class _WordScores(dict):
    def __init__(self, weights: np.ndarray) -> None:
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(word) < GRAM_BLOCK:
            out = float(self.weights[buckets(word)].mean())
        else:  # a text without blanks, which is summed in parts
            sums = [(float(self.weights[block].sum()), len(block)) for block in bucket_blocks(word)]
            out = sum(s for s, _ in sums) / sum(n for _, n in sums)
        if len(word) <= 48:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = out
        return out

    def worst(self, text: str) -> float:
        """The highest score of a window, which overlap by half; 0 for an empty text."""
        words, score, half = words_of(text), self.__getitem__, WINDOW // 2
        blocks = [set(words[at : at + half]) for at in range(0, len(words), half)]
        sums = [sum(map(score, block)) for block in blocks]
        if len(blocks) < 2:
            return sums[0] / (len(blocks[0]) + NEUTRAL) if blocks else 0.0
        best = -np.inf
        for k in range(len(blocks) - 1):
            both = blocks[k] & blocks[k + 1]
            value = sums[k] + sums[k + 1] - sum(map(score, both))
            best = max(best, value / (len(blocks[k]) + len(blocks[k + 1]) - len(both) + NEUTRAL))
        return float(best)


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS) -> Model:
    """A model of the given texts and labels; without any, one that gives each text the same low score."""
    y = np.array(labels, np.float64)
    if not len(y):
        return Model(np.zeros(BUCKETS, np.float32), 0.0, -3.0)
    held = np.arange(len(y)) % CALIBRATE == 0 if len(y) >= 10 * CALIBRATE else np.ones(len(y), bool)
    learnt = ~held if not held.all() else held
    weights = _fit_vectors([t for t, k in zip(texts, learnt, strict=True) if k], y[learnt], epochs)
    scores = _WordScores(weights)
    x = np.array([scores.worst(t) for t, k in zip(texts, held, strict=True) if k])
    return Model(weights, *_fit_curve(x, y[held]), len(y))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train_on(docs: DataFrame, labels: DataFrame) -> Model:
    """A model trained on a sample of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) marks 0 or 1."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    chosen, chars = [], 0
    sizes = texts.groupBy("doc_id").agg(F.sum(F.length("text")).alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id")
    for doc_id, size in sizes.toLocalIterator():
        if chars + size <= SAMPLE_CHARS:
            chars += size
            chosen.append(doc_id)
    if not chosen:
        return train([], [])
    kind = dict(docs.dtypes)["doc_id"]
    ids = docs.sparkSession.createDataFrame([(i,) for i in chosen], f"doc_id {kind}")
    rows = texts.join(F.broadcast(ids), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    model = train([r["text"] for r in rows], [r["toxic"] for r in rows])
    _LOG.info("toxicity learns from %d rows of %d sampled ids, %d characters", model.rows, len(chosen), chars)
    return model


def toxicity(text: Column, model: Model, df: DataFrame) -> Column:
    """The score of a text column, 0 to 1; null counts as empty."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, slope, offset, _ = shared.value
        scores = _WordScores(weights)
        for batch in batches:
            z = np.array([slope * scores.worst(t) + offset for t in batch], np.float64)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return F.pandas_udf(run, "double")(F.coalesce(text, F.lit("")))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text; null text: empty).

    Learns from rows of ``labels`` (doc_id, toxic) whose crc32 of the id is not divisible by ``FOLDS``; ids that are marked
    several times count as 1 if any is. Empty texts get the score of a neutral window. Repeated rows get equal scores,
    null ids are scored, and other columns of either table are not read. Without labels every score is low.
    """
    model = train_on(docs, labels)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity(F.col("text"), model, docs).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a score below 0.5, with all their columns."""
    model = train_on(docs, labels)
    return docs.withColumn("__score", toxicity(F.col("text"), model, docs)).where("__score < 0.5").drop("__score")
