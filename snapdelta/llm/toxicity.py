"""Toxicity: embeddings of words and character n-grams, averaged into a linear softmax.

A word's vector is the mean of the vectors of its hash buckets (the word and its n-grams of
3 to 7 bytes), a bag's the mean over its words. Buckets and softmax start at random and are trained
together in numpy by full-batch Adam: first on the averages of whole texts, then on the averages of
the words of each document that the model finds worst, beside random words of clean documents. A
misspelt word shares most n-grams with the word it is meant for, and n-grams that the training never
saw don't count. Toxic words are few in a long text and vanish in its average, so a text's score is
that of the bag of its three worst words, found among all its words, and calibrated on documents
that the training didn't use. As the softmax is linear, a bucket's whole effect is one number, so
that scoring is a table lookup.

All text counts; null and empty texts get the calibrated score of the bare bias. Ties, repeated
rows, an empty table and extra columns change nothing for the other rows. Held-out, null or
unmatched labels never reach the training; without both classes the score is the smoothed share.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .shared import arrow_map, fit_in_one_task, held_out, labelled_sample, read_table, text_buffer
from .subword import grams, means, vocabulary, word_scores

#: Words whose vectors are averaged: the worst of a text.
PASSAGE = 3
BITS = 19
#: Size of the softmax's weights while whole texts are averaged.
GAIN = 1000.0


@dataclass
class Toxicity:
    table: np.ndarray  # a bucket's part in the log odds
    bias: float
    slope: float
    shift: float
    bits: int = BITS

    def raw(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        s, w = word_scores(data, offsets, self.table, self.bits, known=True)
        return worst(s, w.first)[0] + self.bias

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(data, offsets) + self.shift, -30, 30)))


def worst(s: np.ndarray, first: np.ndarray, width: int = PASSAGE) -> tuple[np.ndarray, list[np.ndarray]]:
    """Mean of the `width` highest scores of each document (of all, if it has fewer; 0 without words), and where they are."""
    best, at = np.zeros(len(first) - 1), []
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        k = np.arange(a, b) if b - a <= width else a + np.argpartition(s[a:b], b - a - width)[b - a - width :]
        if b > a:
            best[i] = s[k].mean()
        at.append(k)
    return best, at


class _Trainer:
    """Full-batch Adam on bucket vectors and softmax for rows that are weighted bags of words."""

    def __init__(self, bucket: np.ndarray, first: np.ndarray, dims: int, rate: float, decay: float, seed: int, size: int):
        r = np.random.default_rng(seed)
        self.bucket, self.first, self.size = bucket, first, np.diff(first)
        self.owner = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)
        self.e = (r.standard_normal((size, dims)) * 0.01).astype(np.float32)
        sign = np.sign(r.standard_normal((dims, 1))) / np.sqrt(dims)
        self.w = (sign * np.array([[-0.5, 0.5]]) * GAIN).astype(np.float32)
        self.b = np.zeros(2, np.float32)
        self.begin(rate, decay)

    def begin(self, rate: float, decay: float) -> None:
        self.rate, self.decay, self.t = rate, decay, 0
        self.moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.e, self.w, self.b)]

    def rescale(self) -> None:
        """From averages of whole texts to those of a few words: softmax of usual size, word effects of deviation 1/2."""
        self.w /= GAIN
        self.b[:] = 0
        z, _ = self.effect()
        self.e *= 0.5 / max(float(np.std(z[self.bucket])), 1e-9)

    def words(self) -> np.ndarray:
        """One dimension at a time, so that memory stays a few numbers for each bucket of a word."""
        return np.column_stack([means(self.e[self.bucket, k], self.first) for k in range(self.e.shape[1])])

    def step(self, row: np.ndarray, word: np.ndarray, weight: np.ndarray, y: np.ndarray, importance: np.ndarray) -> None:
        n, d = len(y), self.e.shape[1]
        vectors = self.words()
        h = np.column_stack([np.bincount(row, vectors[word, k] * weight, n) for k in range(d)]).astype(np.float32)
        logits = h @ self.w + self.b
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), y] -= 1
        p *= (importance / importance.sum())[:, None]
        back = p @ self.w.T
        m = len(self.size)
        by_word = np.column_stack([np.bincount(word, back[row, k] * weight, m) for k in range(d)]) / self.size[:, None]
        g = np.column_stack([np.bincount(self.bucket, by_word[self.owner, k], len(self.e)) for k in range(d)])
        self.t += 1
        for i, (value, grad) in enumerate(((self.e, g), (self.w, h.T @ p), (self.b, p.sum(axis=0)))):
            first, second = self.moments[i]
            first += 0.1 * (grad - first)
            second += 0.01 * (grad * grad - second)
            value -= self.rate * (first / (1 - 0.9**self.t)) / (np.sqrt(second / (1 - 0.99**self.t)) + 1e-8 + self.decay * np.abs(second).max() ** 0.5)

    def effect(self) -> tuple[np.ndarray, float]:
        return self.e @ (self.w[:, 1] - self.w[:, 0]), float(self.b[1] - self.b[0])


def platt(raw: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton steps, on smoothed labels."""
    scale = float(np.std(raw)) or 1.0
    x = raw / scale
    pos = y.sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (len(y) - pos + 2))
    v = np.array([1.0, 0.0])
    a = np.column_stack([x, np.ones(len(x))])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ v, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (t - p) - 1e-3 * v)
        v += np.clip(step, -2, 2)
    return float(v[0] / scale), float(v[1])


def _known(bucket: np.ndarray, first: np.ndarray, unknown: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket lists without the unknown bucket; a word that has no other keeps one of it."""
    keep = bucket < unknown
    none = np.add.reduceat(keep, first[:-1], dtype=np.int64) == 0
    keep[first[:-1][none]] = True
    return bucket[keep], np.concatenate([[0], np.cumsum(np.add.reduceat(keep, first[:-1], dtype=np.int64))])


def fit(data: np.ndarray, offsets: np.ndarray, y: np.ndarray, dims: int = 4, whole: int = 20, rounds: int = 40, rate: float = 0.05, decay: tuple[float, float] = (0.03, 0.3), least: int = 4, bits: int = BITS, seed: int = 5) -> Toxicity:
    """Joint training on texts with labels, `whole` rounds on whole texts and `rounds` on bags; buckets in fewer than `least` documents stay 0."""
    share = (y.sum() + 1) / (len(y) + 2)
    nothing = Toxicity(np.zeros(1 << bits, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))), bits)
    w, number, s, e = vocabulary(data, offsets)
    if len(y) == 0 or y.min() == y.max() or len(s) == 0:
        return nothing
    r = np.random.default_rng(seed)
    fold = r.permutation(len(y)) % 5 == 0
    if min(np.bincount(y[fold], minlength=2).min(), np.bincount(y[~fold], minlength=2).min()) == 0:
        fold[:] = False
    doc = w.doc()
    pair, counts = np.unique(doc * np.int64(len(s)) + number, return_counts=True)
    pair_doc, pair_word = pair // len(s), pair % len(s)
    bucket, first = grams(w.data, s, e, bits)
    size = np.diff(first)
    in_docs = np.bincount(pair_word, minlength=len(s))
    spread = np.bincount(bucket, np.repeat(in_docs, size), 1 << bits)
    used = np.flatnonzero(spread >= least)
    if len(used) == 0:
        return nothing
    dense = np.full(1 << bits, len(used), np.int32)
    dense[used] = np.arange(len(used))
    bucket, first = _known(dense[bucket], first, len(used))
    t = _Trainer(bucket, first, dims, rate, decay[0], seed, len(used) + 1)
    use = ~fold
    weigh = lambda labels: np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum()))
    share = counts / np.maximum(w.counts, 1)[pair_doc]
    importance = np.zeros(len(y))
    importance[use] = weigh(y[use])
    for _ in range(whole):
        t.step(pair_doc, pair_word, share, y, importance)
        t.e[len(used)] = 0
    t.rescale()
    t.begin(rate, decay[1])
    docs = np.flatnonzero(use & (w.counts > 0))
    clean = docs[y[docs] == 0]
    for k in range(rounds):
        if k % 4 == 0:
            z, _ = t.effect()
            _, top = worst(means(z[t.bucket], t.first)[number], w.first)
            other = [w.first[i] + r.integers(0, w.counts[i], PASSAGE) for i in clean.tolist()]
            bags = [top[i] for i in docs.tolist()] + other
            of, n = np.concatenate([docs, clean]), np.array([len(x) for x in bags])
            row, word = np.repeat(np.arange(len(of)), n), number[np.concatenate(bags)]
        t.step(row, word, 1 / n[row], y[of], weigh(y[of]))
        t.e[len(used)] = 0
    z, bias = t.effect()
    table = np.zeros(1 << bits, np.float32)
    table[used] = z[: len(used)]
    m = Toxicity(table, bias, 1.0, 0.0, bits)
    m.slope, m.shift = platt(m.raw(data, offsets)[fold if fold.any() else use], y[fold if fold.any() else use])
    return m


def train(spark: SparkSession, sf_dir: str, documents: DataFrame, rows: int = 3000) -> Toxicity:
    """Fit on at most `rows` labelled documents outside the held-out fold (and SAMPLE_BYTES of text), in one task; the driver gets the table."""
    return fit_in_one_task(labelled_sample(spark, sf_dir, documents, "toxic", rows), fit)


def score(docs: DataFrame, model: Toxicity, threshold: float = 0.5) -> DataFrame:
    def make():
        def work(part):
            s = model.score(*text_buffer(part.column("text")))
            return {"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "score": s, "predicted": (s >= threshold).astype(np.int32)}

        return work

    return arrow_map(docs.select("doc_id", "text", held_out().alias("held_out")), "doc_id long, held_out boolean, score double, predicted int", make)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score(docs, train(spark, sf_dir, docs))
