"""Quality rules: fixed base rules, then a hashed logistic regression with calibrated output.

Base rules count words, symbols, repeated lines and repeated five-word windows of the whole
text. The model is a logistic regression on the mean, over all words of a text, of its hashed
word and character n-gram indicators; it is trained on labelled quality rows outside the
held-out fold and calibrated by a logistic curve on a part that the training didn't use. Arrow
batches are scored against fixed thresholds.

Null and empty texts have no words and fail the base rules. Repeated rows repeat, ties get the
same verdict, an empty table gives an empty result, extra columns are ignored. Without both
classes every text gets the smoothed share of label 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .shared import arrow_map, fit_in_one_task, labelled_sample, read_table, text_buffer
from .stats import base_counts
from .subword import grams, means, vocabulary, word_scores
from .toxicity import platt

BITS = 18
#: Fixed thresholds.
MIN_WORDS, REPEAT_PERCENT, KEEP = 10, 20, 0.3


@dataclass
class RuleModel:
    table: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    bits: int = BITS

    def raw(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        s, w = word_scores(data, offsets, self.table, self.bits)
        c = np.concatenate([[0.0], np.cumsum(s)])
        return (c[w.first[1:]] - c[w.first[:-1]]) / np.maximum(w.counts, 1) + self.bias

    def probability(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(data, offsets) + self.shift, -30, 30)))


def fit(data: np.ndarray, offsets: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.5, ridge: float = 1e-6, bits: int = BITS, seed: int = 6) -> RuleModel:
    """Full-batch gradient steps with a common step scale, so that rare buckets stay near 0."""
    share = (y.sum() + 1) / (len(y) + 2)
    m = RuleModel(np.zeros(1 << bits), 0.0, 1.0, float(np.log(share / (1 - share))), bits)
    w, number, s, e = vocabulary(data, offsets)
    if len(y) == 0 or y.min() == y.max() or len(s) == 0:
        return m
    fold = np.random.default_rng(seed).permutation(len(y)) % 5 == 0
    if min(np.bincount(y[fold], minlength=2).min(), np.bincount(y[~fold], minlength=2).min()) == 0:
        fold[:] = False
    pair, counts = np.unique(w.doc() * np.int64(len(s)) + number, return_counts=True)
    doc, word = pair // len(s), pair % len(s)
    weight = counts / np.maximum(w.counts, 1)[doc]
    bucket, first = grams(w.data, s, e, bits)
    size = np.diff(first)
    owner = np.repeat(np.arange(len(size)), size)
    n = len(y)
    importance = np.where(y == 1, 0.5 / max(1, y[~fold].sum()), 0.5 / max(1, (1 - y[~fold]).sum())) * ~fold
    speed = np.zeros_like(m.table)
    scale = 0.0
    for _ in range(rounds):
        x = np.bincount(doc, means(m.table[bucket], first)[word] * weight, n) + m.bias
        g = (y - 1 / (1 + np.exp(-np.clip(x, -30, 30)))) * importance
        step = np.bincount(bucket, (np.bincount(word, g[doc] * weight, len(size)) / size)[owner], len(m.table)) - ridge * m.table
        scale = scale or float(np.abs(step).max()) or 1.0
        speed = 0.9 * speed + step
        m.table += rate * speed / scale
        m.bias += rate * g.sum()
    part = fold if fold.any() else ~fold
    m.slope, m.shift = platt(m.raw(data, offsets)[part], y[part])
    return m


def train(spark: SparkSession, sf_dir: str, documents: DataFrame, rows: int = 3000) -> RuleModel:
    """Fit on at most `rows` labelled documents outside the held-out fold (and SAMPLE_BYTES of text), in one task."""
    return fit_in_one_task(labelled_sample(spark, sf_dir, documents, "quality", rows), fit)


def judge(docs: DataFrame, model: RuleModel, keep: float = KEEP) -> DataFrame:
    """Counts, base verdict, calibrated probability and verdict of every row of `docs`."""

    def make():
        def work(part):
            data, offsets = text_buffer(part.column("text"))
            c = base_counts(data, offsets)
            failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > REPEAT_PERCENT * c["n_words"])
            p = model.probability(data, offsets)
            names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
            return {"doc_id": part.column("doc_id"), "base_failed": failed, "kept": ~failed & (p >= keep), "probability": p} | {k: c[k] for k in names}

        return work

    return arrow_map(docs.select("doc_id", "text"), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double", make)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return judge(docs, train(spark, sf_dir, docs))
