"""Distinct words of a slice and the hash buckets of their character n-grams."""

from __future__ import annotations

import numpy as np

from .words import LOWER, _BYTE, Words, factors, find_words, mix

SIZES = (3, 4, 5, 6, 7)


def vocabulary(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words of lower-cased texts: the words, the number of each in the vocabulary, and its byte bounds."""
    w = find_words(LOWER[data], offsets)
    _, first, number = np.unique(w.hashes(), return_index=True, return_inverse=True)
    return w, number, w.starts[first], w.ends[first]


def grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word: the word itself, then its byte n-grams between end marks. Also where each word's begin."""
    n = len(starts)
    lengths = ends - starts + 2
    at = np.cumsum(lengths) - lengths
    total = int(lengths.sum())
    place = np.arange(total) - np.repeat(at, lengths)
    source = place - 1 + np.repeat(starts, lengths)
    marked = np.where(place == 0, 1, np.where(place == np.repeat(lengths, lengths) - 1, 2, data[np.clip(source, 0, len(data) - 1)]))
    values = _BYTE[marked]
    f = factors(max(16, int(lengths.max()) if n else 16))
    left = np.repeat(lengths, lengths) - place
    whole = mix(np.add.reduceat(values * f[place], at) + np.uint64(1)) if n else np.zeros(0, np.uint64)
    word = np.repeat(np.arange(n, dtype=np.int32), lengths)
    buckets, owners = [(whole >> np.uint64(64 - bits)).astype(np.int32)], [np.arange(n, dtype=np.int32)]
    for size in SIZES:
        if total < size:
            continue
        m = total - size + 1
        h = np.full(m, size, np.uint64)
        for k in range(size):
            h += values[k : k + m] * f[k + 3]
        ok = left[:m] >= size
        buckets.append((mix(h[ok]) >> np.uint64(64 - bits)).astype(np.int32))
        owners.append(word[:m][ok])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    bucket = np.concatenate(buckets)[order]
    return bucket, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])


def means(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean of each run of `values`; runs are not empty."""
    return np.add.reduceat(values, first[:-1], axis=0) / np.diff(first).astype(values.dtype)[(...,) + (None,) * (values.ndim - 1)] if len(first) > 1 else values[:0]


def word_scores(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, bits: int, known: bool = False) -> tuple[np.ndarray, Words]:
    """For each word of the slice the mean of `table` over its buckets, or over those that are not 0."""
    w, number, s, e = vocabulary(data, offsets)
    if len(s) == 0:
        return np.zeros(0), w
    bucket, first = grams(w.data, s, e, bits)
    values = table[bucket].astype(np.float64)
    if known:
        return (np.add.reduceat(values, first[:-1]) / np.maximum(np.add.reduceat(values != 0, first[:-1], dtype=np.int64), 1))[number], w
    return means(values, first)[number], w
