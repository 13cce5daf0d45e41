"""Words of many texts at once: numpy over the UTF-8 bytes of a slice of rows.

A word is a run of bytes outside 0x20 and 0x09-0x0D; no byte of a multi-byte UTF-8
sequence lies there, so bytes and code points give the same words. Hashes are 64 bits
wide, from the bytes and the length, mixed; long runs sum a random table entry for each
byte, times a random odd factor for its place. Two different words collide with a chance
near 2**-60.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_WORD = ~_SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


_HALF, _ODD = np.uint64(32), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits; every input bit reaches every output bit."""
    x = np.asarray(x, np.uint64)
    x = x ^ (x >> _HALF)
    x *= _ODD
    x ^= x >> _HALF
    x *= _ODD
    x ^= x >> _HALF
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_EIGHT = np.uint64(0x9FB21C651E98DF25)
_factors = np.zeros(0, np.uint64)


def factors(n: int) -> np.ndarray:
    """A random odd factor for each of the first `n` places."""
    global _factors
    if len(_factors) < n:
        size = max(64, 1 << (n - 1).bit_length())
        _factors = mix(np.arange(7, 7 + size, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) | np.uint64(1)
    return _factors


@dataclass
class Words:
    """Words of a slice: byte bounds in `data`, and for each document the range of its words."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # n_docs + 1: words of document i are first[i]:first[i + 1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return hash_runs(self.data, self.starts, self.ends)


def find_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(data, z, z, np.zeros(len(offsets), np.int64))
    inside = _WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    begins[edges] = inside[edges]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    last = edges[edges > 0] - 1
    stops[last] = inside[last]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(stops) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of data[starts[i]:ends[i]]; the runs are not empty, may overlap and come in any order.

    Runs of up to 64 bytes are read eight bytes at a time, longer ones byte by byte.
    """
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    eights = np.ndarray((len(data),), "<u8", buffer=np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    out = mix(lengths.astype(np.uint64) ^ mix((eights[starts] & _LOW[np.minimum(lengths, 8)]) * _EIGHT))
    more = np.flatnonzero((lengths > 8) & (lengths <= 64))
    at = 8
    while len(more):
        out[more] = mix(out[more] * _EIGHT ^ mix((eights[starts[more] + at] & _LOW[np.minimum(lengths[more] - at, 8)]) + np.uint64(at)))
        at += 8
        more = more[lengths[more] > at]
    long = np.flatnonzero(lengths > 64)
    if len(long):
        n = lengths[long]
        at = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(at, n)
        values = _BYTE[data[place + np.repeat(starts[long], n)]] * factors(int(n.max()))[place]
        out[long] = mix(np.add.reduceat(values, at) + n.astype(np.uint64))
    return out


def window_starts(first: np.ndarray, width: int) -> np.ndarray:
    """Index of each word from which `width` words of its document go on."""
    n = np.maximum(np.diff(first) - width + 1, 0)
    return np.arange(int(n.sum())) + np.repeat(first[:-1] - (np.cumsum(n) - n), n)


def combined(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every `width` consecutive words, over document bounds as well."""
    n = max(0, len(hashes) - width + 1)
    f = factors(width + 1)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += hashes[k : k + n] * f[k + 1]
    return mix(total)


def windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each `width` consecutive words of one document, and the index of its first word."""
    at = window_starts(first, width)
    return combined(hashes, width)[at], at


def segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the 0 or 1 values[first[i]:first[i + 1]] for each i, 0 where that is empty."""
    out = np.zeros(len(first) - 1, np.int64)
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        out[full] = np.add.reduceat(values[first[0] : first[-1]], first[full] - first[0], dtype=np.int32)
    return out
