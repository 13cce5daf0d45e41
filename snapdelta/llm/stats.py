"""Counts over whole texts, for all rows of a slice at once: the inputs of the quality models."""

from __future__ import annotations

import numpy as np

from .words import LOWER, Words, find_words, hash_runs, mix, segment_sums, windows

#: The symbols that the base rules count.
SYMBOLS = b"#*$%&|<>"
#: Frequent function words of four languages.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it its of on that the this to was were will with not or but you "
    "de des du en est et la le les un une que qui dans pour pas plus sur par au avec "
    "der die das und ist nicht ein eine mit von den zu auf für im dem sich als auch es "
    "el los las y del se por con una su para al lo como más o no ya"
).split()

_LEAD = (np.arange(256) & 0xC0) != 0x80
_CLASS = np.zeros(256, np.uint8)  # 1 space, 2 lower, 3 upper, 4 digit, 5 symbol, 6 other punctuation, 7 beyond ASCII
_CLASS[33:127] = 6
_CLASS[[32, 9, 10, 11, 12, 13]] = 1
_CLASS[97:123] = 2
_CLASS[65:91] = 3
_CLASS[48:58] = 4
_CLASS[list(SYMBOLS)] = 5
_CLASS[128:] = 7


def _stop_hashes() -> np.ndarray:
    raw = [w.encode() for w in STOP_WORDS]
    ends = np.cumsum([len(w) for w in raw])
    return np.unique(hash_runs(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends))


_STOP = _stop_hashes()


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def distinct_in(doc: np.ndarray, hashes: np.ndarray, n_docs: int) -> np.ndarray:
    """Distinct hashes of each document; the documents come in order."""
    keys = mix(hashes ^ mix(doc.astype(np.uint64)))
    _, first = np.unique(keys, return_index=True)
    return np.bincount(doc[first], minlength=n_docs)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each line between line feeds."""
    feeds = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], feeds + 1]))
    ends = np.sort(np.concatenate([feeds, offsets[1:]]))
    per = np.diff(np.searchsorted(feeds, offsets)) + 1
    return starts, ends, np.repeat(np.arange(len(offsets) - 1), per)


def base_counts(data: np.ndarray, offsets: np.ndarray, w: Words | None = None, hashes: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (and n_lines) of each text."""
    w = w or find_words(data, offsets)
    hashes = w.hashes() if hashes is None else hashes
    n = len(offsets) - 1
    kinds = _CLASS[data]
    inside = kinds != 1
    starts, ends, doc = lines(data, offsets)
    at = np.searchsorted(w.starts, starts)  # the first word that begins in the line or later
    has = at < np.searchsorted(w.starts, ends)
    starts, ends, doc = starts[has], ends[has], doc[has]
    n_lines = np.bincount(doc, minlength=n)
    n_dup = n_lines - distinct_in(doc, hash_runs(data, starts, ends), n)
    grams, at = windows(hashes, w.first, 5)
    of = w.doc()
    twice = at[repeated(mix(grams ^ mix(of[at].astype(np.uint64))))] if len(at) else at
    step = np.zeros(len(hashes) + 1, np.int64)
    step += np.bincount(twice, minlength=len(step)) - np.bincount(twice + 5, minlength=len(step))
    covered = np.cumsum(step[:-1]) > 0
    return {
        "n_words": w.counts,
        "word_chars": segment_sums(_LEAD[data] & inside, offsets),
        "n_symbols": segment_sums(kinds == 5, offsets),
        "n_dup_lines": n_dup,
        "n_repeat_words": segment_sums(covered, w.first),
        "n_lines": n_lines,
    }


FEATURES = (
    "log_words", "mean_word_chars", "symbol_share", "dup_line_share", "repeat_word_share", "distinct_word_share", "stop_word_share", "words_a_line",
    "lower_share", "upper_share", "digit_share", "punctuation_share", "beyond_ascii_share", "symbol_end_share", "long_word_share", "one_char_word_share",
)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text; shares of nothing are 0."""
    w = find_words(data, offsets)
    hashes = w.hashes()
    n = len(offsets) - 1
    base = base_counts(data, offsets, w, hashes)
    words = np.maximum(w.counts, 1)
    chars = np.maximum(base["word_chars"], 1)
    low = LOWER[data]
    kinds = _CLASS[data]
    low_hash = hash_runs(low, w.starts, w.ends)
    lengths = w.ends - w.starts
    share = lambda mask: segment_sums(mask, offsets) / chars
    of_words = lambda mask: segment_sums(mask, w.first) / words
    ends_kind = kinds[w.ends - 1] if len(w.ends) else kinds[:0]
    return np.column_stack([
        np.log1p(w.counts), base["word_chars"] / words, base["n_symbols"] / chars, base["n_dup_lines"] / np.maximum(base["n_lines"], 1),
        base["n_repeat_words"] / words, distinct_in(w.doc(), low_hash, n) / words, of_words(np.isin(low_hash, _STOP)), w.counts / np.maximum(base["n_lines"], 1),
        share(kinds == 2), share(kinds == 3), share(kinds == 4), share(kinds == 6), share(kinds == 7), of_words(ends_kind == 5), of_words(lengths > 15), of_words(lengths == 1),
    ]).astype(np.float32)
