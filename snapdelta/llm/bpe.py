"""Byte-level BPE encoding and decoding, with numpy in place of the splitting pattern.

Splitting. Each code point gets a class (letter, number, space, ...) and each class is a
function from ten left-context states to states. Functions compose associatively: texts are
cut into blocks, the functions of a block's code points are composed for all blocks at once,
a doubling scan composes the blocks, and a last pass over all blocks emits the boundaries. A
mark after each text resets the state, so that a whole slice of rows is one scan.

Merging. Slices between boundaries, the distinct ones of a slice of rows by a 64-bit hash, go to
a cache of merged pieces; new short pieces are merged together, round after round, by the rank
of their pairs, and long ones with a heap. Token offsets are kept, so that ids give
back the bytes and every token's place.

Null and empty texts have no tokens. Repeated rows repeat; extra columns are ignored; an empty
table gives an empty result. A text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import arrow_map, read_table, text_buffer
from .words import hash_runs

#: Code points of the property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LETTER, NUMBER, OTHER, BLANK, SPACE, QUOTE, S, T, R, E, V, M, L, D, END = range(15)
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_BLANK, AFTER_SPACE, AT_QUOTE, QUOTE_R, QUOTE_V, QUOTE_L = range(10)
HERE, BEFORE = 1, 2
#: Code points of a block, and of its head.
BLOCK, HEAD = 64, 4
#: Pieces that a worker's cache holds before it starts afresh, as it does with each task.
CACHE = 500_000

_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """Class of each code point; the number after the last is the mark after a text."""
    global _classes
    if _classes is None:
        major = np.frombuffer("".join(unicodedata.category(chr(i))[0] for i in range(0x110000)).encode(), np.uint8)
        out = np.full(0x110001, OTHER, np.uint8)
        out[:-1][major == ord("L")] = LETTER
        out[:-1][major == ord("N")] = NUMBER
        out[WHITE_SPACE] = SPACE
        out[0x20] = BLANK
        for c, k in zip("'strevmld", (QUOTE, S, T, R, E, V, M, L, D)):
            out[ord(c)] = k
        out[0x110000] = END
        _classes = out
    return _classes


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emitted boundaries by class * 10 + state."""
    letters = (LETTER, S, T, R, E, V, M, L, D)
    run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER, BLANK: AFTER_BLANK, SPACE: AFTER_SPACE, QUOTE: AT_QUOTE} | dict.fromkeys(letters, IN_LETTERS)
    to, emit = np.zeros((15, 10), np.uint8), np.zeros((15, 10), np.uint8)
    for c in range(14):
        for s in range(10):
            begun, mark = run[c], HERE
            if (s, begun) in ((IN_LETTERS, IN_LETTERS), (IN_NUMBERS, IN_NUMBERS), (IN_OTHER, IN_OTHER)) or s in (IN_OTHER, AT_QUOTE) and c in (OTHER, QUOTE):
                begun, mark = (IN_OTHER if c in (OTHER, QUOTE) else begun), 0
            elif s in (AFTER_BLANK, AFTER_SPACE):
                if c in (BLANK, SPACE):
                    mark = 0
                elif s == AFTER_BLANK:
                    begun, mark = (IN_OTHER if c == QUOTE else begun), BEFORE
                else:
                    mark = HERE | BEFORE
            elif s == AT_QUOTE and c in (S, T, M, D):
                begun, mark = FRESH, 0
            elif s == AT_QUOTE and c in (R, V, L):
                begun, mark = {R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}[c], 0
            elif s in (QUOTE_R, QUOTE_V, QUOTE_L):
                if c == (L if s == QUOTE_L else E):
                    begun, mark = FRESH, 0
                else:
                    mark = BEFORE if c in letters else HERE | BEFORE
            to[c, s], emit[c, s] = begun, mark
    emit[END, [QUOTE_R, QUOTE_V, QUOTE_L]] = BEFORE
    return to.ravel(), emit.ravel()


_TO, _EMIT = _automaton()


def compose(columns: np.ndarray) -> np.ndarray:
    """The function from state to state of each row of classes; `columns` are the classes times 10, transposed."""
    whole = np.tile(np.arange(10, dtype=np.uint8), (columns.shape[1], 1))
    for c in columns:
        whole = _TO[c[:, None] + whole]
    return whole


def boundaries(kinds: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each position of an array of classes.

    The functions of HEAD code points are nearly always constant (no state before matters), so a
    block's later states are known from its head alone; only blocks whose head is not constant
    are composed whole, and the doubling scan joins all blocks.
    """
    n = len(kinds)
    if n == 0:
        return np.zeros(0, bool)
    rows = -(-n // BLOCK)
    padded = np.full(rows * BLOCK, END, np.uint8)
    padded[:n] = kinds
    columns = np.ascontiguousarray(padded.reshape(rows, BLOCK).T) * np.uint8(10)
    head = compose(columns[:HEAD])
    open_rows = np.flatnonzero((head != head[:, :1]).any(axis=1))
    marks = np.empty((BLOCK, rows), np.uint8)
    state = head[:, FRESH].copy()
    for k in range(HEAD, BLOCK):
        at = columns[k] + state
        marks[k] = _EMIT[at]
        state = _TO[at]
    if len(open_rows):
        whole = np.repeat(state[:, None], 10, axis=1)
        whole[open_rows] = compose(columns[:, open_rows])
        reach = 1
        while reach < rows:  # whole[i] becomes the composition of all blocks up to i
            whole[reach:] = np.take_along_axis(whole[reach:], whole[:-reach].astype(np.int64), axis=1)
            reach *= 2
        state = whole[:, FRESH]
    entry = np.concatenate([[np.uint8(FRESH)], state[:-1]]).astype(np.uint8)
    for k in range(HEAD):
        at = columns[k] + entry
        marks[k] = _EMIT[at]
        entry = _TO[at]
    for k in range(HEAD, BLOCK if len(open_rows) else HEAD):
        at = columns[k][open_rows] + entry[open_rows]
        marks[k][open_rows] = _EMIT[at]
        entry[open_rows] = _TO[at]
    marks = marks.T.ravel()[:n]
    out = (marks & HERE) > 0
    out[:-1] |= (marks[1:] & BEFORE) > 0
    return out


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte bounds of the pieces of all texts of a slice, and how many each text has."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    begins = np.cumsum(size) - size
    ends = np.searchsorted(begins, offsets[1:])
    points = np.insert(points, ends, 0x110000)
    kinds = classes()[points]
    starts = boundaries(kinds)
    mark = kinds == END
    byte = np.empty(len(points), np.int64)
    byte[~mark] = begins
    byte[mark] = offsets[1:]
    edge = np.flatnonzero(starts | mark)
    real = ~mark[edge]
    piece = np.flatnonzero(real)
    counts = np.diff(np.concatenate([[0], np.searchsorted(edge[piece], np.flatnonzero(mark))]))
    return byte[edge[piece]], byte[edge[piece + 1]] if len(piece) else byte[:0], counts


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: again and again the pair of the lowest rank is merged, the leftmost first."""
    if (one := ranks.get(piece)) is not None:
        return [one]
    if len(piece) <= 48:
        get, none = ranks.get, len(ranks) + 1
        at = list(range(len(piece) + 1))
        pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pairs and (low := min(pairs)) < none:
            i = pairs.index(low)
            del pairs[i], at[i + 1]
            if i < len(pairs):
                pairs[i] = get(piece[at[i] : at[i + 2]], none)
            if i:
                pairs[i - 1] = get(piece[at[i - 1] : at[i + 1]], none)
        return [ranks[piece[a:b]] for a, b in zip(at, at[1:])]
    n = len(piece)
    end = list(range(1, n + 1))  # end of the part that starts at i; 0 once it is merged away
    left = list(range(-1, n - 1))
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, to = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != to:
            continue
        end[i], end[middle] = to, 0
        if to < n:
            left[to] = i
            if (rank := ranks.get(piece[i : end[to]])) is not None:
                heapq.heappush(heap, (rank, i, end[to]))
        if (j := left[i]) >= 0 and (rank := ranks.get(piece[j:to])) is not None:
            heapq.heappush(heap, (rank, j, to))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Pairs:
    """Rank of each pair of tokens whose bytes together are a token, for many pieces at once."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {(ranks[t[:k]] << 32) | ranks[t[k:]]: i for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.none = np.int32(np.iinfo(np.int32).max)
        self.tables = []  # two hash tables of places in `keys`; what fits in neither is searched for
        rest = np.arange(len(self.keys))
        for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            slot = self.slots(self.keys[rest], odd)
            table = np.zeros(1 << 20, np.int32)
            table[slot[::-1]] = rest[::-1]
            self.tables.append((odd, table))
            rest = rest[table[slot] != rest]
        self.rest_keys, self.rest_ranks = self.keys[rest], self.ranks[rest]
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right = np.repeat(self.of_byte, 256), np.tile(self.of_byte, 256)
        self.of_bytes = self.look(left, right).reshape(256, 256)

    @staticmethod
    def slots(keys: np.ndarray, odd: int) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(odd) >> np.uint64(44)).astype(np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left.astype(np.int64) << 32 | right
        out = np.full(wanted.shape, self.none, np.int32)
        for odd, table in self.tables:
            at = table[self.slots(wanted, odd)]
            hit = self.keys[at] == wanted
            out[hit] = self.ranks[at[hit]]
        if len(self.rest_keys):
            at = np.minimum(np.searchsorted(self.rest_keys, wanted), len(self.rest_keys) - 1)
            hit = self.rest_keys[at] == wanted
            out[hit] = self.rest_ranks[at[hit]]
        return out

    def merge(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of 2 to `width` bytes, row after row, and how many each has.

        Every round merges in all rows the pair of the lowest rank, the leftmost first.
        """
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        place = np.arange(width)
        ids = self.of_byte[raw]
        rank = self.of_bytes[raw[:, :-1], raw[:, 1:]].copy()
        rank[place[:-1] >= size[:, None] - 1] = self.none
        done_ids, done_size, row = ids.copy(), size.copy(), np.arange(len(pieces))
        while len(row):
            at = rank.argmin(axis=1)
            low = rank[np.arange(len(row)), at]
            more = low < self.none
            if not more.all():
                done_ids[row[~more]], done_size[row[~more]] = ids[~more], size[~more]
                ids, rank, size, row, at, low = ids[more], rank[more], size[more], row[more], at[more], low[more]
            n = np.arange(len(row))
            shift = np.minimum(place + (place > at[:, None]), width - 1)
            ids = np.take_along_axis(ids, shift, axis=1)
            ids[n, at] = low
            rank = np.take_along_axis(rank, np.minimum(place[:-1] + (place[:-1] >= at[:, None]), width - 2), axis=1)
            size -= 1
            rank[n, np.minimum(size - 1, width - 2)] = self.none  # also ends the row at its new size
            left = n[at > 0]
            rank[left, at[left] - 1] = self.look(ids[left, at[left] - 1], ids[left, at[left]])
            right = n[at < size - 1]
            rank[right, at[right]] = self.look(ids[right, at[right]], ids[right, at[right] + 1])
        return done_ids[place < done_size[:, None]], done_size


class Codec(dict):
    """Encoder and decoder by one rank file; as a dict, the cache from a piece to its run in the pool."""

    def __init__(self, path: str):
        super().__init__()
        self.ranks = load_ranks(path)
        self.pairs = Pairs(self.ranks)
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for b, i in self.ranks.items():
            self.bytes_of[i] = b
        self.widths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.pool, self.at, self.length = array("I"), array("q"), array("q")

    def keep(self, piece: bytes, ids: list[int]) -> None:
        self[piece] = len(self.at)
        self.at.append(len(self.pool))
        self.length.append(len(ids))
        self.pool.extend(ids)

    def learn(self, pieces: list[bytes]) -> None:
        """Merges pieces that the cache lacks: short ones together, long ones one by one."""
        short: dict[int, list[bytes]] = {}
        for p in pieces:
            if (one := self.ranks.get(p)) is not None:
                self.keep(p, [one])
            elif len(p) <= 32:
                short.setdefault(-(-len(p) // 8) * 8, []).append(p)
            else:
                self.keep(p, merge(p, self.ranks))
        for width, some in short.items():
            ids, sizes = self.pairs.merge(some, width)
            base, n = len(self.pool), len(self.at)
            self.update(zip(some, range(n, n + len(some))))
            self.at.extend((base + np.cumsum(sizes) - sizes).tolist())
            self.length.extend(sizes.tolist())
            self.pool.frombytes(ids.astype(np.uint32).tobytes())

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and n + 1 bounds of each text's ids."""
        starts, ends, counts = split(data, offsets)
        if len(self) > CACHE:
            self.forget()
        raw = data.tobytes()
        _, chosen, of = np.unique(hash_runs(data, starts, ends), return_index=True, return_inverse=True)
        pieces = [raw[a:b] for a, b in zip(starts[chosen].tolist(), ends[chosen].tolist())]
        known = list(map(self.get, pieces))
        if None in known:
            lacking = [i for i, x in enumerate(known) if x is None]
            self.learn([pieces[i] for i in lacking])
            for i in lacking:
                known[i] = self[pieces[i]]
        number = np.array(known, np.int64)[of]
        sizes = np.array(self.length, np.int64)[number]
        total = int(sizes.sum())
        first = np.cumsum(sizes) - sizes
        ids = np.array(self.pool, np.uint32)[np.repeat(np.array(self.at, np.int64)[number] - first, sizes) + np.arange(total)]
        piece_first = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.concatenate([[0], np.cumsum(sizes)])[piece_first]

    def places(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Byte offset of each token in its own text."""
        w = self.widths[ids]
        c = np.cumsum(w) - w
        base = np.append(c, 0)[np.minimum(first[:-1], len(ids))]
        return c - np.repeat(base, np.diff(first))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec for a rank file, loaded once."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, and for each id its byte offset in the text."""
    path = path or default_ranks()

    def make():
        def work(part):
            c = codec(path)
            ids, first = c.encode(*text_buffer(part.column("text")))
            bounds = pa.array(first.astype(np.int32))
            return {"doc_id": part.column("doc_id"), "ids": pa.ListArray.from_arrays(bounds, pa.array(ids.astype(np.int32))), "offsets": pa.ListArray.from_arrays(bounds, pa.array(c.places(ids, first).astype(np.int32)))}

        return work

    return arrow_map(docs.select("doc_id", "text"), "doc_id long, ids array<int>, offsets array<int>", make, forget=lambda: codec(path).forget())


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the text whose ids are given."""
    path = path or default_ranks()

    def make():
        def work(part):
            c = codec(path)
            return {"doc_id": part.column("doc_id"), "text": pa.array([c.decode(np.array(x or [], np.int64)).decode("utf-8") for x in part.column("ids").to_pylist()])}

        return work

    return arrow_map(tokens.select("doc_id", "ids"), "doc_id long, text string", make, text=None)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the bytes that they decode to."""
    path = path or default_ranks()

    def make():
        def work(part):
            c = codec(path)
            ids, first = c.encode(*text_buffer(part.column("text")))
            each = [ids[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
            sha = lambda b: hashlib.sha256(b).hexdigest()
            return {"doc_id": part.column("doc_id"), "n_tokens": np.diff(first), "ids_sha256": [sha(x.astype("<u4").tobytes()) for x in each], "decoded_sha256": [sha(c.decode(x)) for x in each]}

        return work

    return arrow_map(docs.select("doc_id", "text"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make, forget=lambda: codec(path).forget())


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of every document that the earlier stages kept."""
    return digests(docs)
