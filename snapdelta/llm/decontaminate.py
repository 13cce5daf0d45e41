"""Benchmark decontamination: latent semantic retrieval, then sequence and answer checks.

Document frequencies of hashed words are summed over all documents. A distributed randomised
SVD follows, over all documents too: each task sums A'(A Omega) over the TF-IDF passages A of its
documents, the sums are added by blocks of features, and the driver gets the leading right singular
vectors from this one sketch (Nystrom). Every document is indexed and searched. Words get latent vectors, scaled so that each direction counts
alike; passages of 32 words, every 16 words, are compared by cosine with those of all benchmark
items. A candidate must also reach a cosine of its full TF-IDF words; then the longest common
subsequence of the item and the place around the passage, and of the item's end (its answer),
decide. A paraphrase that keeps most words in order is caught, wherever it lies in the text.

Words are lower-cased and lose closing punctuation and symbols. Null or empty texts and items
hold nothing and leak nothing. Rows without doc_id are searched and returned with a null
doc_id. Repeated documents and items repeat nothing within one (doc_id, item_id): the best
place is returned, the first on ties. Empty tables give an empty result; extra columns are
ignored. Benchmark items go to the driver and the tasks in portions of at most `portion` items
and `portion_bytes` bytes (or one item), each with a pass over the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import arrow_map, cut, read_table, text_buffer, without
from .words import find_words, hash_runs

#: Bits of the hashed words of the latent space and of the full TF-IDF comparison; latent dimensions; words of half a passage.
BITS, FINE, RANK, BLOCK = 14, 17, 128, 16
#: Items of at most so many words are also compared with half passages.
SHORT = 22
#: Least latent cosine, least TF-IDF cosine, least share of an item and of its end in order.
CANDIDATE, LIKENESS, SEQUENCE, ANSWER = 0.47, 0.33, 0.7, 0.6
#: Bytes of text that a task of the sketch takes, where there are more than two tasks for each core.
SKETCH_BYTES = 128 << 20
#: Bytes of text whose vectors stay in a processor's cache.
CACHED = 1 << 18
_CLOSING = np.zeros(256, bool)
_CLOSING[list(b".,;:!?\"')]}#*$%&|<>")] = True


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case words without closing marks, and the first of each text."""
    w = find_words(*text_buffer(pc.utf8_lower(texts)))
    ends = w.ends.copy()
    for _ in range(4):
        cut = (ends - 1 > w.starts) & _CLOSING[w.data[ends - 1]]
        if not cut.any():
            break
        ends[cut] -= 1
    return hash_runs(w.data, w.starts, ends), w.first


def buckets(h: np.ndarray, bits: int = BITS) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def frequencies(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """In how many documents each coarse and each fine bucket occurs, over all documents, their number and their bytes."""

    def run(batches):
        from .shared import slices

        coarse, fine, n, size = np.zeros(1 << BITS, np.int64), np.zeros(1 << FINE, np.int64), 0, 0
        for batch in batches:
            for part in slices(batch, "text"):
                h, first = terms(part.column("text"))
                doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
                key = np.sort(doc << FINE | buckets(h, FINE))
                if len(key):
                    fine += np.bincount(key[np.append(True, key[1:] != key[:-1])] & (1 << FINE) - 1, minlength=1 << FINE)
                    key >>= FINE - BITS
                    coarse += np.bincount(key[np.append(True, key[1:] != key[:-1])] & (1 << BITS) - 1, minlength=1 << BITS)
                size += part.nbytes
                n += part.num_rows
        total = np.concatenate([[n, size], coarse, fine])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at), "n": pa.array(total[at])})

    total = np.zeros(2 + (1 << BITS) + (1 << FINE), np.int64)
    got = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # a row for each bucket at most
    total[got["bucket"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return total[2 : 2 + (1 << BITS)], total[2 + (1 << BITS) :], int(total[0]), int(total[1])


def passages(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each block of 16; the document of each block; and whether the next block is of it too."""
    counts = np.diff(first)
    per = -(-counts // BLOCK)
    doc = np.repeat(np.arange(len(counts)), per)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    more = np.append(doc[1:] == doc[:-1], False) if len(doc) else np.zeros(0, bool)
    return first[:-1][doc] + number * BLOCK, doc, more


def block_sums(table: np.ndarray, bucket: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of `table` rows over at most 16 words from each of `at` to `end`."""
    out = table[bucket[at]]
    for j in range(1, BLOCK):
        there = at + j < end
        if there.all():
            out += table[bucket[at + j]]
        else:
            out[there] += table[bucket[at[there] + j]]
    return out


View = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def passage_vectors(table: np.ndarray, bucket: np.ndarray, first: np.ndarray) -> tuple[View, View]:
    """Sums of `table` rows, start, end and document: of 32 words from every 16th word on, and of the blocks of 16 words."""
    at, doc, more = passages(first)
    if len(at) == 0:
        view = np.zeros((0, table.shape[1]), table.dtype), at, at, doc
        return view, view
    stop = first[1:][doc]
    block = block_sums(table, bucket, at, stop)
    lone = ~more & ~np.append(False, more[:-1])  # the only block of its document
    vectors = block.copy()
    vectors[more] += block[np.flatnonzero(more) + 1]
    keep = more | lone
    return (vectors[keep], at[keep], np.minimum(at[keep] + 2 * BLOCK, stop[keep]), doc[keep]), (block, at, np.minimum(at + BLOCK, stop), doc)


def add_rows(total: np.ndarray, bucket: np.ndarray, rows: np.ndarray, of: np.ndarray, often: int = 32) -> None:
    """total[bucket[i]] += rows[of[i]] for every i; `of` rises.

    Buckets that occur more than `often` times: their counts in each row times the rows. The
    others: first occurrences at once, then second ones, and so on.
    """
    order = np.argsort(bucket.astype(np.int32), kind="stable")
    ranked = bucket[order]
    edge = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    times = np.diff(np.append(edge, len(ranked)))
    rare = np.flatnonzero(times <= often)
    for j in range(often):
        e = edge[rare[times[rare] > j]]
        if len(e) == 0:
            break
        total[ranked[e]] += rows[of[order[e + j]]]
    many = ranked[edge[times > often]]
    if len(many) == 0:
        return
    line = np.full(len(total), -1, np.int64)
    line[many] = np.arange(len(many))
    line = line[bucket]
    at = np.flatnonzero(line >= 0)
    line, of = line[at], of[at]
    step = 1024
    for a in range(0, len(rows), step):
        lo, hi = np.searchsorted(of, (a, a + step))
        if lo < hi:
            counts = np.bincount(line[lo:hi] * step + of[lo:hi] - a, minlength=len(many) * step).reshape(len(many), step).astype(np.float32)
            total[many] += counts[:, : len(rows) - a] @ rows[a : a + step]


def sketch(docs: DataFrame, idf: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """A'(A omega) over all blocks of 16 words of `docs`; the blocks of features are added by Spark."""
    width = 256

    def run(batches):
        from .shared import slices

        total = np.zeros((1 << BITS, omega.shape[1]), np.float32)
        table = (omega * idf[:, None]).astype(np.float32)
        for batch in batches:
            for part in slices(batch, "text", CACHED):
                h, first = terms(part.column("text"))
                b = buckets(h)
                at, doc, _ = passages(first)
                if len(at) == 0:
                    continue
                rows = block_sums(table, b, at, first[1:][doc])
                rows /= np.add.reduceat(idf[b] ** 2, at)[:, None] + 1e-9
                add_rows(total, b, rows, np.repeat(np.arange(len(at)), np.diff(np.append(at, len(b)))))
        total *= idf[:, None]
        for k in range(0, 1 << BITS, width):
            yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "sums": pa.array([total[k : k + width].tobytes()], pa.binary())})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist()):
                x = np.frombuffer(raw, np.float32).astype(np.float64)
                sums[k] = sums[k] + x if k in sums else x
        for k, x in sums.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "sums": pa.array([x.tobytes()], pa.binary())})

    out = np.zeros(omega.shape)
    for row in docs.select("text").mapInArrow(run, "block int, sums binary").repartition("block").mapInArrow(add, "block int, sums binary").toLocalIterator():
        out[row["block"] : row["block"] + width] = np.frombuffer(bytes(row["sums"]), np.float64).reshape(width, -1)
    return out


def latent_words(idf: np.ndarray, omega: np.ndarray, y: np.ndarray, rank: int) -> np.ndarray:
    """Latent vector of each bucket: V / S from the sketch, times its inverse document frequency."""
    core = omega.T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > max(values.max(), 0) * 1e-6
    if not good.any():
        return np.zeros((len(idf), rank), np.float32)
    u, s, _ = np.linalg.svd(y @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    k = min(rank, len(s))
    out = np.zeros((len(idf), rank), np.float32)
    out[:, :k] = u[:, :k] / (s[:k] + s[0] * 1e-3)
    return out * idf[:, None].astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / (np.sqrt((x * x).sum(axis=1, keepdims=True)) + 1e-12)


def lcs(masks: dict[int, int], length: int, words: list[int]) -> int:
    """Length of the longest common subsequence, a machine-word-parallel row for each word of the place."""
    full = (1 << length) - 1
    v = full
    for w in words:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return length - v.bit_count()


def _masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


@dataclass
class Index:
    """Benchmark items as the tasks need them."""

    latent: np.ndarray
    weight: np.ndarray  # inverse document frequency of each fine bucket
    ids: list[int]
    words: list[list[int]]
    item: np.ndarray  # item of each passage
    unit: np.ndarray  # latent unit vector of each passage
    cells: np.ndarray  # passage << FINE | fine bucket, for each bucket of each passage, sorted
    values: np.ndarray  # TF-IDF of each cell, each passage a unit vector; one 0 more for absent cells
    held: np.ndarray  # whether any passage holds a fine bucket
    short: np.ndarray  # passages of items of at most SHORT words


def build(items: list[tuple[int, str]], latent: np.ndarray, weight: np.ndarray) -> Index:
    h, first = terms(pa.array([t for _, t in items], pa.string()))
    (vectors, starts, ends, item), _ = passage_vectors(latent, buckets(h), first)
    b = buckets(h, FINE)
    size = ends - starts
    passage = np.repeat(np.arange(len(starts)), size)
    word = np.arange(len(passage)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size)
    cells, times = np.unique(passage << FINE | b[word], return_counts=True)
    values = times * weight[cells & (1 << FINE) - 1]
    norm = np.sqrt(np.bincount(cells >> FINE, values * values, len(starts))) + 1e-12
    held = np.zeros(1 << FINE, bool)
    held[b] = True
    words = [h[a:z].tolist() for a, z in zip(first[:-1], first[1:])]
    short = np.flatnonzero(np.diff(first)[item] <= SHORT)
    return Index(latent, weight, [i for i, _ in items], words, item, _unit(vectors), cells, np.append(values / norm[cells >> FINE], 0).astype(np.float32), held, short)


def candidates(index: Index, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(passage start, end, document, item, TF-IDF cosine) of the pairs that reach both cosines.

    Passages of 32 words are compared with all items, blocks of 16 words with short items, which
    fill too little of a longer passage. Both come in one order, by start and the longer first.
    """
    views = passage_vectors(index.latent, buckets(h), first)
    b = buckets(h, FINE)
    weight, held = index.weight[b], index.held[b]
    out = []
    for (vectors, starts, ends, doc), items in zip(views, (np.arange(len(index.unit)), index.short)):
        unit, against = _unit(vectors), index.unit[items].T
        found = [np.flatnonzero((unit[k : k + 2048] @ against >= CANDIDATE).ravel()) + k * len(items) for k in range(0, len(unit), 2048)] if len(items) else []
        at = np.concatenate(found) if found else np.zeros(0, np.int64)
        if len(at) == 0:
            continue
        p, q = np.divmod(at, len(items))
        q = items[q]
        likeness, norm = np.zeros(len(p), np.float32), np.zeros(len(starts), np.float32)
        for j in range(int((ends - starts).max())):
            at = np.minimum(starts + j, len(b) - 1)
            here = np.where(starts + j < ends, weight[at], 0)
            norm += here * here
            mine = np.flatnonzero(held[at[p]] & (here[p] > 0))
            cell = q[mine] << FINE | b[at[p[mine]]]
            where = np.searchsorted(index.cells, cell)
            where[index.cells[np.minimum(where, len(index.cells) - 1)] != cell] = len(index.cells)
            likeness[mine] += index.values[where] * here[p[mine]]
        likeness /= np.sqrt(norm[p]) + 1e-12
        good = likeness >= LIKENESS
        p, q = p[good], q[good]
        out.append((starts[p], ends[p], doc[p], index.item[q], likeness[good]))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.astype(float)
    merged = [np.concatenate(x) for x in zip(*out)]
    order = np.lexsort((-merged[1], merged[0]))
    return tuple(x[order] for x in merged)


def leaks(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, item_id, words of the item found in order, its length, place and cosine, for each leak."""

    def make():
        masks = [_masks(w) for w in index.words]
        tails = [w[-max(1, len(w) // 3) :] for w in index.words]
        tail_masks = [_masks(w) for w in tails]

        def work(part):
            h, first = terms(part.column("text"))
            best: dict[tuple[int, int], tuple] = {}
            tried: dict[tuple[int, int], int] = {}
            for a, z, d, i, cosine in zip(*(x.tolist() for x in candidates(index, h, first))):
                n = len(index.words[i])
                lo, hi = max(int(first[d]), a - n), min(int(first[d + 1]), z + n)
                if tried.get((d, i), -1) >= hi:  # starts rise, so this place lies in one that was checked
                    continue
                tried[d, i] = hi
                place = h[lo:hi].tolist()
                common = lcs(masks[i], n, place)
                if common >= SEQUENCE * n and lcs(tail_masks[i], len(tails[i]), place) >= ANSWER * len(tails[i]):
                    old = best.get((d, i))
                    if old is None or common > old[0]:
                        best[d, i] = (common, lo - int(first[d]), cosine)
            if not best:
                return None
            keys = list(best)
            ids = part.column("doc_id").to_pylist()
            return {
                "doc_id": pa.array([ids[d] for d, _ in keys], pa.int64()), "item_id": [index.ids[i] for _, i in keys], "common_words": [best[k][0] for k in keys],
                "item_words": [len(index.words[i]) for _, i in keys], "start_word": [best[k][1] for k in keys], "cosine": [best[k][2] for k in keys],
            }

        return work

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, item_id long, common_words long, item_words long, start_word long, cosine double", make, limit=CACHED)


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, rank: int = RANK, portion: int = 20_000, portion_bytes: int = 16 << 20, seed: int = 9) -> DataFrame:
    """Every leak of a benchmark item in `docs`, one row for each (doc_id, item_id)."""
    coarse, fine, n, size = frequencies(docs)
    idf, weight = (np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(0.05) for df in (coarse, fine))
    # every task of the sketch sends one sum of fixed size, so that tasks should not be smaller than need be
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-size // SKETCH_BYTES))
    omega = np.random.default_rng(seed).standard_normal((1 << BITS, rank + 16)).astype(np.float32)
    latent = latent_words(idf.astype(np.float64), omega.astype(np.float64), sketch(docs.select("text").coalesce(tasks), idf, omega), rank)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null").distinct()
    many = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    portions = max(1, -(-many["n"] // portion), -(-many["bytes"] // portion_bytes))
    out = None
    for k in range(portions):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(portions)) == k).collect()
        got = leaks(docs, build(sorted((r["item_id"], r["text"]) for r in rows), latent, weight))
        out = got if out is None else out.union(got)
    return out.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("common_words", "item_words", "start_word", "cosine"), F.struct("common_words", -F.col("start_word"))).alias("x")).select("doc_id", "item_id", "x.*")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a leak, with the columns of `docs`. Rows without doc_id stay."""
    found = cut(decontaminate(spark, docs, read_table(spark, sf_dir, "benchmark")).select("doc_id").distinct())
    return without(docs, found)
