"""Token-ID output: sequences of equal length in training order, in shards of fixed stride.

Each text is encoded, closed by an end mark and cut into sequences of `length` ids; the last one
of a text is filled with end marks. A sequence's number (its partition and its place there) goes
through a keyed Feistel network: it permutes the next power of four, and cycle-walking applies it
again until the number is below DOMAIN. So every task computes positions without a table, and no
two are the same. Positions are dealt by range, the one exchange of the tokens; each range counts
what it got, and a sequence's slot is its range's base and its rank there. A shard is `stride`
sequences of the same number of bytes, so slot s lies at byte (s mod stride) * length * width of
its shard and a reader can start anywhere. A task writes its range at its place in the shards, in
the shared folder; `export` adds an index (slot, doc_id, seq, n_tokens) and a manifest with the
key, the sizes and a digest, and returns rows whose tokens are read back from the shards.

Null and empty texts give one sequence of end marks. Repeated rows give a sequence each; a null
doc_id stays null; an empty table gives no sequence. Extra columns are ignored. The slots depend
on the key and on where rows lie in `docs`, which should be a stored table: a task that is run
again must meet its rows in the same order. Ids take 16 bits, or 32 where the ranks need them.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import codec, default_ranks
from .shared import arrow_map, ensure_checkpoint_dir, fanout, read_table, text_buffer
from .words import mix

LENGTH, STRIDE, END_ID = 256, 4096, 50256
#: Numbers of sequences (2**33 for each partition) are below this, and so are their positions.
DOMAIN = 10**18
ROWS = "slot long, shard int, place int, doc_id long, seq int, n_tokens int, tokens binary"


def feistel(numbers: np.ndarray, total: int, key: int, rounds: int = 6) -> np.ndarray:
    """A keyed permutation of 0 .. total - 1, applied to `numbers`."""
    half = max(1, ((max(total, 2) - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) + np.uint64(key * 0x9E3779B97F4A7C15 % 2**64))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        return left << np.uint64(half) | right

    with np.errstate(over="ignore"):
        out = once(numbers.astype(np.uint64))
        while (walking := out >= np.uint64(total)).any():
            out[walking] = once(out[walking])
    return out.astype(np.int64)


def id_kind(path: str | None = None, end_id: int = END_ID) -> str:
    """Little-endian integers that hold every id of the ranks."""
    return "<u2" if max(len(codec(path or default_ranks()).bytes_of) - 1, end_id) < 1 << 16 else "<u4"


def sequences(docs: DataFrame, key: int = 7, length: int = LENGTH, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """position, doc_id, seq (from 0), n_tokens (without filling, with the end mark) and tokens."""
    path = path or default_ranks()

    def make():
        kind = id_kind(path, end_id)
        width = np.dtype(kind).itemsize
        context = TaskContext.get()
        done = (context.partitionId() if context else 0) << 33

        def work(part):
            nonlocal done
            ids, first = codec(path).encode(*text_buffer(part.column("text")))
            counts = np.diff(first)
            n = (counts + length) // length  # counts + 1 ids, rounded up
            doc = np.repeat(np.arange(len(counts)), n)
            seq = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            flat = np.full(len(doc) * length, end_id, kind)
            base = (np.cumsum(n) - n) * length
            flat[np.arange(len(ids)) + np.repeat(base - first[:-1], counts)] = ids
            bounds = np.arange(len(doc) + 1, dtype=np.int32) * (width * length)
            tokens = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(bounds), pa.py_buffer(flat.tobytes())])
            position = feistel(done + np.arange(len(doc)), DOMAIN, key)
            done += len(doc)
            return {"position": position, "doc_id": part.column("doc_id").take(pa.array(doc)), "seq": seq, "n_tokens": np.minimum(length, counts[doc] + 1 - seq * length), "tokens": tokens}

        return work

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "position long, doc_id long, seq int, n_tokens int, tokens binary", make)


def ranges(docs: DataFrame, key: int, length: int, path: str | None) -> DataFrame:
    """Sequences by range of position, in order, each with the first slot and the digest of its range."""
    many = 4 * fanout(docs.sparkSession)
    dealt = sequences(docs, key, length, path=path).withColumn("range", F.floor(F.col("position") / (DOMAIN / many)).cast("int")).repartition("range")
    # the digest needs every column, so that Spark counts and writes from the same exchange
    counts = dealt.groupBy("range").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("position", "doc_id", "seq", "n_tokens", "tokens")).alias("digest"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    bases = counts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), "digest")
    # a left join, as an inner one would filter null ranges below one of the two exchanges, which would then differ
    return dealt.join(F.broadcast(bases), "range", "left").sortWithinPartitions("range", "position")


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """Slots of the rows of `ranges`, batch by batch."""
    last, done = None, 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        of = batch.column("range").to_numpy()
        new = np.append(True, of[1:] != of[:-1])
        start = np.flatnonzero(new)
        rank = np.arange(len(of)) - np.repeat(start, np.diff(np.append(start, len(of))))
        if of[0] == last:
            rank[of == last] += done
        last, done = of[-1], int(rank[-1]) + 1
        yield batch.column("base").to_numpy() + rank, batch


def materialise(spark: SparkSession, docs: DataFrame, key: int = 7, length: int = LENGTH, stride: int = STRIDE, path: str | None = None) -> DataFrame:
    """slot, shard, place, doc_id, seq, n_tokens and tokens of every sequence; partitions hold runs of slots, in order."""

    def run(batches):
        for slot, batch in numbered(batches):
            columns = {"slot": pa.array(slot), "shard": pa.array((slot // stride).astype(np.int32)), "place": pa.array((slot % stride).astype(np.int32))}
            yield pa.RecordBatch.from_pydict(columns | {c: batch.column(c) for c in ("doc_id", "seq", "n_tokens", "tokens")})

    return ranges(docs, key, length, path).mapInArrow(run, ROWS)


def shard_file(folder: str, shard: int) -> str:
    return os.path.join(folder, f"shard-{shard:08d}.bin")


def runs(shard: np.ndarray, place: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of neighbouring places of one shard."""
    edge = np.flatnonzero((shard[1:] != shard[:-1]) | (place[1:] != place[:-1] + 1)) + 1
    return list(zip([0, *edge.tolist()], [*edge.tolist(), len(shard)]))


def put(folder: str, shard: np.ndarray, place: np.ndarray, tokens: pa.Array) -> None:
    """Writes sequences at their places. Writing them again, or beside other tasks, does no harm; equal bytes are left alone."""
    data, offsets = text_buffer(tokens)
    os.makedirs(folder, exist_ok=True)
    for a, b in runs(shard, place):
        raw, at = data[offsets[a] : offsets[b]].tobytes(), int(place[a]) * int(offsets[1])
        file = os.open(shard_file(folder, int(shard[a])), os.O_RDWR | os.O_CREAT, 0o644)
        try:
            if os.pread(file, len(raw), at) != raw:
                done = 0
                while done < len(raw):
                    done += os.pwrite(file, raw[done:], at + done)
        finally:
            os.close(file)


def get(folder: str, shard: np.ndarray, place: np.ndarray, width: int) -> pa.Array:
    """Tokens of the places, `width` bytes each, from the shards."""
    out = []
    for a, b in runs(shard, place):
        with open(shard_file(folder, int(shard[a])), "rb") as f:
            f.seek(int(place[a]) * width)
            out.append(f.read((b - a) * width))
    raw = b"".join(out)
    if len(raw) != len(shard) * width:
        raise OSError(f"shards in {folder} hold {len(raw)} of {len(shard) * width} bytes")
    return pa.Array.from_buffers(pa.binary(), len(shard), [None, pa.py_buffer(np.arange(len(shard) + 1, dtype=np.int32) * width), pa.py_buffer(raw)])


def write_shards(placed: DataFrame, folder: str) -> DataFrame:
    """Writes rows with shard, place and tokens as shard-<n>.bin below `folder`, a path that all executors share; returns shard, sequences, bytes."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                put(folder, batch.column("shard").to_numpy(), batch.column("place").to_numpy(), batch.column("tokens"))
                yield pa.RecordBatch.from_pydict({"shard": batch.column("shard"), "bytes": pa.array(np.diff(text_buffer(batch.column("tokens"))[1]))})

    written = placed.select("shard", "place", "tokens").sortWithinPartitions("shard", "place").mapInArrow(run, "shard int, bytes long")
    return written.groupBy("shard").agg(F.count("*").alias("sequences"), F.sum("bytes").alias("bytes"))


def export(docs: DataFrame, folder: str, key: int = 7, length: int = LENGTH, stride: int = STRIDE, path: str | None = None) -> DataFrame:
    """Writes the shards of `docs` to `folder` with an index and a manifest; the rows of `materialise`, read back from there.

    What an earlier run left in the folder is replaced, cut or removed; the manifest goes first and
    comes back last, so a folder without one is not whole.
    """
    spark = docs.sparkSession
    manifest, index = os.path.join(folder, "manifest.json"), f"file://{folder}/index"
    if os.path.exists(manifest):
        os.remove(manifest)

    def write(batches):
        for slot, batch in numbered(batches):
            put(folder, slot // stride, slot % stride, batch.column("tokens"))
            yield pa.RecordBatch.from_pydict({"slot": pa.array(slot)} | {c: batch.column(c) for c in ("doc_id", "seq", "n_tokens", "range", "digest")})

    ranges(docs, key, length, path).mapInArrow(write, "slot long, doc_id long, seq int, n_tokens int, range int, digest long").write.mode("overwrite").parquet(index)
    rows = spark.read.schema("slot long, doc_id long, seq int, n_tokens int, range int, digest long").parquet(index)
    total = rows.count()
    digest = rows.groupBy("range").agg(F.first("digest").alias("digest")).agg(F.bit_xor("digest")).first()[0]
    kind = id_kind(path)
    width = length * np.dtype(kind).itemsize
    os.makedirs(folder, exist_ok=True)
    for name in os.listdir(folder):
        if name.startswith("shard-") and name.endswith(".bin"):
            left = min(stride, total - int(name[6:-4]) * stride)
            if left <= 0:
                os.remove(os.path.join(folder, name))
            elif left < stride:
                os.truncate(os.path.join(folder, name), left * width)
    with open(f"{manifest}.new", "w") as f:
        json.dump({"key": key, "length": length, "stride": stride, "ids": kind, "sequences": total, "digest": digest}, f)
    os.replace(f"{manifest}.new", manifest)

    def read(batches):
        for batch in batches:
            if batch.num_rows:
                slot = batch.column("slot").to_numpy()
                columns = {"slot": batch.column("slot"), "shard": pa.array((slot // stride).astype(np.int32)), "place": pa.array((slot % stride).astype(np.int32))}
                yield pa.RecordBatch.from_pydict(columns | {c: batch.column(c) for c in ("doc_id", "seq", "n_tokens")} | {"tokens": get(folder, slot // stride, slot % stride, width)})

    return rows.select("slot", "doc_id", "seq", "n_tokens").mapInArrow(read, ROWS)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the checkpoint folder, which the driver and all executors share as files."""
    url = urlparse(ensure_checkpoint_dir(spark))
    if url.scheme not in ("", "file"):
        raise ValueError(f"shards need a shared folder of files, not {url.scheme}")
    return os.path.join(unquote(url.path), f"{name}-{uuid.uuid4().hex}")


def read_slots(folder: str, start: int, count: int, length: int = LENGTH, stride: int = STRIDE, kind: str = "<u2") -> np.ndarray:
    """`count` sequences from slot `start` on, by seeking in the shards; fewer at the end."""
    out, width = [], np.dtype(kind).itemsize * length
    while count > 0 and os.path.exists(file := shard_file(folder, start // stride)):
        with open(file, "rb") as f:
            f.seek(start % stride * width)
            raw = f.read(min(count, stride - start % stride) * width)
        if not raw:
            break
        out.append(np.frombuffer(raw, kind).reshape(-1, length))
        start, count = start + len(out[-1]), count - len(out[-1])
    return np.concatenate(out) if out else np.zeros((0, length), kind)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export(read_table(spark, sf_dir, "documents"), shared_folder(spark, "token_shards"))
