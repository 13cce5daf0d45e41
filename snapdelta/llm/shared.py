"""What the corpus operators share on the Spark side: reading, checkpoints, maps.

Spark hands whole Arrow batches to Python; `arrow_map` cuts them into slices of
bounded bytes before numpy sees them, so that memory depends on the slice (or on
one text, when a single text is longer) and never on the batch or the partition.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass takes.
SLICE_BYTES = 1 << 20


#: Bytes of an Arrow batch, of which Spark and Python each hold one or two for a task.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's limit on Arrow batches to BATCH_BYTES, if it is above: whole texts make large rows."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).removesuffix("b")
    if not (now.isdigit() and 0 < int(now) <= BATCH_BYTES):
        spark.conf.set(name, f"{BATCH_BYTES}b")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local one only where none is set and Spark is local (tests)."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), f"ckpt-{sc.applicationId}"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder, its lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def rewrite(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet into the shared checkpoint folder and read back; `discard` removes it."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Removes what `rewrite` wrote for `df`, when nothing will read it again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


BLOOM_BITS = 25


def may_hold(ids: DataFrame, name: str = "doc_id") -> Callable[[Column], Column]:
    """A condition that holds for every id of `ids` and for few others: it spares most rows the exact join that follows.

    A Bloom filter with a fixed 2**BLOOM_BITS bits (4 MB) is built by the executors and is all
    that the driver gets and broadcasts. With far more ids it lets all rows pass, which costs
    time and changes no result. Null is False.
    """
    spark = ids.sparkSession
    places = lambda c: [F.pmod(F.xxhash64(c.cast("long"), F.lit(salt)), F.lit(1 << BLOOM_BITS)) for salt in (0, 1)]
    at = ids.filter(F.col(name).isNotNull()).select(F.explode(F.array(*places(F.col(name)))).alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(31).cast("int"))
    words = at.groupBy(F.shiftright("at", 5).alias("word")).agg(F.bit_or(bit).alias("bits"))
    filled = np.zeros(1 << BLOOM_BITS - 5, np.uint32)
    for batch in words.toArrow().to_batches():  # a row for each of 2**(BLOOM_BITS - 5) words at most
        filled[batch.column("word").to_numpy()] = batch.column("bits").to_numpy().astype(np.uint32)
    shared = spark.sparkContext.broadcast(filled)

    @F.pandas_udf("boolean")
    def hit(first: pd.Series, second: pd.Series) -> pd.Series:
        got = [shared.value[x >> 5] >> (x & 31).astype(np.uint32) & 1 for x in (first.to_numpy(), second.to_numpy())]
        return pd.Series((got[0] & got[1]).astype(bool))

    return lambda c: c.isNotNull() & hit(*places(F.coalesce(c, F.lit(0))))


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of `docs` whose doc_id is not among the non-null doc_id of `ids`; only rows that the filter can't clear are joined."""
    suspect = may_hold(ids)(F.col("doc_id"))
    some, gone = docs.filter(suspect), ids.filter("doc_id is not null").select(F.col("doc_id").alias("gone")).distinct()
    return docs.filter(~suspect).union(some.join(gone, some["doc_id"].cast("long") == gone["gone"], "left_anti"))


def fanout(spark: SparkSession) -> int:
    """Partitions that the session deals shuffles into."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def slices(batch: pa.RecordBatch, text: str | None, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """`batch` in runs of rows whose column `text` has about `limit` bytes, one row at least."""
    if batch.num_rows == 0:
        return
    if text is None:
        yield batch
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes + 16)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column as one array, and n + 1 offsets; null is empty."""
    column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def give_back() -> None:
    """Returns free memory to the system: Spark keeps Python workers, idle ones too, for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict]], text: str | None = "text", limit: int = SLICE_BYTES, forget: Callable[[], None] | None = None) -> DataFrame:
    """`df` through `make()(slice) -> {column: array}`; `make` runs once in each task, and `forget` at its end."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    bound_batches(df.sparkSession)
    out = to_arrow_schema(StructType.fromDDL(schema), prefers_large_types=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, text, limit):
                got = work(part)
                if got is not None:
                    columns = [_array(got[f.name], f.type) for f in out]
                    if len(columns[0]):
                        yield pa.RecordBatch.from_arrays(columns, schema=out)
        del work
        if forget:
            forget()
        give_back()

    return df.mapInArrow(run, schema)


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, kind)


def held_out(doc_id: str = "doc_id"):
    """Whether a row belongs to the fold whose labels no model may see."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(spark: SparkSession, sf_dir: str, documents: DataFrame, label: str, rows: int) -> DataFrame:
    """At most `rows` labelled training documents (doc_id, text, label), chosen by a hash of the id.

    `rows` is a parameter of each model; the chosen ids are at most that many, which bounds
    the broadcast. Rows of the held-out fold, null ids and null labels never take part.
    """
    labels = (
        read_table(spark, sf_dir, "labels")
        .filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    return documents.select("doc_id", "text").join(F.broadcast(labels), "doc_id")


#: Bytes of labelled texts that a fit takes at most; with them, its memory is bounded in rows and in bytes.
SAMPLE_BYTES = 128 << 20


def fit_in_one_task(sample: DataFrame, fit: Callable[[np.ndarray, np.ndarray, np.ndarray], object], most_bytes: int = SAMPLE_BYTES):
    """What `fit` makes of the texts and labels of `sample` (from `labelled_sample`), in one task; the driver gets the model alone.

    Texts come in the order of a hash of their ids, until the next would exceed `most_bytes`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, labels, size = [], [], 0
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                one = (text or "").encode()
                size += len(one)
                if size > most_bytes:
                    break
                raw.append(one)
                labels.append(label)
        if raw:
            model = fit(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64), np.array(labels, np.int64))
            yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})

    rows = sample.select("doc_id", "text", "label").repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text").select("text", "label")
    row = rows.mapInArrow(run, "model binary").first()
    return pickle.loads(bytes(row["model"])) if row else fit(np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.int64))
