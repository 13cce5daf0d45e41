"""Sharding: a uniform shuffle into shards of exact size, by hypergeometric counts.

Rows lie in logical source partitions. How many rows each source sends to each shard is drawn
as one multivariate hypergeometric matrix whose margins are the exact partition and shard
sizes. Each source permutes its rows and cuts the permutation by its line of the matrix, the
rows are exchanged, and each shard permutes what it got. This is the law `rows`: shard sizes
differ by one at most, and every arrangement is as likely as any other.

Everything but the matrix is DataFrame code. The matrix has a line for each source partition,
not for each row; its size is fixed by `sources`. A shard is permuted in blocks chosen by a
random key, whose sizes are summed first, so that no task holds a whole shard. Row keys hash
a position in a checkpoint, so equal rows, a hot id or source and nulls spread like others.
A null id stays null; a null text has size 16 and the checksum of nothing; repeated rows get
a slot each; an empty table gives an empty result. Other columns are ignored. Groups of equal
texts have no meaning under this law: copies are shuffled like all rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, fanout, read_table

SHARDS, LAW = 40, "rows"


def communication_matrix(sizes: np.ndarray, targets: np.ndarray, seed: int) -> np.ndarray:
    """counts[i, j] rows from source i to shard j; rows sum to `sizes`, columns to `targets`."""
    r = np.random.default_rng(seed)
    left = targets.astype(np.int64).copy()
    out = np.zeros((len(sizes), len(targets)), np.int64)
    for i, n in enumerate(sizes):
        rest, pool = int(n), int(left.sum())
        for j in range(len(left)):
            pool -= int(left[j])
            out[i, j] = hypergeometric(r, int(left[j]), pool, rest)
            rest -= int(out[i, j])
        left -= out[i]
    return out


def hypergeometric(r: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of `n` draws from good + bad are good. Pools beyond numpy's limit are drawn by
    the ratios of neighbouring probabilities, over 12 standard deviations beside the mode."""
    if bad == 0 or good == 0 or n == 0:
        return n if bad == 0 else 0
    if good + bad < 10**9:
        return int(r.hypergeometric(good, bad, n))
    low, high = max(0, n - bad), min(n, good)
    mean = n * (good / (good + bad))
    reach = 12 * int(np.sqrt(mean * (bad / (good + bad))) + 2)
    k = np.arange(max(low, int(mean) - reach), min(high, int(mean) + reach) + 1, dtype=np.float64)
    steps = np.log(good - k[:-1]) + np.log(n - k[:-1]) - np.log(k[:-1] + 1) - np.log(bad - n + k[:-1] + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    chance = np.cumsum(np.exp(logs - logs.max()))
    return int(k[np.searchsorted(chance, r.random() * chance[-1], "right")])


def shard(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, seed: int = 2, sources: int = 256, block_rows: int = 1 << 20) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for every row of `docs`."""
    keyed = cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
            F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        )
    ).withColumn("place", F.monotonically_increasing_id())
    key = lambda k: F.xxhash64("place", F.lit(seed * 1000 + k))
    keyed = keyed.select("doc_id", "size", "text_crc32", F.pmod(key(0), F.lit(sources)).cast("int").alias("source"), key(1).alias("order1"), key(2).alias("order2"), "place")
    sizes = np.zeros(sources, np.int64)
    for row in keyed.groupBy("source").count().collect():  # one row for each of `sources`
        sizes[row["source"]] = row["count"]
    total = int(sizes.sum())
    targets = total // shards + (np.arange(shards) < total % shards)
    cuts = np.cumsum(communication_matrix(sizes, targets, seed), axis=1)
    table = spark.createDataFrame([(i, [int(x) for x in line]) for i, line in enumerate(cuts)], "source int, cuts array<long>")
    first = Window.partitionBy("source").orderBy("order1", "place")
    sent = (
        keyed.withColumn("rank", F.row_number().over(first))
        .join(F.broadcast(table), "source")
        .withColumn("shard", F.size(F.filter("cuts", lambda c: c < F.col("rank"))))
    )
    blocks = max(1, -(-total // (shards * block_rows)), -(-fanout(spark) // shards))
    sent = cut(sent.select("doc_id", "size", "text_crc32", "shard", F.pmod("order2", F.lit(blocks)).cast("int").alias("block"), F.shiftright("order2", 1).alias("order2"), "place"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = sent.groupBy("shard", "block").count().withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).select("shard", "block", "base")
    second = Window.partitionBy("shard", "block").orderBy("order2", "place")
    return sent.withColumn("rank", F.row_number().over(second)).join(base, ["shard", "block"]).select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - 1).alias("slot"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(spark, read_table(spark, sf_dir, "documents"))
    return out.withColumn("law", F.lit(LAW)).withColumn("grown_shard", F.lit(None).cast("int"))
