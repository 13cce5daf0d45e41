"""Connected components by alternating large and small stars (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, rewrite


def components(edges: DataFrame) -> DataFrame:
    """`id` and `label`, the smallest id that its edges reach, for every end of the edges (u, v: long).

    Each half step is one minimum by key and one join on that key; no neighbour list is ever
    gathered. The loop ends when a round changes no edge, after about the logarithm of the
    longest path. The edges of a round are removed once those of the next are written.
    """
    e = rewrite(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "edges")
    before = None
    while True:
        after = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if before == after or after["n"] == 0:
            return e.select(F.col("u").alias("id"), F.col("v").alias("label")).union(e.select(F.col("v").alias("id"), F.col("v").alias("label"))).distinct()
        before = after
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("u", "v", "m")
        last, e = e, rewrite(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(last)
