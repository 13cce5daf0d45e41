"""Two snapshots of keyed files against each other: one shuffle by (pair_id, path)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMMARY = ("path", "size", "sha256", "mode", "mode_known", "kind")


def status(before: Column, after: Column) -> Column:
    """added, removed, modified or unchanged, from two structs of which one may be null.

    A change of mode counts only where both modes are known.
    """
    moded = before["mode_known"] & after["mode_known"] & (before["mode"] != after["mode"])
    return F.when(before.isNull(), "added").when(after.isNull(), "removed").when((before["sha256"] != after["sha256"]) | F.coalesce(moded, F.lit(False)), "modified").otherwise("unchanged")


def diff(files: DataFrame) -> DataFrame:
    """pair_id, path, status and both summaries for every path of either side."""
    side = lambda s: files.filter(F.col("side") == s).select("pair_id", "path", F.struct(*SUMMARY).alias(s))
    joined = side("before").join(side("after"), ["pair_id", "path"], "full_outer")
    return joined.select("pair_id", "path", status(F.col("before"), F.col("after")).alias("status"), "before", "after")


def changed(inventory: DataFrame) -> DataFrame:
    """Paths that the newer side added or modified."""
    return inventory.filter(F.col("status").isin("added", "modified"))


def counts(inventory: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return inventory.groupBy("pair_id").agg(n("added"), n("removed"), n("modified"), n("unchanged"))


def totals(files: DataFrame) -> DataFrame:
    """Bytes of regular files by pair and side."""
    size = lambda s: F.coalesce(F.sum(F.when((F.col("side") == s) & (F.col("kind") != "symlink"), F.col("size"))), F.lit(0)).alias(f"{s}_bytes")
    return files.groupBy("pair_id").agg(size("before"), size("after"))


def is_spike(before: Column, after: Column, floor: int = 1_000_000, factor: float = 1.5) -> Column:
    return (after - before).cast("double") > F.greatest(F.lit(float(floor)), before * factor)
