"""Fingerprints, first-wins distinct, order and risk of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as T


def findings(drafts: DataFrame, names: DataFrame) -> DataFrame:
    """Drafts with fingerprint and status; `names` has pair_id and the newer side's name. One row for each fingerprint, the earliest draft."""
    named = drafts.join(names.select("pair_id", F.col("name").alias("package")), "pair_id", "left")
    printed = named.withColumn("fingerprint", T.fingerprint(F.coalesce("package", F.lit("")), "id", "identity"))
    w = Window.partitionBy("pair_id", "fingerprint").orderBy("draft_ord", "draft_sub")
    return printed.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k", "package").withColumn("status", F.lit("new"))


def ordered(found: DataFrame) -> DataFrame:
    """Adds ord: severity and score falling, then id, then draft order, within each pair."""
    w = Window.partitionBy("pair_id").orderBy(T.rank("severity").desc(), F.desc("score"), "id", "draft_ord", "draft_sub")
    return found.withColumn("ord", F.row_number().over(w))


def risk(found: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """score, level, counts by severity, new and baseline; every pair of `pairs` has a row."""
    new = F.col("status") == "new"
    got = found.groupBy("pair_id").agg(
        F.least(F.lit(100), F.coalesce(F.sum(F.when(new, F.col("score"))), F.lit(0))).cast("int").alias("score"),
        *[F.count_if(new & (F.col("severity") == s)).alias(s) for s in rules.SEVERITIES],
        F.count_if(new).alias("new_findings"), F.count_if(~new).alias("baseline_findings"),
    )
    if pairs is not None:
        got = pairs.select("pair_id").distinct().join(got, "pair_id", "left").fillna(0)
    return got.withColumn("level", T.level("score"))


def apply_baseline(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings whose fingerprint is accepted get the status baseline. `baseline` may hold pair_id as well."""
    keys = [k for k in ("pair_id", "fingerprint") if k in baseline.columns]
    marked = found.drop("status").join(baseline.select(*keys).distinct().withColumn("accepted", F.lit(True)), keys, "left")
    return marked.withColumn("status", F.when(F.col("accepted"), "baseline").otherwise("new")).drop("accepted")


def confusion(cases: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """tp, fp, tn, fn of boolean columns, and precision, recall and false-positive rate (0 for nothing)."""
    y, p = F.col(label), F.col(predicted)
    got = cases.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"))
    share = lambda a, b: F.when(F.col(a) + F.col(b) == 0, 0.0).otherwise(F.col(a) / (F.col(a) + F.col(b)))
    return got.withColumns({"precision": share("tp", "fp"), "recall": share("tp", "fn"), "false_positive_rate": share("fp", "tn")})
