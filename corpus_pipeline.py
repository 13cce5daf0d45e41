"""A corpus through a chain of operators; each stage's rows are written and read by the next.

ORACLE_SQL is None: learnt models and retrieval have no SQL; tests/llm compares the stages
with brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from snapdelta.llm import bpe, decontaminate, jaccard_join, quality_gam, secrets
from snapdelta.llm.shared import discard, read_table, rewrite

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_gam.stage),
    ("jaccard_join", jaccard_join.stage),
    ("decontamination", decontaminate.stage),
    ("secret_scans", secrets.stage),
    ("bpe", bpe.stage),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to the documents of `sf_dir`, in order; the rows between two stages are removed once the next are written.

    Null and empty texts have no words: the classifier scores them like any other text, no later
    stage drops or changes them. Rows without doc_id pass the join and decontamination. Repeated
    rows are one document each to the classifier and the scans, and stay or go together in the
    join. Empty tables give an empty result. Extra columns reach the last stage unchanged,
    whatever their names.
    """
    docs, before = read_table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = rewrite(docs, f"pipeline_{k}_{name}")
            if before is not None:
                discard(before)
            before = docs
    return docs
