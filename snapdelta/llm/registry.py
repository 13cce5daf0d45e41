"""Queries of the corpus operators, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, jaccard_join, oracles, quality_gam, quality_rules, secrets, sharding, substring_dedup, token_shards, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_jaccard_join": jaccard_join.op1,
        "op2_sharding": sharding.op2,
        "op3_bpe": bpe.op3,
        "op4_secret_scans": secrets.op4,
        "op5_toxicity": toxicity.op5,
        "op6_quality_rules": quality_rules.op6,
        "op7_token_shards": token_shards.op7,
        "op8_quality_classifier": quality_gam.op8,
        "op9_decontamination": decontaminate.op9,
        "op10_substring_dedup": substring_dedup.op10,
    }


def oracle_sql() -> dict[str, str]:
    """For the others, tests/llm compares with brute force, exact round trips or held-out accuracy."""
    return {"op1_jaccard_join": oracles.JACCARD_JOIN, "op10_substring_dedup": oracles.SUBSTRING_DEDUP}
