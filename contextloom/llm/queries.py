"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from contextloom.llm import decontam, exact_dedup, licenses, mixing, near_dup, packing, pii, preference, quality, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_source_mixing": mixing.op1,
        "op2_ngram_jaccard_join": near_dup.op2,
        "op3_exact_dedup": exact_dedup.op3,
        "op4_personal_data": pii.op4,
        "op5_quality": quality.op5,
        "op6_token_packing": packing.op6,
        "op7_toxicity": toxicity.op7,
        "op8_preference_format": preference.op8,
        "op9_benchmark_decontamination": decontam.op9,
        "op10_license_scan": licenses.op10,
    }


def oracle_sql() -> dict[str, str]:
    """Without SQL, and tested against brute force instead: the trained and seeded ones, mixing and packing."""
    return {
        "op2_ngram_jaccard_join": near_dup.OP2_SQL,
        "op3_exact_dedup": exact_dedup.OP3_SQL,
        "op8_preference_format": preference.OP8_SQL,
        "op9_benchmark_decontamination": decontam.OP9_SQL,
        "op10_license_scan": licenses.oracle(),
    }
