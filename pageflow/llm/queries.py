"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, near_dup, packing, quality_model, quality_rules, sharding, token_counts, token_output, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": quality_model.op1,
        "op2_token_output": token_output.op2,
        "op3_decontamination": decontaminate.op3,
        "op4_quality_rules": quality_rules.op4,
        "op5_packing": packing.op5,
        "op6_near_dedup": near_dup.op6,
        "op7_chat_formatting": chat.op7,
        "op8_warc": warc.op8,
        "op9_token_counts": token_counts.op9,
        "op10_sharding": sharding.op10,
    }


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that SQL can express; the others have brute-force tests."""
    return {"op6_near_dedup": near_dup.ORACLE, "op7_chat_formatting": chat.ORACLE, "op8_warc": warc.ORACLE}
