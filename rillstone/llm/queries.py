"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from . import bpe, exact_dedup, jaccard_join, language, packing, pii, quality, suffix_dedup, toxicity, warc


def queries() -> dict:
    return {
        "op1_bpe": bpe.op1,
        "op2_suffix_dedup": suffix_dedup.op2,
        "op3_packing": packing.op3,
        "op4_quality_rules": quality.op4,
        "op5_toxicity": toxicity.op5,
        "op6_personal_data": pii.op6,
        "op7_warc": warc.op7,
        "op8_language_id": language.op8,
        "op9_jaccard_join": jaccard_join.op9,
        "op10_exact_dedup": exact_dedup.op10,
    }


def oracle_sql() -> dict:
    return {"op4_quality_rules": quality.OP4_SQL, "op7_warc": warc.OP7_SQL, "op10_exact_dedup": exact_dedup.OP10_SQL}
