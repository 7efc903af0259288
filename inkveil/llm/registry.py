"""Queries of the training-data operators and the SQL twins of those that SQL can express."""

from __future__ import annotations

from . import (
    decontamination, html_extraction, line_dedup, lm_scoring, mixing, quality_rules, sharding, simhash, source_divergence, suffix_dedup, token_store,
    toxicity, vector_codes,
)


def queries() -> dict:
    return {
        "op1_token_store": token_store.query,
        "op2_lm_scoring": lm_scoring.query,
        "op3_html_extraction": html_extraction.query,
        "op4_simhash_near_dedup": simhash.query,
        "op5_quality_rules": quality_rules.query,
        "op6_line_dedup": line_dedup.query,
        "op7_decontamination": decontamination.query,
        "op8_mixing": mixing.query,
        "op9_suffix_dedup": suffix_dedup.query,
        "op10_toxicity": toxicity.query,
        "op11_vector_codes": vector_codes.query,
        "op12_sharding": sharding.query,
        "op13_source_divergence": source_divergence.query,
    }


def oracle_sql() -> dict:
    return {
        "op5_quality_rules": quality_rules.SQL,
        "op7_decontamination": decontamination.SQL,
        "op11_vector_codes": vector_codes.SQL,
        "op13_source_divergence": source_divergence.SQL,
    }
