"""Queries and oracle SQL of the corpus operators."""

from __future__ import annotations

from . import byte_bpe, byte_gru, class_lm, exact_dedup, license_scan, packing, parity_join, syncmers, toxicity, wrappers


def queries() -> dict:
    return {
        "op1_syncmers": syncmers.query,
        "op2_byte_bpe": byte_bpe.query,
        "op3_wrappers": wrappers.query,
        "op4_toxicity": toxicity.query,
        "op5_parity_join": parity_join.query,
        "op6_exact_dedup": exact_dedup.query,
        "op7_packing": packing.query,
        "op8_license_scan": license_scan.query,
        "op9_byte_gru": byte_gru.query,
        "op10_class_lm": class_lm.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": exact_dedup.SQL}
