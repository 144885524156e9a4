"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, chat_format, decontaminate, near_dedup, pii, quality_model, quality_rules, sessions, substring_dedup, suffix_dedup, token_count, toxicity, whitening

QUERIES = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_bpe": bpe.op5_bpe,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_quality_model": quality_model.op7_quality_model,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_token_count": token_count.op10_token_count,
    "op11_sessions": sessions.op11_sessions,
    "op12_pii": pii.op12_pii,
    "op13_whitening": whitening.op13_whitening,
}
ORACLE_SQL = {
    "op1_chat_format": chat_format.ORACLE_SQL,
    "op2_decontaminate": decontaminate.ORACLE_SQL,
    "op3_quality_rules": quality_rules.ORACLE_SQL,
    "op4_suffix_dedup": suffix_dedup.ORACLE_SQL,
    "op6_substring_dedup": substring_dedup.ORACLE_SQL,
    "op8_near_dedup": near_dedup.ORACLE_SQL,
    "op11_sessions": sessions.ORACLE_SQL,
}
