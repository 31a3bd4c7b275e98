"""Queries over whole tables, one for each operator, and their SQL where SQL can say the same."""

from __future__ import annotations

from . import decontamination, hmm_lm, line_dedup, minhash, mixing, quality_classifier, quality_rules, sharding, token_counts, token_output

QUERIES = {
    "op1_line_frequency": quality_rules.op1_line_frequency,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_token_output": token_output.op3_token_output,
    "op4_hmm_language_model": hmm_lm.op4_hmm_language_model,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_sharding": sharding.op6_sharding,
    "op7_mixing": mixing.op7_mixing,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_minhash": minhash.op9_minhash,
    "op10_quality_classifier": quality_classifier.op10_quality_classifier,
}

ORACLES = {
    "op1_line_frequency": quality_rules.ORACLE_SQL,
    "op2_decontamination": decontamination.ORACLE_SQL,
    "op5_line_dedup": line_dedup.ORACLE_SQL,
    "op7_mixing": mixing.ORACLE_SQL,
    "op9_minhash": minhash.ORACLE_SQL,
}
