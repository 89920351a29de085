"""The queries of this subpackage and, where SQL can express them, their oracle SQL."""

from . import byte_bpe, exact_dedup, lm_scoring, mixing, pii, quality_classifier, quality_rules, simhash, substring_dedup, token_output

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_token_output": token_output.op2_token_output,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_lm_scoring": lm_scoring.op4_lm_scoring,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_byte_bpe": byte_bpe.op6_byte_bpe,
    "op7_quality_classifier": quality_classifier.op7_quality_classifier,
    "op8_pii": pii.op8_pii,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_simhash": simhash.op10_simhash,
}

ORACLES = {
    "op5_substring_dedup": substring_dedup.OP5_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
}
