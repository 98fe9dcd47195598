"""The registered queries of this subpackage and the SQL that some are compared with."""

from __future__ import annotations

from . import chat_format, embedding_dedup, language_id, line_dedup, packing, quality_classifier, quality_rules, simhash, source_mixing, token_output

QUERIES = {
    "op1_token_output": token_output.op1_token_output,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_embedding_dedup": embedding_dedup.op3_embedding_dedup,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_simhash_dedup": simhash.op5_simhash_dedup,
    "op6_source_mixing": source_mixing.op6_source_mixing,
    "op7_quality_classifier": quality_classifier.op7_quality_classifier,
    "op8_chat_format": chat_format.op8_chat_format,
    "op9_language_id": language_id.op9_language_id,
    "op10_quality_rules": quality_rules.op10_quality_rules,
}

ORACLE_SQL: dict[str, str] = {
    "op4_line_dedup": line_dedup.ORACLE_SQL,
    "op6_source_mixing": source_mixing.ORACLE_SQL,
    "op10_quality_rules": quality_rules.ORACLE_SQL,
}
