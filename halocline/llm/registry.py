"""Queries of the corpus operators and, where SQL can say the same, their DuckDB SQL."""

from halocline.llm import decontaminate, divergence, fingerprint, hard_negatives, jaccard_join, language_id, language_model, license_scan, line_dedup, mixing, near_dedup, token_files, toxicity

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_fingerprints": fingerprint.op2_fingerprints,
    "op3_mixing": mixing.op3_mixing,
    "op4_token_files": token_files.op4_token_files,
    "op5_language_id": language_id.op5_language_id,
    "op6_language_model": language_model.op6_language_model,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_near_dedup": near_dedup.op13_near_dedup,
}
ORACLE_SQL = {
    "op1_license_scan": license_scan.SQL,
    "op2_fingerprints": fingerprint.SQL,
    "op10_line_dedup": line_dedup.SQL,
    "op11_source_divergence": divergence.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
}
