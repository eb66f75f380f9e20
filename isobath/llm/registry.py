"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from isobath.llm import decontamination, fill_middle, jaccard_join, language_id, line_dedup, near_dedup, packing, pii, quality_rules, secrets_scan, spelling, substring_dedup, token_counts

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_secrets": secrets_scan.op3_secrets,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_packing": packing.op7_packing,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_language_id": language_id.op10_language_id,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_fill_middle": fill_middle.op12_fill_middle,
    "op13_jaccard_join": jaccard_join.op13_jaccard_join,
}
SQL = {
    "op5_near_dedup": f"SELECT *, doc_id = component_id AS kept FROM ({jaccard_join.COMPONENTS_SQL.format(k=4, percent=80)})",
    "op6_quality_rules": quality_rules.OP6_SQL,
    "op8_line_dedup": line_dedup.OP8_SQL,
    "op9_substring_dedup": substring_dedup.OP9_SQL,
    "op11_spelling_variants": spelling.OP11_SQL,
    "op12_fill_middle": fill_middle.OP12_SQL,
    "op13_jaccard_join": jaccard_join.OP13_SQL,
}
