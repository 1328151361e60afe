"""The queries of this subpackage by name, and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import binary_ids, mixing, near_dedup, neighbours, packing, quality, substring_dedup, token_counts, toxicity, url_filter

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_ann": neighbours.op4_ann,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_mixing": mixing.op6_mixing,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_token_binary": binary_ids.op9_token_binary,
    "op10_near_dedup": near_dedup.op10_near_dedup,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": substring_dedup.oracle_sql(),
    "op2_quality_rules": quality.oracle_sql(),
    "op8_url_filter": url_filter.oracle_sql(),
    "op10_near_dedup": near_dedup.oracle_sql(),
}
