"""Queries and oracle SQL of the training-data operators, by name."""

from __future__ import annotations

from . import decontaminate, exact_dedup, jaccard, mixing, pii, quality, repeats, secrets, token_counts, url_filters

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_jaccard_join": jaccard.op2_jaccard_join,
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_pii": pii.op6_pii,
    "op7_repeats": repeats.op7_repeats,
    "op8_url_filters": url_filters.op8_url_filters,
    "op9_secrets": secrets.op9_secrets,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}

ORACLE_SQL = {
    "op1_mixing": mixing.ORACLE,
    "op2_jaccard_join": jaccard.ORACLE,
    "op5_decontamination": decontaminate.ORACLE,
    "op7_repeats": repeats.ORACLE,
    "op8_url_filters": url_filters.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
}
