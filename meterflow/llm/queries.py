"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import collision_dedup, exact_dedup, filter_audit, hard_negatives, license_scan, near_dedup, packing, quality, spotsigs, suffix_dedup, toxicity, url_filter, word_bpe

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_pack": packing.op2_pack,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_quality": quality.op5_quality,
    "op6_word_bpe": word_bpe.op6_word_bpe,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_spotsigs": spotsigs.op8_spotsigs,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_collision_dedup": collision_dedup.op13_collision_dedup,
}

ORACLE = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
    "op13_collision_dedup": collision_dedup.ORACLE,
}
