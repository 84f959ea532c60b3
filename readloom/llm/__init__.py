"""Operators for training-data pipelines. Nothing else in the library imports this package."""

from __future__ import annotations


def _ops() -> dict:
    from readloom.llm import bpe, exact_dedup, jaccard_join, language_id, mixing, pii, prefix_trie, quality, sharding, source_audit, suffix_dedup, token_files, url_filter

    return {
        "op1_quality_rules": (quality.op1_quality_rules, quality.ORACLE),
        "op2_exact_dedup": (exact_dedup.op2_exact_dedup, exact_dedup.ORACLE),
        "op3_sharding": (sharding.op3_sharding, sharding.ORACLE),
        "op4_pii": (pii.op4_pii, None),
        "op5_token_files": (token_files.op5_token_files, None),
        "op6_suffix_dedup": (suffix_dedup.op6_suffix_dedup, suffix_dedup.ORACLE),
        "op7_jaccard_join": (jaccard_join.op7_jaccard_join, jaccard_join.ORACLE),
        "op8_mixing": (mixing.op8_mixing, mixing.ORACLE),
        "op9_url_filter": (url_filter.op9_url_filter, url_filter.ORACLE),
        "op10_bpe": (bpe.op10_bpe, None),
        "op11_prefix_trie": (prefix_trie.op11_prefix_trie, prefix_trie.ORACLE),
        "op12_source_audit": (source_audit.op12_source_audit, source_audit.ORACLE),
        "op13_language_id": (language_id.op13_language_id, None),
    }


def queries() -> dict:
    return {name: query for name, (query, _) in _ops().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ops().items() if sql}
