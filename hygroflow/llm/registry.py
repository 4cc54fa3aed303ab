"""Queries of this folder and the SQL that checks those which SQL can express."""

from __future__ import annotations

from hygroflow.llm import (
    decontamination,
    exact_dedup,
    html_extraction,
    importance,
    jaccard_join,
    language_id,
    packing,
    piece_codec,
    prefix_trie,
    secret_scans,
    sharding,
    toxicity,
    url_filters,
)

QUERIES = {
    "op1_exact_dedup": exact_dedup.query,
    "op2_ngram_jaccard_join": jaccard_join.query,
    "op3_toxicity": toxicity.query,
    "op4_decontamination": decontamination.query,
    "op5_packing": packing.query,
    "op6_html_extraction": html_extraction.query,
    "op7_secret_scans": secret_scans.query,
    "op8_sharding": sharding.query,
    "op9_url_filters": url_filters.query,
    "op10_language_id": language_id.query,
    "op11_sentencepiece": piece_codec.query,
    "op12_importance_resampling": importance.query,
    "op13_prefix_trie": prefix_trie.query,
}

ORACLE_SQL = {
    "op1_exact_dedup": exact_dedup.ORACLE_SQL,
    "op2_ngram_jaccard_join": jaccard_join.ORACLE_SQL,
    "op4_decontamination": decontamination.ORACLE_SQL,
    "op9_url_filters": url_filters.ORACLE_SQL,
    "op12_importance_resampling": importance.ORACLE_SQL,
    "op13_prefix_trie": prefix_trie.ORACLE_SQL,
}
