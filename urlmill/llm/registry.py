"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from . import chat, divergence, html, jaccard, minhash, mixing, pieces, pii, quality, substrings, token_files, topk, trie

QUERIES = {
    "op1_ngram_jaccard": jaccard.query,
    "op2_sentencepiece": pieces.query,
    "op3_chat_format": chat.query,
    "op4_html_extract": html.query,
    "op5_token_files": token_files.query,
    "op6_pii": pii.query,
    "op7_quality_rules": quality.query,
    "op8_mix_sources": mixing.query,
    "op9_exact_topk": topk.query,
    "op10_substring_dedup": substrings.query,
    "op11_source_divergence": divergence.query,
    "op12_prefix_trie": trie.query,
    "op13_minhash_dedup": minhash.query,
}
ORACLES = {
    "op1_ngram_jaccard": jaccard.SQL,
    "op3_chat_format": chat.SQL,
    "op7_quality_rules": quality.SQL,
    "op8_mix_sources": mixing.SQL,
    "op9_exact_topk": topk.SQL,
    "op10_substring_dedup": substrings.SQL,
    "op11_source_divergence": divergence.SQL,
    "op12_prefix_trie": trie.SQL,
    "op13_minhash_dedup": minhash.SQL,
}
