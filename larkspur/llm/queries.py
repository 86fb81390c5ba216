"""Queries of the corpus operators and the SQL forms of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import chat, decontaminate, divergence, embeddings, licenses, mixing, quality, secrets, simhash, substrings, tokens, toxicity, whitening

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_mix_sources": mixing.query,
    "op2_count_tokens": tokens.query,
    "op3_remove_repeats": substrings.query,
    "op4_simhash_groups": simhash.query,
    "op5_embedding_groups": embeddings.query,
    "op6_benchmark_matches": decontaminate.query,
    "op7_scan_licenses": licenses.query,
    "op8_scan_secrets": secrets.query,
    "op9_score_quality": quality.query,
    "op10_score_toxicity": toxicity.query,
    "op11_audit_sources": divergence.query,
    "op12_whiten_embeddings": whitening.query,
    "op13_format_chats": chat.query,
}

ORACLES = {
    "op1_mix_sources": mixing.SQL,
    "op3_remove_repeats": substrings.SQL,
    "op5_embedding_groups": embeddings.SQL,
    "op11_audit_sources": divergence.SQL,
}
