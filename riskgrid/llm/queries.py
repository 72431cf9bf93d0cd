"""Registry of the training-data queries and their oracle SQL."""

from __future__ import annotations

import corpus_pipeline

from . import embeddings, language, lexical, manifest, packing, pages, parsing, pieces, privacy, sharding, simhash, substrings, tokencount

QUERIES: dict = {
    "op1_html_extraction": pages.op1_html_extraction,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_simhash": simhash.op3_simhash,
    "op4_language_id": language.op4_language_id,
    "op5_embedding_dedup": embeddings.op5_embedding_dedup,
    "op6_sentencepiece": pieces.op6_sentencepiece,
    "op7_fingerprints": parsing.op7_fingerprints,
    "op8_personal_data": privacy.op8_personal_data,
    "op9_token_counts": tokencount.op9_token_counts,
    "op10_substring_dedup": substrings.op10_substring_dedup,
    "op11_resharding": sharding.op11_resharding,
    "op12_lexical_search": lexical.op12_lexical_search,
    "op13_merkle_manifest": manifest.op13_merkle_manifest,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict = {"op5_embedding_dedup": embeddings.ORACLE_OP5, "op10_substring_dedup": substrings.ORACLE_OP10, "op12_lexical_search": lexical.ORACLE_OP12, "op13_merkle_manifest": manifest.ORACLE_OP13}
