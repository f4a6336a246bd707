"""Queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from tessera.llm import alignment, bpe, chat, fingerprint, jaccard, language, lm, media, mixing, quality, sharding, simhash, trie

QUERIES = {
    "op1_document_fingerprints": fingerprint.op1_document_fingerprints,
    "op2_media_columns": media.op2_media_columns,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op4_bpe_codec": bpe.op4_bpe_codec,
    "op5_source_mixing": mixing.op5_source_mixing,
    "op6_ngram_jaccard": jaccard.op6_ngram_jaccard,
    "op7_sharding": sharding.op7_sharding,
    "op8_quality": quality.op8_quality,
    "op9_language_id": language.op9_language_id,
    "op10_lm_scoring": lm.op10_lm_scoring,
    "op11_token_alignment": alignment.op11_token_alignment,
    "op12_prefix_trie": trie.op12_prefix_trie,
    "op13_simhash": simhash.op13_simhash,
}
ORACLES = {
    "op3_chat_formatting": chat.OP3_SQL,
    "op5_source_mixing": mixing.mixing_sql(),
    "op7_sharding": sharding.OP7_SQL,
    "op10_lm_scoring": lm.OP10_SQL,
    "op12_prefix_trie": trie.OP12_SQL,
}
