"""Queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, fingerprints, language, mixing, packing, pii, repeats, simhash, tokenfile, topk

QUERIES = {
    "op1_exact_topk": topk.op1_exact_topk,
    "op2_document_fingerprints": fingerprints.op2_document_fingerprints,
    "op3_language_id": language.op3_language_id,
    "op4_pii_surrogates": pii.op4_pii_surrogates,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_pack_documents": packing.op6_pack_documents,
    "op7_repeated_strings": repeats.op7_repeated_strings,
    "op8_chat_format": chat.op8_chat_format,
    "op9_simhash": simhash.op9_simhash,
    "op10_token_files": tokenfile.op10_token_files,
}

ORACLE_SQL = {"op1_exact_topk": topk.ORACLE, "op5_mix_sources": mixing.ORACLE}
