"""Queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import chat_rotation, exact_dedup, langid, lexical, license_scan, mixing, ngram_join, partitions, sentencepiece_dropout, spelling, suffix_dedup, topk, warc

QUERIES = {
    "op1_sentencepiece_dropout": sentencepiece_dropout.op1_sentencepiece_dropout,
    "op2_ngram_jaccard_join": ngram_join.op2_ngram_jaccard_join,
    "op3_source_mixing": mixing.op3_source_mixing,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_suffix_array_dedup": suffix_dedup.op5_suffix_array_dedup,
    "op6_chat_rotation": chat_rotation.op6_chat_rotation,
    "op7_warc": warc.op7_warc,
    "op8_language_id": langid.op8_language_id,
    "op9_exact_topk": topk.op9_exact_topk,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_learned_partitions": partitions.op11_learned_partitions,
    "op12_lexical_search": lexical.op12_lexical_search,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

ORACLE_SQL: dict[str, str] = {
    "op4_license_scan": license_scan.ORACLE_SQL,
    "op6_chat_rotation": chat_rotation.ORACLE_SQL,
    "op7_warc": warc.ORACLE_SQL,
    "op9_exact_topk": topk.ORACLE_SQL,
    "op10_exact_dedup": exact_dedup.ORACLE_SQL,
    "op12_lexical_search": lexical.ORACLE_SQL,
}
