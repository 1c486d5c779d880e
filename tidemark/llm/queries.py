"""The queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import benchmarks, jaccard, media, mixing, packing, quality, repair, secrets, sharding, structure, substrings, trie, urls

QUERIES = {
    "op1_ngram_jaccard": jaccard.op1_ngram_jaccard,
    "op2_substrings": substrings.op2_substrings,
    "op3_sharding": sharding.op3_sharding,
    "op4_mixing": mixing.op4_mixing,
    "op5_media": media.op5_media,
    "op6_secrets": secrets.op6_secrets,
    "op7_quality": quality.op7_quality,
    "op8_packing": packing.op8_packing,
    "op9_token_ids": repair.op9_token_ids,
    "op10_url_filters": urls.op10_url_filters,
    "op11_structure_repair": structure.op11_structure_repair,
    "op12_decontamination": benchmarks.op12_decontamination,
    "op13_prefix_trie": trie.op13_prefix_trie,
}
ORACLE: dict[str, str] = {
    "op4_mixing": mixing.oracle_sql(),
    "op7_quality": quality.oracle_sql(),
    "op10_url_filters": urls.oracle_sql(),
    "op11_structure_repair": structure.oracle_sql(),
    "op12_decontamination": benchmarks.oracle_sql(),
    "op13_prefix_trie": trie.oracle_sql(),
}
