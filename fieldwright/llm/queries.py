"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from fieldwright.llm import decontaminate, jaccard, language_id, mixing, mpeg_audio, packing, prefix_trie, ranked_search, substring_dedup, suffix_dedup, tokens, url_filter, warc

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_mpeg_audio": mpeg_audio.op2_mpeg_audio,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_mixing": mixing.op4_mixing,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_warc": warc.op6_warc,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_token_files": tokens.op8_token_files,
    "op9_jaccard_join": jaccard.op9_jaccard_join,
    "op10_language_id": language_id.op10_language_id,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_ranked_search": ranked_search.op12_ranked_search,
    "op13_best_fit_packing": packing.op13_best_fit_packing,
}

SQL = {
    "op1_suffix_dedup": suffix_dedup.OP1_SQL,
    "op4_mixing": mixing.OP4_SQL,
    "op5_url_filter": url_filter.OP5_SQL,
    "op6_warc": warc.OP6_SQL,
    "op7_substring_dedup": substring_dedup.OP7_SQL,
    "op9_jaccard_join": jaccard.OP9_SQL,
    "op11_prefix_trie": prefix_trie.OP11_SQL,
    "op12_ranked_search": ranked_search.OP12_SQL,
}
