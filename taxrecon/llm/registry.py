"""The queries and SQL of this subpackage, by the names under which they are registered. The pipeline, which stands
outside, is registered beside them."""

from __future__ import annotations

from collections.abc import Callable

from . import alignment, attention, exact_dedup, html_extract, language, line_dedup, mixing, near_dedup, packing, periodic_runs, sentence_dedup, tokens, topk_search

QUERIES: dict[str, Callable] = {
    "op1_pack_power_of_two": packing.op1_pack_power_of_two,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "exact_index_changes": exact_dedup.exact_index_changes,
    "op4_token_counts": tokens.op4_token_counts,
    "op5_jaccard_join": near_dedup.op5_jaccard_join,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_language_id": language.op7_language_id,
    "op8_extract_html": html_extract.op8_extract_html,
    "op9_sentence_dedup": sentence_dedup.op9_sentence_dedup,
    "op10_top_k_search": topk_search.op10_top_k_search,
    "op11_quality_attention": attention.op11_quality_attention,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_align_tokenizers": alignment.op13_align_tokenizers,
}

#: The others have no SQL: they depend on a tokenizer, trained automata or weights, hash functions, page parsing or
#: recursion over a document's words.
ORACLES: dict[str, str] = {
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "exact_index_changes": exact_dedup.EXACT_INDEX_CHANGES_SQL,
    "op6_mix_sources": mixing.OP6_SQL,
    "op10_top_k_search": topk_search.OP10_SQL,
}
