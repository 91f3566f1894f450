"""The registered corpus queries and their DuckDB twins."""

from __future__ import annotations

from . import decontaminate, html_main, language_id, licenses, line_dedup, lm_scoring, mixing, near_dedup, token_store, topk_search

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_token_store": token_store.op2_token_store,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_language_id": language_id.op7_language_id,
    "op8_topk_search": topk_search.op8_topk_search,
    "op9_html_main_text": html_main.op9_html_main_text,
    "op10_lm_scoring": lm_scoring.op10_lm_scoring,
}
ORACLES = {
    "op1_license_scan": licenses.oracle(),
    "op3_decontaminate": decontaminate.oracle(),
    "op4_line_dedup": line_dedup.oracle(),
    "op6_mix_sources": mixing.oracle(),
    "op8_topk_search": topk_search.oracle(),
}
