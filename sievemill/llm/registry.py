"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from sievemill.llm import curriculum, decontaminate, exact_dedup, kneser_ney, ppm, resample, simhash, substring_dedup, suffix_dedup, token_counts, top_k, url_filter, vector_codes

QUERIES = {
    "op1_substring_dedup": substring_dedup,
    "op2_url_filter": url_filter,
    "op3_suffix_dedup": suffix_dedup,
    "op4_ppm": ppm,
    "op5_kneser_ney": kneser_ney,
    "op6_token_counts": token_counts,
    "op7_decontaminate": decontaminate,
    "op8_simhash": simhash,
    "op9_exact_dedup": exact_dedup,
    "op10_curriculum": curriculum,
    "op11_resample": resample,
    "op12_vector_codes": vector_codes,
    "op13_top_k": top_k,
}


def queries():
    return {name: module.query for name, module in QUERIES.items()}


def oracle_sql():
    return {name: module.SQL for name, module in QUERIES.items() if getattr(module, "SQL", None)}
