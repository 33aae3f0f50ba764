"""Queries of the subpackage and their DuckDB twins."""

from tarn.llm import decontaminate, exact_dedup, filter_audit, html_extract, language_id, license_scan, mixing, ngram_join, pii, sharding, spelling, token_store, url_filter

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_mixing": mixing.op2_mixing,
    "op3_sharding": sharding.op3_sharding,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_token_store": token_store.op6_token_store,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_language_id": language_id.op10_language_id,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_html_extract": html_extract.op12_html_extract,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}
ORACLES = {"op9_exact_dedup": exact_dedup.OP9_SQL, "op11_filter_audit": filter_audit.OP11_SQL}
