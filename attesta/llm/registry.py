"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from attesta.llm import collocations, language_id, licenses, line_dedup, maximal_repeats, packing, pieces, runs, simhash, spotsigs, substring_dedup, token_counts, topk

QUERIES = {
    "op1_line_dedup": line_dedup.op1_query,
    "op2_language_id": language_id.op2_query,
    "op3_substring_dedup": substring_dedup.op3_query,
    "op4_token_counts": token_counts.op4_query,
    "op5_best_fit_packing": packing.op5_query,
    "op6_simhash_near_dedup": simhash.op6_query,
    "op7_document_fingerprints": spotsigs.op7_query,
    "spotsigs_near_pairs": spotsigs.spotsigs_pairs_query,
    "op8_sentencepiece": pieces.op8_query,
    "op9_license_scans": licenses.op9_query,
    "op10_exact_top_k": topk.op10_query,
    "op11_periodic_runs": runs.op11_query,
    "op12_phrase_collocations": collocations.op12_query,
    "op13_suffix_array_dedup": maximal_repeats.op13_query,
}
ORACLE = {"op1_line_dedup": line_dedup.ORACLE, "op9_license_scans": licenses.ORACLE, "op10_exact_top_k": topk.ORACLE, "op12_phrase_collocations": collocations.ORACLE}
