"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from mercato.llm import bpe, collocation, decontaminate, fingerprint, jaccard, language_id, line_dedup, packing, pii, spelling, suffix_dedup, toxicity, url_filter

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_decontaminate": decontaminate.query,
    "op3_ngram_jaccard": jaccard.query,
    "op4_suffix_dedup": suffix_dedup.query,
    "op5_toxicity": toxicity.query,
    "op6_language_id": language_id.query,
    "op7_fingerprint": fingerprint.query,
    "op8_url_filter": url_filter.query,
    "op9_best_fit_packing": packing.query,
    "op10_pii": pii.query,
    "op11_spelling_variants": spelling.query,
    "op12_collocations": collocation.query,
    "op13_byte_bpe": bpe.query,
}

ORACLE = {
    "op1_line_dedup": line_dedup.SQL,
    "op2_decontaminate": decontaminate.SQL,
    "op8_url_filter": url_filter.SQL,
    "op12_collocations": collocation.SQL,
}
