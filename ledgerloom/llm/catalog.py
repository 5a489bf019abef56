"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import best_fit_packing, bpe, chat_format, exact_dedup, fingerprints, lang_cnn, license_scan, ngram_join, substring_dedup, url_filters

QUERIES = {
    "op1_url_filters": url_filters.op1_url_filters,
    "op2_chat_format": chat_format.op2_chat_format,
    "op3_bpe": bpe.op3_bpe,
    "op4_lang_cnn": lang_cnn.op4_lang_cnn,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_best_fit_packing": best_fit_packing.op7_best_fit_packing,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_license_scan": license_scan.op9_license_scan,
    "op10_fingerprints": fingerprints.op10_fingerprints,
}

ORACLES = {
    "op1_url_filters": url_filters.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
}
