"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import binary, centroids, fingerprints, html_text, jaccard, knn, language, lines, mixing, packing, runs, toxicity, urls

QUERIES = {
    "op1_best_fit_packing": packing.query,
    "op2_token_binary": binary.query,
    "op3_html_extraction": html_text.query,
    "op4_url_filters": urls.query,
    "op5_mixing": mixing.query,
    "op6_toxicity": toxicity.query,
    "op7_topk_search": knn.query,
    "op8_language_id": language.query,
    "op9_fingerprints": fingerprints.query,
    "op10_ngram_jaccard_join": jaccard.query,
    "op11_centroids": centroids.query,
    "op12_line_dedup": lines.query,
    "op13_periodic_runs": runs.query,
}
ORACLE_SQL = {
    "op10_ngram_jaccard_join": jaccard.ORACLE,
    "op11_centroids": centroids.ORACLE,
    "op12_line_dedup": lines.ORACLE,
    "op4_url_filters": urls.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op7_topk_search": knn.ORACLE,
}
