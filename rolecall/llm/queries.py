"""The registered queries of this subpackage and their oracle SQL."""

import corpus_pipeline
from rolecall.llm import bpe_codec, centroid_clusters, decontamination, html_extraction, language_id, line_dedup, lm_scoring, quality_rules, simhash_dedup, substring_dedup, topk_search, url_filters, vector_codes

QUERIES = {
    "op1_simhash_dedup": simhash_dedup.op1_simhash_dedup,
    "op2_url_filters": url_filters.op2_url_filters,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_lm_scoring": lm_scoring.op5_lm_scoring,
    "op6_bpe_codec": bpe_codec.op6_bpe_codec,
    "op7_html_extraction": html_extraction.op7_html_extraction,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_language_id": language_id.op9_language_id,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_centroid_clusters": centroid_clusters.op12_centroid_clusters,
    "op13_topk_search": topk_search.op13_topk_search,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op4_line_dedup": line_dedup.ORACLE,
    "op10_quality_rules": quality_rules.ORACLE,
    "op11_vector_codes": vector_codes.ORACLE,
    "op12_centroid_clusters": centroid_clusters.ORACLE,
    "op13_topk_search": topk_search.ORACLE,
}
