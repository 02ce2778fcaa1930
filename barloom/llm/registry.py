"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from barloom.llm import html_extract, jaccard, langid, lexical_search, packing, pieces, quality, secrets, token_counts, token_files, url_filter, vectors, whitening

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_embedding_dedup": vectors.op2_embedding_dedup,
    "op3_html_extract": html_extract.op3_html_extract,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_token_files": token_files.op7_token_files,
    "op8_ngram_jaccard": jaccard.op8_ngram_jaccard,
    "op9_sentencepiece": pieces.op9_sentencepiece,
    "op10_packing": packing.op10_packing,
    "op11_lexical_search": lexical_search.op11_lexical_search,
    "op12_token_counts": token_counts.op12_token_counts,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
}
ORACLE_SQL = {
    "op2_embedding_dedup": vectors.OP2_SQL,
    "op6_url_filter": url_filter.OP6_SQL,
    "op8_ngram_jaccard": jaccard.OP8_SQL,
    "op11_lexical_search": lexical_search.OP11_SQL,
}
