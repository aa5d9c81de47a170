"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from gaugeworks.llm import decontaminate, fingerprints, language_id, lexical_search, licenses, mixing, ngram_join, prefix_trie, quality, repeats, token_files, url_filter, warc

QUERIES = {
    "op1_token_files": token_files.op1_token_files,
    "op2_warc": warc.op2_warc,
    "op3_licenses": licenses.op3_licenses,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_language_id": language_id.op5_language_id,
    "op6_repeats": repeats.op6_repeats,
    "op7_quality": quality.op7_quality,
    "op8_fingerprints": fingerprints.op8_fingerprints,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_mixing": mixing.op10_mixing,
    "op11_url_filter": url_filter.op11_url_filter,
    "op12_search": lexical_search.op12_search,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}
ORACLE_SQL = {"op2_warc": warc.ORACLE, "op4_ngram_join": ngram_join.ORACLE, "op9_decontaminate": decontaminate.ORACLE, "op12_search": lexical_search.ORACLE, "op13_prefix_trie": prefix_trie.ORACLE}
