"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from toolweave.llm import (
    chat, decontaminate, fill_middle, html_text, language, licenses, mixing, ngram_join, personal_data, quality, substring_dedup,
    url_filter, vector_codes,
)

QUERIES = {
    "op1_decontaminate": decontaminate.query,
    "op2_licenses": licenses.query,
    "op3_ngram_join": ngram_join.query,
    "op4_quality": quality.query,
    "op5_chat": chat.query,
    "op6_mixing": mixing.query,
    "op7_language": language.query,
    "op8_url_filter": url_filter.query,
    "op9_substring_dedup": substring_dedup.query,
    "op10_html_text": html_text.query,
    "op11_personal_data": personal_data.query,
    "op12_fill_middle": fill_middle.query,
    "op13_vector_codes": vector_codes.query,
}

ORACLES = {
    "op1_decontaminate": decontaminate.ORACLE_SQL,
    "op3_ngram_join": ngram_join.ORACLE_SQL,
    "op4_quality": quality.ORACLE_SQL,
    "op5_chat": chat.ORACLE_SQL,
    "op8_url_filter": url_filter.ORACLE_SQL,
    "op9_substring_dedup": substring_dedup.ORACLE_SQL,
    "op12_fill_middle": fill_middle.ORACLE_SQL,
    "op13_vector_codes": vector_codes.ORACLE_SQL,
}
