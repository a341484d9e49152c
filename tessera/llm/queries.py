"""The queries of this package and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from tessera.llm import decontaminate, fixity, jaccard, licenses, mixing, pii, quality, quotes, substrings, urlfilter

QUERIES = {
    "op1_substring_dedup": substrings.op1_substring_dedup,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_chat_formatting": quotes.op3_chat_formatting,
    "op4_pii": pii.op4_pii,
    "op5_jaccard_join": jaccard.op5_jaccard_join,
    "op6_benchmark_decontamination": decontaminate.op6_benchmark_decontamination,
    "op7_license_scans": licenses.op7_license_scans,
    "op8_mixing_sources": mixing.op8_mixing_sources,
    "op9_url_filters": urlfilter.op9_url_filters,
    "op10_merkle_fixity": fixity.op10_merkle_fixity,
}
ORACLE_SQL = {
    "op2_quality_rules": quality.OP2_SQL,
    "op3_chat_formatting": quotes.OP3_SQL,
    "op5_jaccard_join": jaccard.OP5_SQL,
    "op6_benchmark_decontamination": decontaminate.OP6_SQL,
    "op7_license_scans": licenses.OP7_SQL,
    "op8_mixing_sources": mixing.OP8_SQL,
    "op9_url_filters": urlfilter.OP9_SQL,
    "op10_merkle_fixity": fixity.OP10_SQL,
}
