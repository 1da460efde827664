"""Queries of the corpus operators, by name, and the SQL that DuckDB can run for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe_codec, decontaminate, exact_dedup, lm_scoring, near_dedup, prefix_trie, quality, quality_rules, secret_scan, token_store, url_filter, vector_codes, warc_archive

OPERATORS = {
    "op1_lm_scoring": lm_scoring,
    "op2_quality": quality,
    "op3_near_dedup": near_dedup,
    "op4_url_filter": url_filter,
    "op5_token_store": token_store,
    "op6_warc_archive": warc_archive,
    "op7_exact_dedup": exact_dedup,
    "op8_secret_scan": secret_scan,
    "op9_decontaminate": decontaminate,
    "op10_bpe_codec": bpe_codec,
    "op11_vector_codes": vector_codes,
    "op12_prefix_trie": prefix_trie,
    "op13_quality_rules": quality_rules,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: module.query for name, module in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in OPERATORS.items() if hasattr(module, "SQL")}
