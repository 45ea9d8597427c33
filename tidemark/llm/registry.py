"""The queries of this folder by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, fingerprints, html_text, importance, language_id, maxent_lm, mixing, near_dedup, oracle, prefix_trie, quality, secret_scan, url_filter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_byte_bpe": byte_bpe.query,
        "op2_quality": quality.query,
        "op3_near_dedup": near_dedup.query,
        "op4_secret_scan": secret_scan.query,
        "op5_language_id": language_id.query,
        "op6_mixing": mixing.query,
        "op7_html_text": html_text.query,
        "op8_warc": warc.query,
        "op9_maxent_lm": maxent_lm.query,
        "op10_fingerprints": fingerprints.query,
        "op11_importance": importance.query,
        "op12_prefix_trie": prefix_trie.query,
        "op13_url_filter": url_filter.query,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.all_sql()
