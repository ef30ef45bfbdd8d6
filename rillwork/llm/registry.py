"""The queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rillwork.llm import bpe, decontaminate, html_extract, jaccard, language_id, pii, quality, sharding, suffix_dedup, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": jaccard.query,
    "op2_benchmark_decontamination": decontaminate.query,
    "op3_language_id": language_id.query,
    "op4_quality_classifier": quality.query,
    "op5_byte_bpe": bpe.query,
    "op6_sharding": sharding.query,
    "op7_suffix_array_dedup": suffix_dedup.query,
    "op8_exact_topk": topk.query,
    "op9_pii": pii.query,
    "op10_html_extraction": html_extract.query,
}

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": jaccard.SQL,
    "op6_sharding": sharding.SQL,
    "op8_exact_topk": topk.SQL,
}
