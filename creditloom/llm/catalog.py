"""Registered queries of the package and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from creditloom.llm import (
    decontaminate, exact_dedup, language_id, line_dedup, merkle, near_dedup, packing, resample, sentence_dedup, suffix_dedup, token_files, toxicity, url_filter)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": packing.query,
    "op2_language_id": language_id.query,
    "op3_toxicity": toxicity.query,
    "op4_substring_dedup": sentence_dedup.query,
    "op5_exact_dedup": exact_dedup.query,
    "op6_minhash_near_dedup": near_dedup.query,
    "op7_decontamination": decontaminate.query,
    "op8_url_filter": url_filter.query,
    "op9_line_dedup": line_dedup.query,
    "op10_suffix_array_dedup": suffix_dedup.query,
    "op11_merkle_manifest": merkle.query,
    "op12_token_files": token_files.query,
    "op13_resampling": resample.query,
}
SQL: dict[str, str] = {
    "op4_substring_dedup": sentence_dedup.SQL,
    "op5_exact_dedup": exact_dedup.SQL,
    "op6_minhash_near_dedup": near_dedup.SQL,
    "op7_decontamination": decontaminate.SQL,
    "op9_line_dedup": line_dedup.SQL,
    "op11_merkle_manifest": merkle.SQL,
    "op13_resampling": resample.SQL,
}
