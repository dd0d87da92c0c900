"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import divergence, exact_dedup, hamming, html_text, jaccard_join, packing, pii, repeats, resampling, segmentation, token_records, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": packing.op1_best_fit_packing,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_pii_surrogates": pii.op3_pii_surrogates,
        "op4_html_text": html_text.op4_html_text,
        "op5_n_best": segmentation.op5_n_best,
        "op6_hamming_top_k": hamming.op6_hamming_top_k,
        "op7_warc": warc.op7_warc,
        "op8_jaccard_join": jaccard_join.op8_jaccard_join,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_token_records": token_records.op10_token_records,
        "op11_importance_resampling": resampling.op11_importance_resampling,
        "op12_source_divergence": divergence.op12_source_divergence,
        "op13_substring_dedup": repeats.op13_substring_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": exact_dedup.ORACLE,
        "op6_hamming_top_k": hamming.ORACLE,
        "op7_warc": warc.ORACLE,
        "op8_jaccard_join": jaccard_join.ORACLE,
        "op11_importance_resampling": resampling.ORACLE,
        "op12_source_divergence": divergence.ORACLE,
        "op13_substring_dedup": repeats.ORACLE,
    }
