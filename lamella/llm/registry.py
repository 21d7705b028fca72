"""The training-data queries and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lamella.llm import audit, bpe, gridjoin, licenses, media, mixing, partenum, resampling, scoring, secretscan, toxicity, wrapper


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_scoring": scoring.op1_lm_scoring,
        "op2_html_extraction": wrapper.op2_html_extraction,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_mix_sources": mixing.op4_mix_sources,
        "op5_media_columns": media.op5_media_columns,
        "op6_near_duplicates": partenum.op6_near_duplicates,
        "op7_bpe_round_trip": bpe.op7_bpe_round_trip,
        "op8_token_counts": bpe.op8_token_counts,
        "op9_embedding_near_duplicates": gridjoin.op9_embedding_near_duplicates,
        "op10_license_scan": licenses.op10_license_scan,
        "op11_importance_resampling": resampling.op11_importance_resampling,
        "op12_secret_scan": secretscan.op12_secret_scan,
        "op13_filter_audit": audit.op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_mix_sources": mixing.ORACLE_SQL,
        "op11_importance_resampling": resampling.ORACLE_SQL,
        "op12_secret_scan": secretscan.ORACLE_SQL,
        "op13_filter_audit": audit.ORACLE_SQL,
    }
