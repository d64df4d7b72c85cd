"""The corpus operators as named queries, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docquarry.llm import embedding_dedup, exact_dedup, filter_audit, lexical, mixing, packing, pii, quality, sentencepieces, simhash, substring_dedup, suffix_dedup, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": pii.query,
        "op2_substring_dedup": substring_dedup.query,
        "op3_simhash_near_dedup": simhash.query,
        "op4_quality_classifier": quality.query,
        "op5_exact_dedup": exact_dedup.query,
        "op6_mix_sources": mixing.query,
        "op7_warc": warc.query,
        "op8_embedding_near_dedup": embedding_dedup.query,
        "op9_best_fit_packing": packing.query,
        "op10_suffix_array_dedup": suffix_dedup.query,
        "op11_lexical_search": lexical.query,
        "op12_filter_audit": filter_audit.query,
        "op13_sentencepiece": sentencepieces.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_pii": pii.ORACLE, "op5_exact_dedup": exact_dedup.ORACLE, "op7_warc": warc.ORACLE, "op11_lexical_search": lexical.ORACLE, "op12_filter_audit": filter_audit.ORACLE}
