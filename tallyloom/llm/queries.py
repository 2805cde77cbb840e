"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroid_clusters, chat_format, decontaminate, embedding_dedup, html_text, jaccard_join, line_dedup, mixing, periodic_runs, quality_crf, quality_rules, suffix_dedup, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_suffix_dedup": suffix_dedup.query,
        "op2_jaccard_join": jaccard_join.query,
        "op3_quality_crf": quality_crf.query,
        "op4_quality_rules": quality_rules.query,
        "op5_toxicity": toxicity.query,
        "op6_decontaminate": decontaminate.query,
        "op7_html_text": html_text.query,
        "op8_chat_format": chat_format.query,
        "op9_mix_sources": mixing.query,
        "op10_line_dedup": line_dedup.query,
        "op11_embedding_dedup": embedding_dedup.query,
        "op12_periodic_runs": periodic_runs.query,
        "op13_centroid_clusters": centroid_clusters.query,
    }


def oracle_sql() -> dict[str, str]:
    named = {"op1_suffix_dedup": suffix_dedup, "op2_jaccard_join": jaccard_join, "op8_chat_format": chat_format, "op9_mix_sources": mixing, "op10_line_dedup": line_dedup, "op11_embedding_dedup": embedding_dedup, "op13_centroid_clusters": centroid_clusters}
    return {k: m.ORACLE_SQL for k, m in named.items()}
