"""One query for each corpus operator, over its whole table, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arcspan.llm import chat_format, jaccard_join, line_dedup, packing, piece_lattice, pii, quality_model, quality_rules, substring_dedup, webp

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": piece_lattice.query,
    "op2_quality_classifier": quality_model.query,
    "op3_jaccard_join": jaccard_join.query,
    "op4_quality_rules": quality_rules.query,
    "op5_line_dedup": line_dedup.query,
    "op6_pii": pii.query,
    "op7_lossless_webp": webp.query,
    "op8_best_fit_packing": packing.query,
    "op9_chat_formatting": chat_format.query,
    "op10_substring_dedup": substring_dedup.query,
}

ORACLES: dict[str, str] = {"op5_line_dedup": line_dedup.ORACLE_SQL}
