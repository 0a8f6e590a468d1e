"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, conversation_repair, decontaminate, html_extract, lm_score, mixing, near_dedup, neighbours, periodic, pii, quality, sharding, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_html_extraction": html_extract.op2_html_extraction,
        "op3_pii": pii.op3_pii,
        "op4_sharding": sharding.op4_sharding,
        "op5_decontamination": decontaminate.op5_decontamination,
        "op6_quality_rules": quality.op6_quality_rules,
        "op7_near_dedup": near_dedup.op7_near_dedup,
        "op8_chat_formatting": chat_format.op8_chat_formatting,
        "op9_lm_scoring": lm_score.op9_lm_scoring,
        "op10_mixing": mixing.op10_mixing,
        "op11_nearest_neighbours": neighbours.op11_nearest_neighbours,
        "op12_conversation_repair": conversation_repair.op12_conversation_repair,
        "op13_periodic_runs": periodic.op13_periodic_runs,
        "quality_ablation": quality.quality_ablation,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_quality_rules": quality.ORACLE, "quality_ablation": quality.ORACLE_ABLATION, "op7_near_dedup": near_dedup.ORACLE, "op8_chat_formatting": chat_format.ORACLE, "op9_lm_scoring": lm_score.ORACLE}
