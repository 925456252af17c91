"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terraloom.llm import collocations, html_main, media, merkle, mixing, near_dedup, packing, pii, quality_rules, run_index, secret_scan, substring_dedup, token_store


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_source_mixing": mixing.op1_source_mixing,
        "op2_near_dedup": near_dedup.op2_near_dedup,
        "op3_substring_dedup": substring_dedup.op3_substring_dedup,
        "op4_personal_data": pii.op4_personal_data,
        "op5_media_columns": media.op5_media_columns,
        "op6_sequence_packing": packing.op6_sequence_packing,
        "op7_secret_scan": secret_scan.op7_secret_scan,
        "op8_huffman_tokens": token_store.op8_huffman_tokens,
        "op9_main_text": html_main.op9_main_text,
        "op10_quality_rules": quality_rules.op10_quality_rules,
        "op11_run_index": run_index.op11_run_index,
        "op12_merkle_manifest": merkle.op12_merkle_manifest,
        "op13_collocations": collocations.op13_collocations,
        "instruction_packing": packing.instruction_packing,
        "media_clips": media.media_clips,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_source_mixing": mixing.OP1_SQL, "op12_merkle_manifest": merkle.OP12_SQL, "op13_collocations": collocations.OP13_SQL}
