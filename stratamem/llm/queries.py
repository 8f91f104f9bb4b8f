"""Queries of the training-data operators, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, knn, licenses, line_dedup, media, mixing, near_dedup, quality, token_blocks, token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_dedup": near_dedup.query,
        "op2_token_blocks": token_blocks.query,
        "op3_quality": quality.query,
        "op4_token_counts": token_counts.query,
        "op5_bpe": bpe.query,
        "op6_knn_join": knn.query,
        "op7_line_dedup": line_dedup.query,
        "op8_licenses": licenses.query,
        "op9_media": media.query,
        "op10_mixing": mixing.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_knn_join": knn.SQL,
        "op10_mixing": mixing.SQL,
    }
