"""Queries of the training-data operators, by name. Each module is loaded when its query is run."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

NAMES = {
    "op1_sentencepiece": "sentencepiece_lattice",
    "op2_toxicity": "toxicity",
    "op3_chat_formatting": "chat_format",
    "op4_token_counts": "token_counts",
    "op5_html_extraction": "html_extract",
    "op6_pii": "pii",
    "op7_decontamination": "decontaminate",
    "op8_near_dedup": "near_dedup",
    "op9_fingerprints": "fingerprints",
    "op10_language_id": "language_id",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def of(module: str) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: import_module(f"{__package__}.{module}").query(spark, sf_dir)

    return {name: of(module) for name, module in NAMES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None) for name, module in NAMES.items()}
    return {name: sql for name, sql in found.items() if sql}
