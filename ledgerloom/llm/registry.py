"""Queries of this package and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: query name -> module of this package with ``query`` and, where SQL can express it, ``SQL``
MODULES = {
    "op1_quality": "quality",
    "op2_embedding_dedup": "embedding_dedup",
    "op3_warc": "warc",
    "op4_packing": "packing",
    "op5_mixing": "mixing",
    "op6_minhash_dedup": "minhash_dedup",
    "op7_toxicity": "toxicity",
    "op8_line_cleaning": "line_cleaning",
    "op9_chat": "chat",
    "op10_suffix_dedup": "suffix_dedup",
    "op11_decontamination": "decontamination",
    "op12_whitening": "whitening",
    "op13_alignment": "alignment",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: import_module(f"{__package__}.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
