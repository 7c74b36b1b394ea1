"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, html, langid, lm, minhash, packing, sharding, topk, toxicity


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every operator over the whole of its table, with its production parameters."""
    return {
        "op1_language": lambda s, d: langid.identify(_t(s, d, "documents")),
        "op2_html_text": lambda s, d: html.extract(_t(s, d, "pages")),
        "op3_chat_windows": lambda s, d: chat.windows(_t(s, d, "conversations")),
        "op4_packing": lambda s, d: packing.pack(_t(s, d, "documents")),
        "op5_decontamination": lambda s, d: decontam.spans(_t(s, d, "documents"), _t(s, d, "benchmark")),
        "op6_toxicity": lambda s, d: toxicity.score(_t(s, d, "documents"), _t(s, d, "labels")),
        "op7_topk_search": lambda s, d: topk.search(_t(s, d, "documents"), _t(s, d, "benchmark")),
        "op8_bits_per_byte": lambda s, d: lm.score(_t(s, d, "documents")),
        "op9_near_duplicates": lambda s, d: minhash.groups(_t(s, d, "documents")),
        "op10_sharding": lambda s, d: sharding.shard(_t(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of those that SQL can express."""
    return {"op3_chat_windows": chat.sql(), "op7_topk_search": topk.sql()}
