"""The queries of this folder, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tactus.llm import bpe, chat, mixing, pii, quality, sharding, simhash, tokenstore, topk, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_quality_rules": quality.op1_quality_rules,
        "op2_token_store": tokenstore.op2_token_store,
        "op3_byte_bpe": bpe.op3_byte_bpe,
        "op4_simhash": simhash.op4_simhash,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_topk": topk.op6_topk,
        "op7_sharding": sharding.op7_sharding,
        "op8_mixing": mixing.op8_mixing,
        "op9_pii": pii.op9_pii,
        "op10_chat_format": chat.op10_chat_format,
    }


def oracle_sql() -> dict[str, str]:
    found = {
        "op1_quality_rules": quality.SQL,
        "op6_topk": topk.SQL,
        "op8_mixing": mixing.SQL,
        "op10_chat_format": chat.SQL,
    }
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
