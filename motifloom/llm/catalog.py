"""Queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from motifloom.llm import chat, decontaminate, hilbert, jaccard, langid, packing, quality, tokencount, tokenids, topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": langid.op1_language_id,
        "op2_quality": quality.op2_quality,
        "op3_token_ids": tokenids.op3_token_ids,
        "op4_token_counts": tokencount.op4_token_counts,
        "op5_exact_top_k": topk.op5_exact_top_k,
        "op6_chat_format": chat.op6_chat_format,
        "op7_hilbert_shards": hilbert.op7_hilbert_shards,
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_lexical_packing": packing.op9_lexical_packing,
        "op10_ngram_jaccard": jaccard.op10_ngram_jaccard,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_exact_top_k": topk.OP5_SQL,
        "op6_chat_format": chat.OP6_SQL,
        "op10_ngram_jaccard": jaccard.OP10_SQL,
    }
