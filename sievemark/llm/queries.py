"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, chat, collocations, exact_dedup, hard_negatives, html_main, mixing, near_dedup, ring_shard, secret_scan, spotsigs, suffix_dedup, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_byte_bpe": byte_bpe.op2_byte_bpe,
    "op3_ring_shards": ring_shard.op3_ring_shards,
    "op4_minhash_dedup": near_dedup.op4_minhash_dedup,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_secret_scan": secret_scan.op6_secret_scan,
    "op7_prefix_chat": chat.op7_prefix_chat,
    "op8_spotsigs": spotsigs.op8_spotsigs,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_html_main": html_main.op11_html_main,
    "op12_collocations": collocations.op12_collocations,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = exact_dedup.ORACLE_SQL | chat.ORACLE_SQL | collocations.ORACLE_SQL | hard_negatives.ORACLE_SQL
