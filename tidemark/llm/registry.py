"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import licenses, near_dedup, order_minhash, packing, pii, quality, sentencepiece_sa, sharding, suffix_dedup, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_sharding": sharding.op2_sharding,
    "op3_pii": pii.op3_pii,
    "op4_packing": packing.op4_packing,
    "op5_order_minhash": order_minhash.op5_order_minhash,
    "op6_sentencepiece": sentencepiece_sa.op6_sentencepiece,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_license_scan": licenses.op10_license_scan,
}
ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": quality.OP1_SQL,
    "op2_sharding": sharding.op2_sql(),
    "op8_near_dedup": near_dedup.OP8_SQL,
    "op9_suffix_dedup": suffix_dedup.OP9_SQL,
    "op10_license_scan": licenses.OP10_SQL,
}
