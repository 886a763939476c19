"""The queries of this subpackage, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import bytebpe, lattice, minhash, packing, quality, rules, toxicity, urlfilter, vectors, webarchive
from tessella.llm._shared import HELD_OUT_SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": webarchive.op1_warc,
        "op2_byte_bpe": bytebpe.op2_byte_bpe,
        "op3_best_fit_packing": packing.op3_best_fit_packing,
        "op4_url_filter": urlfilter.op4_url_filter,
        "op4_rules": urlfilter.op4_rules,
        "op5_embedding_near_dedup": vectors.op5_embedding_near_dedup,
        "op6_toxicity": toxicity.op6_toxicity,
        "op6_folds": toxicity.op6_folds,
        "op7_quality_classifier": quality.op7_quality_classifier,
        "op7_folds": quality.op7_folds,
        "op8_minhash_near_dedup": minhash.op8_minhash_near_dedup,
        "op9_quality_rules": rules.op9_quality_rules,
        "op9_base": rules.op9_base,
        "op10_subword_lattice": lattice.op10_subword_lattice,
        "op10_base": lattice.op10_base,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": webarchive.OP1_SQL,
        "op4_rules": urlfilter.OP4_RULES_SQL,
        "op5_embedding_near_dedup": vectors.OP5_SQL,
        "op6_folds": HELD_OUT_SQL,
        "op7_folds": HELD_OUT_SQL,
        "op9_base": rules.OP9_BASE_SQL,
        "op10_base": lattice.OP10_BASE_SQL,
    }
