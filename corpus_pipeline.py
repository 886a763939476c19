"""A corpus pipeline: bad documents go by the quality classifier and the quality rules, one document of each group of near
copies stays, and the rest is packed into training sequences.

Each stage takes all documents that the one before it kept, and returns them with the columns of `documents`; the last
returns the packed pieces.

Columns of any name pass through every stage but the last. Null and empty texts, null ids, repeated rows and empty tables are
taken as the operators say: a null text is an empty one (the rules reject it), rows that repeat are judged each and one of
them stays after the near-duplicates, null ids take part, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import minhash, packing, quality, rules
from tessella.llm._shared import free_name, last_written, materialise, scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at the threshold or above; the classifier learns from labelled ones among docs."""
    margins, bias = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = free_name(docs, "_score")
    return quality.score(docs, margins, bias, out=out).where(f"{out} >= {quality.THRESHOLD}").drop(out)


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return rules.good_documents(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each class of near copies."""
    return minhash.one_of_each(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their sequences and places."""
    return packing.packed_documents(docs)


STAGES = [("quality classifier", quality_stage), ("quality rules", rules_stage), ("near-duplicates", dedup_stage), ("packing", packing_stage)]

#: SQL can't express the stages; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of documents; a stage's tables are deleted when the next one has been written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch(spark, before):
            docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        before = last_written()
    return docs
