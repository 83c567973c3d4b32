"""Corpus pipeline: stages over documents, each written as Parquet and reread by the next.

Toxic documents go, then documents that the quality rules reject, then all but one of each group of
copies and near copies; what is left is packed into training windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgrid.llm import packing, quality, simhash, toxicity
from quillgrid.llm.common import written
from quillgrid.llm.queries import table, tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("quality_rules", drop_poor), ("simhash_near_dedup", drop_copies), ("packing", pack)]

#: The stages train a model and pack tokens, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
