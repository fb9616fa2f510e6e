"""Training-text pipeline over ``documents``; each stage's result is written as Parquet and read back for the next one.

Stages: rows that the quality rules reject go; one document of each group of near copies (five words, Jaccard 0.8) stays; documents
that leak a benchmark item go; personal data is replaced; what is left is packed into sequences of 2048 ids. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from siteloom.llm import disclosure, jaccard_join, packing, quality_rules, templates
from siteloom.llm.registry import read
from siteloom.session import staging_dir


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs, k=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return templates.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return disclosure.sanitise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, 2048, "byte_bpe_50k.json", joined=True)


STAGES = [("quality_rules", good_quality), ("near_copies", without_near_copies), ("benchmark", without_benchmark),
          ("personal_data", without_personal_data), ("packing", packed)]

#: Token ids, sets of n-grams and fitted rates are beyond SQL; tests compare with plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of a folder."""
    docs = read(spark, sf_dir, "documents")
    base = f"{staging_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, step) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
