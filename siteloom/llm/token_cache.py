"""Token counts through a cache keyed by digests of the normalised text and of the tokenizer's file.

The cache is a Parquet folder of (tokenizer, digest, n_tokens). A run digests every text, takes the counts that are there,
encodes only the distinct texts that are not, appends their counts in one job and joins again. A lost append leaves nothing behind;
two runs that append the same digests agree, and reading takes one row of each.

Normalising folds runs of ASCII white space to one space and trims them. It must not change any count: the tokenizer named
by the caller has to fold white space itself (``fold=True``), otherwise texts are digested as they are.

Defined cases: a null text is empty, 0 tokens; equal texts are encoded once; an empty table appends nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siteloom.llm.textkit import encoder
from siteloom.session import stage

CACHE = "tokenizer string, digest binary, n_tokens long"


def tokenizer_digest(name: str) -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer version; a folder that isn't there yet is an empty cache."""
    try:
        rows = spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], CACHE)
    return rows.filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def normalised(text: Column, fold: bool) -> Column:
    body = F.coalesce(text, F.lit(""))
    return F.trim(F.regexp_replace(body, "[ \\t\\n\\x0B\\f\\r]+", " ")) if fold else body


def count_tokens(docs: DataFrame, path: str, name: str, fold: bool = True, joined: bool = False, key: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """``key``, n_bytes (UTF-8 of the text as it is), n_tokens of every row; the cache at ``path`` grows by what it lacked."""
    spark, version = docs.sparkSession, tokenizer_digest(name)
    digest = F.unhex(F.sha2(F.col("body"), 256))
    keyed = stage(docs.select(F.col(key).alias("key"), F.col(text).alias("raw")).select(
        "key", F.octet_length(F.coalesce("raw", F.lit(""))).cast("long").alias("n_bytes"), normalised(F.col("raw"), fold).alias("body")
    ).select("key", "n_bytes", digest.alias("digest")))

    known = read_cache(spark, path, version)
    bodies = docs.select(normalised(F.col(text), fold).alias("body")).select(digest.alias("digest"), "body")
    misses = bodies.dropDuplicates(["digest"]).join(known, "digest", "left_anti")

    def encode(batches):
        enc = encoder(name, joined)
        for batch in batches:
            found = [np.zeros(0, np.int64)] + [counts for _, _, counts in enc.encode(batch.column("body"))]
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(batch), pa.string()), batch.column("digest"), pa.array(np.concatenate(found))],
                                             names=["tokenizer", "digest", "n_tokens"])

    misses.mapInArrow(encode, CACHE).write.mode("append").parquet(path)
    return keyed.join(read_cache(spark, path, version), "digest").select(F.col("key").alias(key), "n_bytes", "n_tokens")
