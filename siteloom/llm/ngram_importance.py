"""Importance resampling towards a target text: hashed n-gram counts of the corpus and of the target give every document a weight.

A text is lowered (A-Z only), all runs of separators become one space, and one pattern, scanned with overlapping matches between
boundary lookarounds, gives at every word the spans of the runs of 1 to ``n`` words that begin there. Each span's bytes go to the
bucket CRC-32 modulo ``buckets``; nothing is joined or copied to make an n-gram.

``scan`` reads every text once and stages its bucket numbers, two bytes a feature. From them come the corpus counts (a sum a task,
then a sum a bucket) and, once the gains are known, each document's weight. What returns to the driver is one number a bucket.
``draw`` adds Gumbel noise from the key's hash, so that taking the highest scores draws without replacement in proportion
to exp(weight / 1000); ranks come from range partitions, never from one sorted task.

Defined cases: a null or empty text, or one without words, has no features and weight 0; a null key hashes as an empty one
and follows other keys in ties; repeated rows count and are drawn each, rows equal in score and key in any order; an empty table
gives no rows; without any target text all gains follow the corpus alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siteloom.llm.order import numbered
from siteloom.session import stage

#: Separators of words: ASCII other than digits and letters.
GAP = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def folding() -> bytes:
    """A byte table: A-Z to a-z, separators to a space."""
    return bytes(32 if GAP[c] else c + 32 if 65 <= c <= 90 else c for c in range(256))


def run_pattern(n: int) -> bytes:
    """At a word's begin: group k is the k-th word of a run of at most ``n``; a run begins and ends at a space."""
    rest = b""
    for _ in range(n - 1):
        rest = rb"(?:( [^ ]+)" + rest + rb")?"
    return rb"(?<= )([^ ]+)" + rest + rb"(?= )"


def features(text: str | None, pattern, table: bytes) -> tuple[list[int], int]:
    """CRC-32 of every run of words of a text, and its number of words."""
    from zlib import crc32

    flat = b" ".join([b"", *(text or "").encode().translate(table).split(), b""])
    found, words = [], 0
    for m in pattern.finditer(flat, overlapped=True):
        words += 1
        at = m.start()
        for k in range(1, pattern.groups + 1):
            end = m.end(k)
            if end < 0:
                break
            found.append(crc32(flat[at:end]))
    return found, words


def scan(docs: DataFrame, key: str, text: str, n: int, buckets: int) -> DataFrame:
    """(key, n_words, n_features, hits): hits are the bucket numbers as little-endian 16-bit integers."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must fit into 16 bits")
    table, source = folding(), run_pattern(n)

    def each(batches):
        import regex

        pattern = regex.compile(source)
        for batch in batches:
            words, counts, hits = [], [], []
            for body in batch.column(1):
                found, many = features(body.as_py(), pattern, table)
                words.append(many)
                counts.append(len(found))
                hits.append((np.array(found, np.int64) % buckets).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(counts, pa.int64()), pa.array(hits, pa.binary())],
                                             names=["key", "n_words", "n_features", "hits"])

    held = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return held.mapInArrow(each, f"key {held.schema['key'].dataType.simpleString()}, n_words long, n_features long, hits binary")


def joined_hits(column) -> np.ndarray:
    """The bucket numbers of all rows of a batch, one after the other."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u2")


def bucket_counts(scanned: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n): features of all texts; each task sends one row a bucket that it met."""
    def each(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(joined_hits(batch.column(0)), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    return scanned.select("hits").mapInArrow(each, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gain(t: Column, s: Column, all_t: int, all_s: int, buckets: int) -> Column:
    """Thousandths of the log-ratio of a bucket's smoothed shares of target and corpus, rounded down."""
    d = lambda x: x.cast("double")
    return F.floor(1000 * F.log((d(t) + 1) * F.lit(float(all_s + buckets)) / ((d(s) + 1) * F.lit(float(all_t + buckets)))))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of every bucket, as an array of ``buckets`` numbers."""
    sums = [x.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"] for x in (corpus, target)]
    both = corpus.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full")
    at = both.select("bucket", gain(F.coalesce("t", F.lit(0)), F.coalesce("s", F.lit(0)), sums[1], sums[0], buckets).alias("gain"))
    none = corpus.sparkSession.range(1).select(gain(F.lit(0), F.lit(0), sums[1], sums[0], buckets).alias("gain")).first()["gain"]
    out = np.full(buckets, none, np.int64)
    for r in at.collect():
        out[r["bucket"]] = r["gain"]
    return out


def weights(scanned: DataFrame, gain_of: np.ndarray) -> DataFrame:
    """``scanned`` without its hits, with ``weight``: the floored mean gain of a text's features, 0 if it has none."""
    def each(batches):
        for batch in batches:
            many = batch.column(2).to_numpy().astype(np.int64)
            running = np.concatenate([[0], np.cumsum(gain_of[joined_hits(batch.column(3))])])
            ends = np.cumsum(many)
            total = running[ends] - running[ends - many]
            weight = np.where(many > 0, total // np.maximum(many, 1), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64())], names=["key", "n_words", "n_features", "weight"])

    kind = scanned.schema["key"].dataType.simpleString()
    return scanned.select("key", "n_words", "n_features", "hits").mapInArrow(each, f"key {kind}, n_words long, n_features long, weight long")


def noise(key: Column, seed: int) -> Column:
    """Thousandths of a standard Gumbel number from the first eight hex digits of SHA-256 of "seed:key", rounded down."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def draw(weighed: DataFrame, percent: int, least_words: int, seed: int) -> DataFrame:
    """``weighed`` with ``score`` and ``rank``: 1, 2, ... for the drawn ``percent`` of rows of at least ``least_words`` words, else null."""
    rows = stage(weighed.withColumn("score", F.col("weight") + noise(F.col("key"), seed)))
    fit = F.col("n_words") >= least_words
    many = rows.filter(fit).count() * percent // 100
    order = rows.filter(fit).withColumns({"__down": -F.col("score"), "__none": F.col("key").isNull()})
    ranked = numbered(order, ["__down", "__none", "key"]).withColumn("rank", F.when(F.col("__n") < many, F.col("__n") + 1))
    rest = rows.filter(~fit).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*rest.columns).unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, n: int = 2, buckets: int = 10_000, least_words: int = 20, seed: int = 7,
             key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_words, n_features, weight, score, rank of every row of ``docs``; ``target`` holds texts in a column ``text``."""
    scanned = stage(scan(docs, key, text, n, buckets))
    wanted = scan(target.select(F.lit(0).alias("key"), F.col(text).alias("text")), "key", "text", n, buckets)
    gain_of = gains(stage(bucket_counts(scanned, buckets)), stage(bucket_counts(wanted, buckets)), buckets)
    return draw(weights(scanned, gain_of), percent, least_words, seed).withColumnRenamed("key", key)
