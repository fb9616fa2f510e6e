"""Quality by the perplexity of an interpolated modified Kneser-Ney trigram model of symbols, trained on trusted texts.

Symbols are UTF-8 bytes, digits folded to one and white space to one. A text becomes its distinct trigrams with counts, split by
the shard of the middle symbol b: every count that the probability of c after ab needs - abc, ab, bc and b - has b in it, so
a shard's table answers for all its trigrams. Texts travel as these packed counts, not as rows a trigram.

Training sums the packed counts of all trusted texts; discounts come from counts of counts (n1 to n4), continuation counts from
the trigram table, all by grouped sums and joins of count tables. Scoring co-groups packed texts with the tables of their shard, dealt
by salt so that a group holds about ``GROUP`` texts at any corpus size. A language's threshold is a quantile of its trusted
texts' perplexities (of all trusted texts, where a language has none).

Defined cases: texts of fewer than three symbols (null, empty) have no perplexity and are not kept; repeated rows get equal
results; labels that name one text several times must agree that it is trusted; without trusted texts all perplexities are
256 and all such texts are kept; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siteloom.llm.textkit import WHITE, text_slices
from siteloom.session import stage

SHARDS, GROUP = 4, 10_000
FOLD = np.arange(256, dtype=np.int64)
FOLD[48:58] = 48
FOLD[WHITE] = 32


def packed_counts(column: pa.Array):
    """(row, shard, packed trigrams and counts, symbols) for every document of the column and shard it has trigrams of."""
    for first, buf, offsets in text_slices(column):
        n = int(offsets[-1])
        if n < 3:
            continue
        b = FOLD[buf[:n]]
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        inside = owner[:-2] == owner[2:]
        code = (owner[:-2] << 32 | b[1:-1] % SHARDS << 24 | b[:-2] << 16 | b[1:-1] << 8 | b[2:])[inside]
        code, count = np.unique(code, return_counts=True)
        cuts = np.flatnonzero(np.concatenate([[True], code[1:] >> 24 != code[:-1] >> 24])) if len(code) else []
        for a, z in zip(cuts, np.append(cuts[1:], len(code)) if len(code) else []):
            part = np.empty((2, z - a), np.uint32)
            part[0] = np.diff(code[a:z] & 0xFFFFFF, prepend=0)
            part[1] = count[a:z]
            planes = part.ravel().view(np.uint8).reshape(-1, 4).T.tobytes()
            yield first + int(code[a] >> 32), int(code[a] >> 24 & 0xFF), zlib.compress(planes, 1), int(count[a:z].sum())


def unpacked(cell: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zlib.decompress(cell), np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel().astype(np.int64)
    half = len(raw) // 2
    return np.cumsum(raw[:half]), raw[half:]


def pack(docs: DataFrame, columns: str) -> DataFrame:
    """Columns of ``docs`` other than text, and shard, pack, symbols: a row for each text and shard."""
    names = [c for c in docs.columns if c != "text"]

    def scan(batches):
        for batch in batches:
            rows, shards, packs, symbols = [], [], [], []
            for row, shard, cell, n in packed_counts(batch.column("text")):
                rows.append(row)
                shards.append(shard)
                packs.append(cell)
                symbols.append(n)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in names], pa.array(shards, pa.int32()), pa.array(packs, pa.binary()), pa.array(symbols, pa.int64())],
                                             names=[*names, "shard", "pack", "symbols"])

    return docs.mapInArrow(scan, f"{columns}, shard int, pack binary, symbols long")


def trigram_counts(packs: DataFrame) -> DataFrame:
    """(code, n): trigrams of all packs; each task sums its own before the shuffle."""
    def add(batches):
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            parts = [unpacked(x.as_py()) for x in batch.column("pack")]
            every = np.concatenate([codes, *[c for c, _ in parts]])
            codes, back = np.unique(every, return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, *[n for _, n in parts]]), minlength=len(codes)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], names=["code", "n"])

    return packs.select("pack").mapInArrow(add, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of the column n, by the usual formulas; halves where counts of counts are missing."""
    row = counts.agg(*[F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (row[f"n{k}"] for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.75, 1.0
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def discount(d: tuple, n: Column) -> Column:
    return F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])


def contexts(counts: DataFrame, d: tuple, *by: str) -> DataFrame:
    """total and gamma (the mass left to lower orders) of each context."""
    left = F.sum(discount(d, F.col("n")))
    return counts.groupBy(*by).agg(F.sum("n").alias("total"), (left / F.sum("n")).alias("gamma"))


def model_rows(counts: DataFrame) -> DataFrame:
    """(shard, kind, code, value): 3 log-probability of a seen trigram, 2 probability of c after b, 1 of c; 13 and 12 the gammas of ab and b."""
    g3 = stage(counts.select(F.shiftright("code", 16).alias("a"), (F.shiftright("code", 8).bitwiseAND(F.lit(255))).alias("b"),
                             F.col("code").bitwiseAND(F.lit(255)).alias("c"), "n"))
    g2 = stage(g3.groupBy("b", "c").agg(F.count(F.lit(1)).alias("n")))
    g1 = stage(g2.groupBy("c").agg(F.count(F.lit(1)).alias("n")))
    d3, d2, d1 = discounts(g3), discounts(g2), discounts(g1)
    every = g1.agg(F.sum("n").alias("n"), F.sum(discount(d1, F.col("n"))).alias("left")).first()
    total, left = (every["n"], every["left"]) if every["n"] else (1, 1.0)
    p1 = stage(g1.select("c", ((F.col("n") - discount(d1, F.col("n")) + left / 256) / total).alias("p1")))
    x2 = stage(contexts(g2, d2, "b"))
    p2 = stage(g2.join(x2, "b").join(p1, "c").select("b", "c", ((F.col("n") - discount(d2, F.col("n"))) / F.col("total") + F.col("gamma") * F.col("p1")).alias("p2")))
    x3 = stage(contexts(g3, d3, "a", "b"))
    p3 = g3.join(x3, ["a", "b"]).join(p2, ["b", "c"]).select(
        "a", "b", "c", F.log((F.col("n") - discount(d3, F.col("n"))) / F.col("total") + F.col("gamma") * F.col("p2")).alias("value"))
    row = lambda df, kind, code, value: df.select((F.col("b") % SHARDS).cast("int").alias("shard"), F.lit(kind).alias("kind"), code.alias("code"), F.col(value).alias("value"))
    a, b, c = (F.col(x).cast("long") for x in "abc")
    out = row(p3, 3, a * 65536 + b * 256 + c, "value").union(row(p2, 2, b * 256 + c, "p2")).union(row(x3, 13, a * 256 + b, "gamma")).union(row(x2, 12, b, "gamma"))
    # A symbol's own probability serves every shard; -1 holds that of a symbol never seen, so no shard's table is empty.
    ones = p1.select(F.lit(1).alias("kind"), c.alias("code"), F.col("p1").alias("value")).union(
        counts.sparkSession.range(1).select(F.lit(1), F.lit(-1).cast("long"), F.lit(left / 256 / total)))
    return stage(out.union(ones.select(F.explode(F.array(*map(F.lit, range(SHARDS)))).alias("shard"), "kind", "code", "value")))


def score_group(texts: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
    """Sum of log-probabilities of each packed text of one shard."""
    part = {k: (t["code"].to_numpy(), t["value"].to_numpy()) for k, t in table.groupby("kind")}
    none = (np.zeros(0, np.int64), np.zeros(0))
    ones = part.get(1, none)
    p1 = np.full(257, ones[1][ones[0] == -1][0] if len(ones[0]) else 1 / 256)
    p1[ones[0][ones[0] >= 0]] = ones[1][ones[0] >= 0]
    g2, g3 = np.ones(256), np.ones(1 << 16)
    g2[part.get(12, none)[0]] = part.get(12, none)[1]
    g3[part.get(13, none)[0]] = part.get(13, none)[1]
    codes = np.arange(1 << 16)
    p2 = g2[codes >> 8] * p1[codes & 255]
    p2[part.get(2, none)[0]] = part.get(2, none)[1]
    seen, value = part.get(3, none)
    order = np.argsort(seen)
    seen, value = np.append(seen[order], 1 << 40), np.append(value[order], 0.0)
    out = np.zeros(len(texts))
    for i, cell in enumerate(texts["pack"]):
        code, count = unpacked(cell)
        at = np.searchsorted(seen, code)
        lp = np.where(seen[at] == code, value[at], np.log(g3[code >> 8] * p2[code & 0xFFFF]))
        out[i] = lp @ count
    return pd.DataFrame({"key": texts["key"], "id": texts["id"], "lp": out, "symbols": texts["symbols"]})


def perplexities(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, id, lang, trusted, perplexity of every row of ``docs``. ``trusted`` holds the keys of the trusted texts."""
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    # The list of trusted keys grows with the corpus, so it is never broadcast.
    good = stage(trusted.select(F.col(key).alias("key")).distinct()).hint("merge")
    packs = pack(rows.select("key", "text"), f"key {kind}").select("key", "pack")
    model = model_rows(trigram_counts(packs.join(good, "key", "left_semi")))

    narrow = stage(rows.select("key", "id", "lang").join(good.select(F.col("key").alias("g")), F.col("key") == F.col("g"), "left")
                   .select("key", "id", "lang", F.col("g").isNotNull().alias("trusted")))
    salts = 1 + narrow.count() // GROUP
    salt = F.pmod(F.xxhash64("key", "id"), F.lit(salts)).cast("int")
    texts = pack(rows.select("key", "id", "text"), f"key {kind}, id long").withColumn("salt", salt)
    tables = model.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    scored = texts.groupBy("shard", "salt").cogroup(tables.groupBy("shard", "salt")).applyInPandas(
        score_group, f"key {kind}, id long, lp double, symbols long")
    # Rows that repeat add up in both sums, which leaves the quotient.
    sums = scored.groupBy("key", "id").agg(F.exp(-F.sum("lp") / F.sum("symbols")).alias("perplexity"))
    sums = sums.withColumnsRenamed({"key": "k", "id": "i"})
    return narrow.join(sums, F.col("key").eqNullSafe(F.col("k")) & (F.col("id") == F.col("i")), "left").select("key", "id", "lang", "trusted", "perplexity")


def classify(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", quantile: float = 0.99) -> DataFrame:
    """key, lang, trusted, perplexity, threshold (of the language) and kept of every row."""
    rows = stage(perplexities(docs, trusted, key, text, lang))
    limit = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000))
    own = rows.filter("trusted").groupBy("lang").agg(limit.alias("own")).withColumnRenamed("lang", "l")
    every = rows.agg(F.coalesce(F.percentile_approx(F.when(F.col("trusted"), F.col("perplexity")), F.lit(quantile), F.lit(10_000)), F.lit(257.0)).alias("all"))
    out = rows.join(own, F.col("lang").eqNullSafe(F.col("l")), "left").withColumn("threshold", F.coalesce("own", F.lit(every.first()["all"])))
    return out.select(F.col("key").alias(key), "lang", "trusted", "perplexity", "threshold",
                      F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("kept"))
