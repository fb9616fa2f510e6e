"""Keyword analysis: distinct keywords, intents, clusters, cluster profiles and overlaps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from siteloom.functions import constants as K
from siteloom.functions import text as X
from siteloom.operators.similarity import similar_pairs
from siteloom.operators.skew import bucketed_rank, top_per_key

CLUSTER = ["analysis_id", "cluster_id"]


def distinct_keywords(raw: DataFrame, compat: bool = True) -> DataFrame:
    """Distinct keywords per analysis by normal form of 2 to 200 characters; the first spelling is shown.

    ``raw``: analysis_id, line_no, raw. Adds tokens, intent and page type, computed once per distinct keyword.
    """
    shaped = raw.select("analysis_id", "line_no", X.collapse_ws(F.col("raw")).alias("keyword"),
                        X.normalize_keyword(F.col("raw"), compat).alias("normalized"))
    unique = (shaped.filter(X.js_length(F.col("normalized")).between(2, 200)).groupBy("analysis_id", "normalized")
              .agg(F.min_by("keyword", "line_no").alias("keyword"), F.min("line_no").alias("line_no")))
    staged = unique.withColumn("tokens", X.tokenize(F.col("normalized")))
    return (staged.withColumn("intent", X.classify_intent(F.col("normalized"), F.col("tokens")))
                  .withColumn("page_type", X.page_type_for_intent(F.col("intent")))
                  .withColumn("n_tokens", F.size("tokens")))


def analysis_limits(raw: DataFrame, max_keywords: int = K.DEFAULT_KEYWORDS) -> DataFrame:
    """Input count per analysis and the reason it is refused, if any (too many keywords, none valid)."""
    limit = max(1, min(max_keywords, K.MAX_KEYWORDS))
    valid = X.js_length(X.normalize_keyword(F.col("raw"), False)).between(2, 200)
    return raw.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("input_count"), F.count_if(valid).alias("valid")).select(
        "analysis_id", "input_count", F.when(F.col("input_count") > limit, "too-many-keywords")
        .when(F.col("valid") == 0, "no-valid-keywords").alias("reject_reason"))


def item_order() -> list:
    """Analysis order: most tokens first, then text."""
    return [F.desc("n_tokens"), F.asc("keyword")]


def cluster_token_frequency(items: DataFrame) -> DataFrame:
    """Items per cluster that contain a token."""
    return (items.select(*CLUSTER, F.explode(F.array_distinct("tokens")).alias("token"))
                 .groupBy(*CLUSTER, "token").agg(F.count(F.lit(1)).alias("n")))


def primary_keyword(items: DataFrame) -> DataFrame:
    """Best-weighted keyword per cluster; ties by text. Combines map-side."""
    c = F.col
    score = (X.lookup(c("intent"), K.INTENT_PRIMARY_WEIGHT) * 10 + F.least("n_tokens", F.lit(6))
             - F.abs(X.js_length(c("keyword")) - 38) / 20)
    return items.groupBy(*CLUSTER).agg(F.min_by("keyword", F.struct((-score).alias("s"), "keyword")).alias(
        "primary_keyword"), F.count(F.lit(1)).alias("size"))


def dominant_intent(items: DataFrame) -> DataFrame:
    """Commonest intent per cluster; a tie goes to the intent met first in analysis order."""
    counted = items.groupBy(*CLUSTER, "intent").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct((-F.col("n_tokens")).alias("t"), "keyword")).alias("first"))
    return counted.groupBy(*CLUSTER).agg(F.min_by("intent", F.struct((-F.col("n")).alias("n"), "first")).alias("intent"))


def _pair_sum(key: tuple, left: pd.DataFrame) -> pd.DataFrame:
    """Sum of pairwise Jaccard between two blocks of one cluster (or within one block)."""
    vocabulary = {t: n for n, t in enumerate(sorted({t for ts in left["tokens"] for t in ts}))}
    bits = np.zeros((len(left), max(1, len(vocabulary))), dtype="float32")
    for row, tokens in enumerate(left["tokens"]):
        bits[row, [vocabulary[t] for t in tokens]] = 1
    inside = key[-2] == key[-1]
    first = (left["block"] == key[-2]).to_numpy()
    a, b = (bits, bits) if inside else (bits[first], bits[~first])
    both = a @ b.T
    union = a.sum(1)[:, None] + b.sum(1)[None, :] - both
    score = np.divide(both, union, out=np.zeros_like(both, dtype="float64"), where=union > 0)
    total = float(np.triu(score, 1).sum()) if inside else float(score.sum())
    return pd.DataFrame({"analysis_id": [key[0]], "cluster_id": [key[1]], "total": [total]})


def cluster_confidence(items: DataFrame, block: int = 1024, small: int = 64) -> DataFrame:
    """Mean pairwise Jaccard of a cluster in percent, 100 for singletons.

    Small clusters are summed inside the JVM. Larger ones are cut into blocks and every pair of blocks is one numpy task
    that returns a single partial sum, so no cluster is gathered whole and no pair becomes a row.
    """
    c = F.col
    sizes = items.groupBy(*CLUSTER).agg(F.count(F.lit(1)).alias("size"))
    sized = items.select(*CLUSTER, "normalized", F.array_distinct("tokens").alias("tokens")).join(sizes, CLUSTER)
    packed = sized.filter(c("size").between(2, small)).groupBy(*CLUSTER).agg(F.collect_list("tokens").alias("sets"))
    total = F.expr("aggregate(transform(sets, (a, i) -> aggregate(slice(sets, i + 2, size(sets)), 0D, (s, b) -> s + "
                   "if(size(a) = 0 or size(b) = 0, 0D, size(array_intersect(a, b)) / size(array_union(a, b))))), 0D, "
                   "(s, x) -> s + x)")
    near = packed.select(*CLUSTER, total.alias("total"))
    large = sized.filter(c("size") > small).withColumn("blocks", F.ceil(c("size") / block).cast("int")).withColumn(
        "block", F.pmod(F.xxhash64("normalized"), c("blocks")).cast("int"))
    spread = large.withColumn("other", F.explode(F.sequence(F.lit(0), c("blocks") - 1))).select(
        *CLUSTER, "block", "tokens", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    schema = T.StructType([items.schema["analysis_id"], items.schema["cluster_id"], T.StructField("total", T.DoubleType())])
    far = spread.groupBy(*CLUSTER, "i", "j").applyInPandas(_pair_sum, schema)
    totals = near.unionByName(far).groupBy(*CLUSTER).agg(F.sum("total").alias("total"))
    pairs = c("size") * (c("size") - 1) / 2
    return sizes.join(totals, CLUSTER, "left").select(
        *CLUSTER, F.when(c("size") == 1, 100).otherwise(
            # nine decimals first: the sum's order must not decide an exact half
            X.js_round(F.round(F.coalesce("total", F.lit(0.0)) / pairs * 100, 9))).cast("int").alias("confidence"))


def cluster_names(items: DataFrame, primaries: DataFrame) -> DataFrame:
    """Up to four tokens that at least two and 35 % of the items share, capitalised; else the primary keyword."""
    c = F.col
    counted = cluster_token_frequency(items).join(primaries.select(*CLUSTER, "size"), CLUSTER)
    common = counted.filter(c("n") >= F.greatest(F.lit(2), F.ceil(c("size") * 0.35)))
    top = top_per_key(common, CLUSTER, [F.desc("n"), "token"], 4)
    cap = F.concat(F.upper(F.substring("token", 1, 1)), F.substring(c("token"), F.lit(2), F.length("token")))
    named = top.groupBy(*CLUSTER).agg(F.array_join(F.array_sort(F.collect_list(F.struct(
        (-c("n")).alias("n"), "token", cap.alias("cap"))))["cap"], " ").alias("common"))
    return primaries.join(named, CLUSTER, "left").select(
        *CLUSTER, F.coalesce("common", "primary_keyword").alias("name"))


def cluster_centroids(items: DataFrame, k: int = 8) -> DataFrame:
    """The ``k`` commonest tokens per cluster."""
    top = top_per_key(cluster_token_frequency(items), CLUSTER, [F.desc("n"), "token"], k)
    return top.groupBy(*CLUSTER).agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("n")).alias("n"), "token")))["token"].alias("tokens"))


def cluster_profiles(items: DataFrame, compat: bool = True) -> DataFrame:
    """One row per cluster: name, primary keyword, intent, page type, slug, confidence, size."""
    primaries = primary_keyword(items)
    return (primaries.join(dominant_intent(items), CLUSTER).join(cluster_confidence(items), CLUSTER)
            .join(cluster_names(items, primaries), CLUSTER)
            .withColumn("page_type", X.page_type_for_intent(F.col("intent")))
            .withColumn("suggested_slug", X.slugify(F.col("primary_keyword"), compat)))


def keyword_rows(items: DataFrame, profiles: DataFrame) -> DataFrame:
    """Keywords with their cluster size and priority."""
    sizes = profiles.select(*CLUSTER, "size")
    return items.join(sizes, CLUSTER).withColumn(
        "priority", X.keyword_priority(F.col("intent"), F.col("size"), F.col("n_tokens")))


def numbered_keywords(items: DataFrame) -> DataFrame:
    """Sequential ids in analysis order (keyword-1, keyword-2, ...), ranked in token-count and first-letters buckets."""
    lead = F.struct((-F.col("n_tokens")).alias("t"), F.substring("keyword", 1, 3).alias("k"))
    ranked = bucketed_rank(items, ["analysis_id"], lead, item_order(), "position")
    return ranked.withColumn("keyword_id", F.concat(F.lit("keyword-"), F.col("position").cast("string")))


def cluster_overlaps(profiles: DataFrame) -> DataFrame:
    """Cluster pairs of one analysis and intent whose primary keywords have Jaccard >= 0.3."""
    heads = profiles.withColumn("tokens", X.tokenize(F.col("primary_keyword")))
    pairs = similar_pairs(heads, ["analysis_id", "intent"], "cluster_id", "tokens", K.OVERLAP_SCORE)
    return pairs.select("analysis_id", F.col("left").alias("cluster_a"), F.col("right").alias("cluster_b"),
                        X.js_round(F.col("jaccard") * 100).alias("similarity"), F.lit(K.OVERLAP_REASON).alias("reason"))


def keyword_cluster_join(items: DataFrame, profiles: DataFrame) -> DataFrame:
    """Keyword rows with the attributes of their cluster."""
    heads = profiles.select(*CLUSTER, F.col("name").alias("cluster"), "primary_keyword", "suggested_slug", "confidence")
    return items.join(heads, CLUSTER, "left")


def intent_counts(items: DataFrame) -> DataFrame:
    """Keywords per analysis and intent with zero fill, one column per intent."""
    return items.groupBy("analysis_id").agg(
        *[F.count_if(F.col("intent") == i).alias(f"n_{i}") for i in K.INTENTS])
