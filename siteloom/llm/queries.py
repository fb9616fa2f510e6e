"""The registered queries of this folder; each is a thin form of an operator with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siteloom.llm import disclosure, filter_audit, jaccard_join, kneser_ney, ngram_importance, packing, quality_rules, repair, sharding, string_kernel, templates, token_cache, url_filter
from siteloom.llm.registry import query, read
from siteloom.session import staging_dir


@query("op1_bounded_ring")
def op1_bounded_ring(spark, sf_dir):
    """All documents in eight shards of near equal bytes."""
    rows = sharding.shard_rows(read(spark, sf_dir, "documents"), shards=8, slack=0.0)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"), "home", "arc")


@query("op10_weak_supervision")
def op10_weak_supervision(spark, sf_dir):
    """Counts, votes and the posterior quality of every document."""
    judged = quality_rules.judge(read(spark, sf_dir, "documents"), ["doc_id"])
    return judged.select("row.doc_id", *[f"m.{k}" for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                         "base_failed", "kept", F.round("quality", 6).alias("quality"))


@query("op3_repair_ids")
def op3_repair_ids(spark, sf_dir):
    """All documents as token ids in a grammar-compressed file, read back."""
    path = f"{staging_dir(spark).rstrip('/')}/repair-{uuid.uuid4().hex}"
    repair.write_ids(read(spark, sf_dir, "documents"), path, "word_bpe_49k.json")
    return repair.read_ids(spark, path, base=49408)


@query("op5_digest_cache")
def op5_digest_cache(spark, sf_dir):
    """Token counts of all documents by way of a digest cache that starts empty."""
    path = f"{staging_dir(spark).rstrip('/')}/token-cache-{uuid.uuid4().hex}"
    rows = token_cache.count_tokens(read(spark, sf_dir, "documents"), path, "word_bpe_49k.json")
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


@query("op7_shortest_pack_first")
def op7_shortest_pack_first(spark, sf_dir):
    """All documents packed into sequences of 2048 ids."""
    return packing.pack_documents(read(spark, sf_dir, "documents"), 2048, "byte_bpe_50k.json", joined=True)


@query("op4_disclosure")
def op4_disclosure(spark, sf_dir):
    """Personal data in all documents: base spans, and terms that give an entity away."""
    rows = disclosure.find(read(spark, sf_dir, "documents"))
    many = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return rows.select("doc_id", *[many(i).alias(f"n_{k}") for i, k in enumerate(disclosure.KINDS)],
                       F.sha2(disclosure.spans_text(F.col("base")), 256).alias("base_sha256"), disclosure.spans_text(F.col("spans")).alias("spans"))


#: The query's rules, and words by which the labelled URLs are marked as unwanted.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
URL_MARKS = ["casino", "pills", "bets", "spam", "ads-track"]


@query("op8_url_regression")
def op8_url_regression(spark, sf_dir):
    """All page urls; the labelled table holds 2000 urls marked by words of their host."""
    pages = read(spark, sf_dir, "pages")
    labelled = pages.select("url", url_filter.host_of(F.col("url")).rlike("|".join(URL_MARKS)).cast("int").alias("label"))
    return url_filter.judge(pages, labelled, URL_RULES)


@query("op9_template_leaks")
def op9_template_leaks(spark, sf_dir):
    """Benchmark items in all documents; a row for each document and item it leaks."""
    return templates.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op6_incidence_product")
def op6_incidence_product(spark, sf_dir):
    """All documents linked at a Jaccard similarity of 0.85 on four words."""
    return jaccard_join.link(read(spark, sf_dir, "documents"), k=4, percent=85)


@query("op2_kneser_ney")
def op2_kneser_ney(spark, sf_dir):
    """Perplexity of all documents under a model of those labelled good and not toxic."""
    trusted = read(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0").select("doc_id")
    rows = kneser_ney.classify(read(spark, sf_dir, "documents"), trusted, quantile=0.995)
    return rows.select("doc_id", "lang", F.round("perplexity", 6).alias("perplexity"), F.round("threshold", 6).alias("threshold"), "kept")


@query("op12_filter_paths", """
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body FROM documents),
split AS (SELECT *, list_filter(regexp_split_to_array(body, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM texts),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
          FROM labels GROUP BY doc_id),
masks AS (SELECT part, CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
                 + CASE WHEN 100 * (length(body) - length(regexp_replace(body, '[A-Z]', '', 'g'))) > 2 * length(body) THEN 4 ELSE 0 END
                 + CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 8 ELSE 0 END
                 + CASE WHEN split.doc_id > min(split.doc_id) OVER (PARTITION BY body) THEN 16 ELSE 0 END AS mask,
                 coalesce(good, 0) AS good, coalesce(marks.toxic, 0) AS toxic
          FROM split LEFT JOIN marks USING (doc_id)),
counts AS (SELECT part, mask, good, toxic, count(*) AS n FROM masks GROUP BY ALL),
bits AS (SELECT unnest([0, 1, 2, 3, 4]) AS b),
orders AS (SELECT [a.b, c.b, d.b, e.b, f.b] AS o FROM bits a, bits c, bits d, bits e, bits f
           WHERE len(list_distinct([a.b, c.b, d.b, e.b, f.b])) = 5),
steps AS (SELECT array_to_string(list_transform(o, lambda x: chr(CAST(65 + x AS INTEGER))), '') AS filter_order, step, o[step] AS f,
                 CAST(coalesce(list_sum(list_transform(o[1:step - 1], lambda x: 1 << x)), 0) AS INTEGER) AS earlier, 1 << o[step] AS bit
          FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
sums AS (SELECT part, filter_order, step, f,
                sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END) AS kept,
                sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS removed,
                sum(CASE WHEN mask & bit <> 0 AND mask & earlier <> 0 THEN n ELSE 0 END) AS redundant,
                sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
                sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 AND good = 1 THEN n ELSE 0 END) AS good_lost,
                sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 AND toxic = 1 THEN n ELSE 0 END) AS toxic_lost
         FROM counts, steps GROUP BY part, filter_order, step, f)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM sums""")
def op12_filter_paths(spark, sf_dir):
    """What each of five filters removes at each step of all 120 orders, for every source."""
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op13_overlapped_scan")
def op13_overlapped_scan(spark, sf_dir):
    """A quarter of all documents of twenty words or more, drawn by likeness to the benchmark."""
    rows = ngram_importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


@query("op11_string_kernel")
def op11_string_kernel(spark, sf_dir):
    """The probability that a document is toxic, from labels of those that are not held out."""
    rows = string_kernel.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return rows.select("doc_id", "held_out", "score", "predicted", "n_sentences", "n_toxic_sentences")
