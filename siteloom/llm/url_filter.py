"""URL verdicts: longest fitting rule, else logistic regression on hashed character n-grams of host and path.

The model is fitted on a small labelled table (url, label; 1: block), at most ``bound`` different urls of it, the first by hash
of the url, each with its different labels; everything is Spark ML and column expressions, and every url is judged.

Defined cases: a null url, or one without "://", has empty host and path and no n-grams, so the intercept alone judges it; repeated
rows get equal results; a labelled table of one class or none gives a constant; an empty table gives no rows.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls. A rule is (verdict, host with its path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def grams(text: Column, mark: str, sizes: tuple[int, ...]) -> Column:
    """Character n-grams with a mark and with the text's ends shown."""
    framed = F.concat(F.lit("^"), text, F.lit("$"))
    parts = [F.when(F.char_length(framed) >= n, F.transform(F.sequence(F.lit(1), F.char_length(framed) - n + 1), lambda i, n=n: F.concat(F.lit(mark), F.substring(framed, i, F.lit(n)))))
             .otherwise(F.array().cast("array<string>")) for n in sizes]
    return F.concat(*parts)


def features(df: DataFrame, url: str, size: int, sizes: tuple[int, ...]) -> DataFrame:
    """``df`` with host, path and the hashed n-gram vector x."""
    df = df.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    shape = F.regexp_replace("path", "[0-9]+", "0")
    df = df.withColumn("grams", F.concat(grams(F.col("host"), "h", sizes), grams(shape, "p", sizes)))
    return HashingTF(numFeatures=size, inputCol="grams", outputCol="x", binary=True).transform(df).drop("grams")


def judge(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]], key: str = "page_id", url: str = "url", bound: int = 2000,
          size: int = 1 << 14, sizes: tuple[int, ...] = (3, 4, 5)) -> DataFrame:
    """key, host, path, rule, verdict and score (probability of a block) of every row."""
    sample = labelled.select("url", F.col("label").cast("double").alias("label")).dropna()
    sample = sample.groupBy("url").agg(F.sort_array(F.collect_set("label")).alias("labels")).orderBy(F.xxhash64("url"), "url").limit(bound)
    sample = sample.select("url", F.explode("labels").alias("label"))
    train = features(sample, "url", size, sizes).select("x", "label")
    model = LogisticRegression(featuresCol="x", labelCol="label", regParam=0.003, maxIter=40, probabilityCol="p", predictionCol="said", rawPredictionCol="raw")
    classes = {r["label"] for r in train.select("label").distinct().collect()}
    rows = features(pages.select(F.col(key).alias("key"), F.col(url).alias("url")), "url", size, sizes)
    if classes == {0.0, 1.0}:
        rows = model.fit(train).transform(rows).withColumn("score", F.get(vector_to_array("p"), F.lit(1)))
    else:
        rows = rows.withColumn("score", F.lit(1.0 if classes == {1.0} else 0.0))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return rows.select(F.col("key").alias(key), "host", "path", rule.alias("rule"),
                       F.coalesce(verdict, F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), F.round("score", 6).alias("score"))
