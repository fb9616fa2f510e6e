"""Scans of landed inputs, each with an explicit schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from siteloom.functions import constants as K
from siteloom.functions import text as X
from siteloom.operators.findings import HTML_TYPES
from siteloom.operators.semantic import finite_vector
from siteloom.session import stage
from siteloom.sources import schemas


def read_pages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(HTML captures, other captures) of a landed capture table."""
    raw = spark.read.schema(schemas.CAPTURES).parquet(path)
    html = F.coalesce(F.col("content_type"), F.lit("")).rlike(HTML_TYPES)
    return raw.filter(html), raw.filter(~html)


def read_robots(docs: DataFrame, sites: DataFrame) -> DataFrame:
    """robots.txt per audit: audit_id, body, found. Anything but a 2xx answer counts as not found with no rules."""
    ok = docs.filter(F.col("status").between(200, 299)).select("audit_id", "body", F.lit(True).alias("found"))
    return sites.select("audit_id").join(ok, "audit_id", "left").select(
        "audit_id", F.coalesce("body", F.lit("")).alias("body"), F.coalesce("found", F.lit(False)).alias("found"))


def read_sitemaps(docs: DataFrame) -> DataFrame:
    """Successfully fetched sitemap documents: audit_id, doc_url, body."""
    return docs.filter(F.col("status").between(200, 299)).select("audit_id", "doc_url", "body")


def _first_field(line: Column) -> Column:
    """First field of a delimited line; delimiters inside quotes do not count, doubled quotes stand for one."""
    field = F.regexp_extract(line, r'(?s)^((?:[^",;\t]|"(?:[^"]|"")*(?:"|$))*)', 1)
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(field, '""', "\u0001"), '"', ""), "\u0001", '"')
    return X.trim_ws(body)


def keyword_lines(texts: DataFrame) -> DataFrame:
    """Keyword rows of pasted or uploaded lists: analysis_id, line_no, raw. ``texts``: analysis_id, body."""
    c = F.col
    lines = F.filter(F.transform(F.split(F.regexp_replace("body", "^﻿", ""), r"\r?\n"), X.trim_ws), lambda x: x != "")
    rows = texts.select("analysis_id", F.posexplode(lines).alias("line_no", "line"))
    fields = rows.select("analysis_id", c("line_no").cast("long").alias("line_no"), _first_field(c("line")).alias("raw"))
    header = (c("line_no") == 0) & c("raw").rlike(K.KEYWORD_HEADER_PATTERN)
    return fields.filter((c("raw") != "") & ~header)


def keyword_text_errors(texts: DataFrame) -> DataFrame:
    """Lists refused before parsing: empty or longer than 150 000 characters."""
    size = F.length("body")
    reason = F.when(F.col("body").isNull() | (X.trim_ws(F.col("body")) == ""), "empty").when(size > K.MAX_KEYWORD_CHARS, "too-large")
    return texts.select("analysis_id", reason.alias("reject_reason")).filter("reject_reason is not null")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line of some text files with its number from 0: file, line_no, value, leads (the file's first line that isn't blank).

    Files are read in splits. A task numbers the lines of each split it reads, and a table of one row a split holds what
    comes before it, so that a file of any size is as many tasks as it has splits. A byte-order mark is dropped.
    """
    c = F.col
    raw = spark.read.option("lineSep", "\n").text(path).select("value", c("_metadata.file_path").alias("file"), c("_metadata.file_block_start").alias("start"))

    def number(batches):
        lines: dict = {}
        full: dict = {}
        for pdf in batches:
            at, heads = [], []
            for i, (value, split) in enumerate(zip(pdf["value"], zip(pdf["file"], pdf["start"]))):
                n = lines.get(split, 0)
                if n == 0 and split[1] == 0 and value.startswith("\ufeff"):
                    pdf.loc[pdf.index[i], "value"] = value = value[1:]
                lines[split] = n + 1
                at.append(n)
                text = bool(value.strip())
                heads.append(text and not full.get(split))
                full[split] = full.get(split, False) or text
            yield pdf.assign(local=at, head=heads)

    rows = stage(raw.mapInPandas(number, "value string, file string, start long, local long, head boolean"))
    splits = rows.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.bool_or("head").alias("text"))
    before = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    base = splits.select("file", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"),
                         (c("text") & ~F.coalesce(F.bool_or("text").over(before), F.lit(False))).alias("opens"))
    return rows.join(base, ["file", "start"]).select("file", (c("base") + c("local")).alias("line_no"), "value", (c("head") & c("opens")).alias("leads"))


def read_keyword_lists(spark: SparkSession, path: str) -> DataFrame:
    """Keyword rows of text files, one analysis per file: analysis_id (the file), line_no (among all lines of the file), raw."""
    c = F.col
    lines = numbered_lines(spark, path).withColumn("line", X.trim_ws(c("value"))).filter("line <> ''")
    fields = lines.select(c("file").alias("analysis_id"), "line_no", _first_field(c("line")).alias("raw"), "leads")
    return fields.filter((c("raw") != "") & ~(c("leads") & c("raw").rlike(K.KEYWORD_HEADER_PATTERN))).drop("leads")


def search_rows(api: DataFrame, limit: int | None = None) -> DataFrame:
    """Search rows of API-shaped records (snapshot_id, keys, clicks, ...): missing numbers are 0, rows without query or
    page are dropped. ``limit``: the API's row limit per sync (5 000), if it is to be applied to the answer as received."""
    num = [F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in ("clicks", "impressions", "ctr", "position")]
    seen = api if limit is None or "answer_no" not in api.columns else api.filter(F.col("answer_no") < limit)
    rows = seen.select("snapshot_id", F.try_element_at("keys", F.lit(1)).alias("query"),
                       F.try_element_at("keys", F.lit(2)).alias("page"), *num)
    return rows.filter((F.coalesce("query", F.lit("")) != "") & (F.coalesce("page", F.lit("")) != ""))


def read_search_rows(spark: SparkSession, path: str) -> DataFrame:
    return search_rows(spark.read.schema(schemas.SEARCH_API).json(path))


def read_result_json(df: DataFrame, column: str, schema: T.DataType | str, out: str = "result") -> DataFrame:
    """Decode a stored JSON document; a malformed one becomes null and keeps its row."""
    text = schema if isinstance(schema, str) else schema.simpleString()
    corrupt = F.from_json(F.col(column), schema, {"mode": "PERMISSIVE"})
    whole = F.try_parse_json(F.col(column)).isNotNull() if hasattr(F, "try_parse_json") else F.lit(bool(text))
    return df.withColumn(out, F.when(whole, corrupt))


def read_history(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One history table (projects, audits, rate_limits, ...) with its declared schema."""
    return spark.read.schema(schemas.HISTORY[table]).parquet(f"{path}/{table}")


def read_history_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """The same tables over JDBC; pass partitionColumn, lowerBound, upperBound and numPartitions to read in parallel."""
    fields = schemas.HISTORY[table].fields
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    return spark.read.format("jdbc").options(url=url, dbtable=table, customSchema=ddl, **options).load()


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Page vectors by URL with values that are not finite removed."""
    raw = spark.read.schema(schemas.VECTORS).parquet(path)
    return raw.withColumn("vector", finite_vector(F.col("vector")))
