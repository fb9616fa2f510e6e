"""Exports and table writes. Every export first builds its text rows as a DataFrame, so it can be checked as one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siteloom.functions import constants as K
from siteloom.functions.text import csv_cell, html_escape, lookup
from siteloom.operators import findings
from siteloom.operators.history import new_issue_flag

ISSUE_COLUMNS = ["status", "severity", "code", "title", "url", "evidence", "recommendation"]
KEYWORD_COLUMNS = ["keyword", "intent", "page_type", "priority", "cluster", "primary_keyword", "suggested_slug",
                   "cluster_confidence"]
LINK_COLUMNS = ["status", "confidence", "score", "source_url", "target_url", "anchor_text", "reasons"]


def csv_lines(rows: DataFrame, columns: list[str], keys: list[str], order: list[str]) -> DataFrame:
    """One text line per row next to its keys and sort columns."""
    line = F.array_join(F.array(*[csv_cell(F.col(c)) for c in columns]), ",")
    return rows.select(*keys, *[c for c in order if c not in keys], line.alias("value"))


def issues_csv(issues: DataFrame, new_issues: DataFrame) -> DataFrame:
    """Lines of the issue export; needs audit_id, seq, rule_no."""
    flagged = new_issue_flag(issues, new_issues)
    return csv_lines(flagged, ISSUE_COLUMNS, ["audit_id"], ["seq", "rule_no"])


def keywords_csv(keywords: DataFrame) -> DataFrame:
    """Lines of the keyword export; ``keywords``: keyword_cluster_join rows. A confidence of 0 prints as empty."""
    rows = keywords.withColumn("cluster_confidence", F.nullif(F.col("confidence"), F.lit(0)))
    return csv_lines(rows, KEYWORD_COLUMNS, ["analysis_id"], ["n_tokens"])


def links_csv(suggestions: DataFrame) -> DataFrame:
    rows = suggestions.withColumn("reasons", F.array_join("reasons", " | "))
    return csv_lines(rows, LINK_COLUMNS, ["audit_id"], ["position"])


def write_lines(lines: DataFrame, path: str, keys: list[str], order: list, header: list[str]) -> None:
    """Write text lines as one folder per key value, sorted in files, header as the first line of every file.

    Rows are range-partitioned by key and order, so a key with most of the rows becomes several files in sequence.
    """
    sorted_rows = lines.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    (sorted_rows.select(*keys, F.col("value").alias(",".join(header)))
     .write.mode("append").partitionBy(*keys).option("header", True).option("quote", "\u0000").option("escapeQuotes", False)
     .option("emptyValue", "").option("sep", "\u0001").csv(path))


GROUP_KEYS = ["audit_id", "code", "severity", "title", "recommendation"]


def evidence_pieces(chunks: DataFrame, duplicates: DataFrame | None = None) -> DataFrame:
    """Evidence of all groups as pieces in the order (a, b): the chunks of ``scoring.evidence_chunks``, and for duplicate
    findings the pieces of ``findings.duplicate_evidence``; ``joint`` stands before each piece but a group's first."""
    c = F.col
    usual = chunks.filter("evidence <> ''").select(*GROUP_KEYS, c("chunk").cast("long").alias("a"), F.lit(0).cast("long").alias("b"),
                                                   F.lit("\n\n").alias("joint"), "evidence")
    if duplicates is not None:
        named = chunks.select(*GROUP_KEYS).distinct().filter(c("code").isin([f"duplicate-{k}" for k in findings.DUPLICATE_LABELS]))
        usual = usual.unionByName(named.join(duplicates, ["audit_id", "code"]).select(*usual.columns))
    first = usual.groupBy(*GROUP_KEYS).agg(F.min(F.struct("a", "b")).alias("first"))
    placed = usual.join(first, GROUP_KEYS)
    return placed.withColumn("joint", F.when(F.struct("a", "b") == c("first"), "").otherwise(c("joint"))).drop("first")


def _json_text(value: Column) -> Column:
    """A text as it stands between the quotes of a JSON string."""
    doc = F.to_json(F.struct(value.alias("v")))
    return F.substring(doc, F.lit(7), F.char_length(doc) - 8)


PIECE_ORDER = ["stage", "first_seq", "first_rule", "code", "severity", "title", "recommendation", "kind", "a", "b"]


def audit_report_pieces(header: DataFrame, groups: DataFrame, pieces: DataFrame) -> DataFrame:
    """The JSON report of every audit as pieces of text: audit_id, ``PIECE_ORDER``, value.

    Put together in their order they are one document per audit: its header, then its groups, each with its whole evidence in
    place. No piece depends on how much evidence a group has, so an audit of any size is many rows and never one.
    """
    c = F.col
    fields = [k for k in header.columns if k != "audit_id"]
    nil = {"stage": F.lit(0), "first_seq": F.lit(0).cast("long"), "first_rule": F.lit(0), "code": F.lit(""), "severity": F.lit(""), "title": F.lit(""),
           "recommendation": F.lit(""), "kind": F.lit(0), "a": F.lit(0).cast("long"), "b": F.lit(0).cast("long")}
    row = lambda df, value, **at: df.select("audit_id", *[at.get(k, v).alias(k) for k, v in nil.items()], value.alias("value"))
    head = F.to_json(F.struct("audit_id", *fields))
    opening = row(header, F.concat(F.substring(head, F.lit(1), F.char_length(head) - 1), F.lit(',"issues":[')))
    closing = row(header, F.lit("]}"), stage=F.lit(2))
    place = [k for k in PIECE_ORDER if k in groups.columns]
    first = groups.groupBy("audit_id").agg(F.min(F.struct(*place)).alias("first"))
    shown = [k for k in ("code", "severity", "title", "description", "recommendation", "url", "n_urls") if k in groups.columns]
    text = F.to_json(F.struct(*shown))
    at = {"stage": F.lit(1), "first_seq": c("first_seq").cast("long"), "first_rule": c("first_rule").cast("int")} | {
        k: c(k) for k in ("code", "severity", "title", "recommendation")}
    begun = row(groups.join(first, "audit_id"), F.concat(F.when(F.struct(*place) == c("first"), "").otherwise(","), F.substring(
        text, F.lit(1), F.char_length(text) - 1), F.lit(',"evidence":"')), **at)
    ended = row(groups, F.lit('"}'), **at, kind=F.lit(2))
    inside = pieces.join(groups.select(*GROUP_KEYS, "first_seq", "first_rule"), GROUP_KEYS)
    told = row(inside, _json_text(F.concat("joint", "evidence")), **at, kind=F.lit(1), a=c("a"), b=c("b"))
    return opening.unionByName(begun).unionByName(told).unionByName(ended).unionByName(closing)


def issues_csv_pieces(issues: DataFrame, new_issues: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Lines of the issue export as pieces: audit_id, seq, rule_no, kind, a, b, value; duplicate findings with their members.

    A line of an ordinary issue is one piece. The evidence cell of a duplicate finding is quoted if any of its pieces needs it.
    """
    c = F.col
    zero = F.lit(0).cast("long")
    many = c("code").isin([f"duplicate-{k}" for k in findings.DUPLICATE_LABELS])
    flagged = new_issue_flag(issues, new_issues)
    plain = csv_lines(flagged.filter(~many), ISSUE_COLUMNS, ["audit_id"], ["seq", "rule_no"]).select(
        "audit_id", "seq", "rule_no", F.lit(0).alias("kind"), zero.alias("a"), zero.alias("b"), "value")
    flat = duplicates.withColumn("cell", F.regexp_replace("evidence", "\r?\n", " "))
    quoted = flat.groupBy("audit_id", "code").agg(F.bool_or(c("cell").rlike('[",]')).alias("quoted"), F.min(F.struct("a", "b")).alias("first"))
    found = flagged.filter(many).join(quoted, ["audit_id", "code"])
    mark = F.when(c("quoted"), '"').otherwise("")
    ends = found.select("audit_id", "seq", "rule_no", F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), F.concat(F.array_join(F.array(*[csv_cell(c(k)) for k in ISSUE_COLUMNS[:5]]), ","), F.lit(","), mark).alias("value")),
        F.struct(F.lit(2).alias("kind"), F.concat(mark, F.lit(","), csv_cell(c("recommendation"))).alias("value")))).alias("e")).select(
        "audit_id", "seq", "rule_no", "e.kind", zero.alias("a"), zero.alias("b"), "e.value")
    space = F.when(F.struct("a", "b") == c("first"), "").otherwise(F.regexp_replace("joint", "\n", " "))
    inner = found.select("audit_id", "code", "seq", "rule_no", "quoted", "first").join(flat, ["audit_id", "code"]).select(
        "audit_id", "seq", "rule_no", F.lit(1).alias("kind"), "a", "b",
        F.concat(space, F.when(c("quoted"), F.replace("cell", F.lit('"'), F.lit('""'))).otherwise(c("cell"))).alias("value"))
    return plain.unionByName(ends).unionByName(inner)


def write_documents(pieces: DataFrame, path: str, key: str, order: list[str] | None = None, buckets: int = 64) -> None:
    """Write documents of any number and size: sorted files in ``buckets`` folders by hash of the key, instead of a folder a document.

    Within a file the pieces stand in the order (key, ``order``), so that the files' own statistics lead a reader of one key to
    its row groups. A key with most of the pieces becomes several files in sequence.
    """
    order = order or []
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    by = ["bucket", key, *order]
    dealt.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("append").partitionBy("bucket").parquet(path)


def read_document(spark: SparkSession, path: str, key: str, value, buckets: int = 64) -> DataFrame:
    """The pieces of one document: one folder is read, and in it the row groups that hold the key."""
    rows = spark.read.parquet(path)
    at = F.pmod(F.xxhash64(F.lit(value).cast(rows.schema[key].dataType)), F.lit(buckets)).cast("int")
    return rows.filter((F.col("bucket") == spark.range(1).select(at.alias("b")).first()["b"]) & (F.col(key) == F.lit(value))).drop("bucket")


def write_audit_reports(pieces: DataFrame, path: str) -> None:
    write_documents(pieces, path, "audit_id", PIECE_ORDER)


def brief_markdown(briefs: DataFrame) -> DataFrame:
    """Markdown text per brief."""
    c = F.col

    def bullets(name: str) -> Column:
        return F.array_join(F.transform(c(name), lambda v: F.concat(F.lit("- "), v)), "\n")

    outline = F.array_join(F.transform("outline", lambda s: F.concat(
        F.repeat(F.lit("#"), s["level"]), F.lit(" "), s["heading"], F.lit("\n\n"), s["purpose"])), "\n\n")
    blocks = [
        F.concat(F.lit("# "), c("name")), F.concat(F.lit("Status: "), c("status")), F.lit("## Targeting"),
        F.concat(F.lit("- Primary keyword: "), c("primary_keyword"), F.lit("\n- Intent: "), c("intent"),
                 F.lit("\n- Page type: "), c("page_type"), F.lit("\n- Suggested URL: "), c("suggested_slug")),
        F.lit("### Supporting keywords"), bullets("supporting_keywords"), F.lit("## Metadata"),
        F.concat(F.lit("- Title: "), c("title"), F.lit("\n- Meta description: "), c("meta_description"), F.lit("\n- H1: "), c("h1")),
        F.lit("## Audience"), c("audience"), F.lit("## Search intent"), c("search_intent_summary"),
        F.lit("## Content angle"), c("angle"), F.lit("## Outline"), outline,
        F.lit("## Questions to answer"), bullets("questions"), F.lit("## Internal link ideas"), bullets("internal_link_ideas"),
        F.lit("## Schema types"), bullets("schema_types"), F.lit("## Quality checklist"), bullets("quality_checklist")]
    return briefs.select("brief_id", F.concat(F.array_join(F.array(*blocks), "\n\n"), F.lit("\n")).alias("value"))


def write_briefs_markdown(briefs: DataFrame, path: str) -> None:
    write_documents(brief_markdown(briefs), path, "brief_id")


def audit_html_rows(issues: DataFrame) -> DataFrame:
    """Table rows of the HTML report, one text line per grouped issue."""
    cells = [lookup(F.col("severity"), K.SEVERITY_LABEL), F.col("title"), F.coalesce("url", F.lit("Site-wide")),
             F.col("recommendation")]
    row = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), html_escape(x), F.lit("</td>")) for x in cells], F.lit("</tr>"))
    return issues.select("audit_id", "first_seq", "first_rule", row.alias("value"))


def audit_html(header: DataFrame, groups: DataFrame, title: str = "Technical SEO audit") -> DataFrame:
    """HTML report per audit: score, counts and the issue table (one row per group, so bounded by the rule catalogue)."""
    c = F.col
    rows = audit_html_rows(groups).groupBy("audit_id").agg(F.array_join(F.array_sort(F.collect_list(
        F.struct("first_seq", "first_rule", "value")))["value"], "").alias("rows"))
    page = F.concat(
        F.lit("<!doctype html><html lang=\"en\"><meta charset=\"utf-8\"><title>"), F.lit(title), F.lit(" — "),
        html_escape(c("root_url")), F.lit("</title><h1>"), F.lit(title), F.lit("</h1><p>"), html_escape(c("root_url")),
        F.lit("</p><p>"), c("score").cast("string"), F.lit("/100 · "), c("pages_scanned").cast("string"), F.lit(" pages · "),
        c("issue_count").cast("string"),
        F.lit(" issues</p><table><thead><tr><th>Severity</th><th>Issue</th><th>URL</th><th>Recommendation</th></tr></thead><tbody>"),
        F.coalesce("rows", F.lit("")), F.lit("</tbody></table></html>"))
    return header.join(rows, "audit_id", "left").select("audit_id", page.alias("value"))


def append_results(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Append rows to a result table (audits, analyses, briefs, snapshots, alerts), partitioned by low-cardinality columns."""
    writer = df.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def save_audits(header: DataFrame, comparison: DataFrame | None, path: str) -> None:
    """Append audit headers with their comparison counts, one folder per month."""
    rows = header if comparison is None else header.join(comparison, "audit_id", "left")
    append_results(rows.withColumn("month", F.date_format("created_at", "yyyy-MM")), path, ["month"])


def overwrite_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace only the partitions present in ``df`` (the write side of a keyed merge)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
