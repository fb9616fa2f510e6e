"""Registered queries over keyword lists."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siteloom.functions import constants as K
from siteloom.functions import text as X
from siteloom.operators import keywords as kw
from siteloom.operators.leaders import keyword_clusters
from siteloom.operators.similarity import similar_pairs
from siteloom.operators.skew import bucketed_rank
from siteloom.plans.registry import query
from siteloom.plans.tables import table
from siteloom.session import stage, staging_dir
from siteloom.sources import readers


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _case(field: str, mapping: dict) -> str:
    return f"CASE {field} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in mapping.items()) + " END"


def _score_sql(intent: str) -> str:
    terms = K.INTENT_TERMS[intent]
    single = [f"CAST(list_contains(tokens, '{t}') AS INT)" for t in terms if " " not in t]
    phrase = [f"CAST(contains(normalized, '{t}') AS INT)" for t in terms if " " in t]
    return " + ".join(single + phrase)


ITEMS_SQL = f"""
uniq AS (SELECT analysis_id, normalized, arg_min(keyword, line_no) AS keyword, min(line_no) AS line_no FROM (
   SELECT analysis_id, line_no, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS keyword, lower(trim(regexp_replace(raw, '\\s+', ' ', 'g'))) AS normalized FROM {{fx_keywords}})
   WHERE length(normalized) BETWEEN 2 AND 200 GROUP BY ALL),
toks AS (SELECT *, list_filter(regexp_extract_all(normalized, '[\\p{{L}}\\p{{N}}]+'), lambda t: length(t) > 1 AND NOT list_contains({_list(K.STOP_WORDS)}, t)) AS tokens FROM uniq),
scored AS (SELECT *, {", ".join(f"{_score_sql(i)} AS s_{i}" for i in K.INTENT_TERMS)} FROM toks),
items AS (SELECT *, len(tokens) AS n_tokens, CASE WHEN greatest({", ".join(f"s_{i}" for i in K.INTENT_TERMS)}) = 0 THEN 'informational'
   {" ".join(f"WHEN s_{i} = greatest({', '.join(f's_{j}' for j in K.INTENT_TERMS)}) THEN '{i}'" for i in K.INTENT_TERMS)} END AS intent FROM scored)"""


def items(spark, sf_dir):
    """Distinct keywords of the derived lists."""
    return kw.distinct_keywords(table(spark, sf_dir, "fx_keywords"))


def word_clusters(spark, sf_dir):
    """Items grouped by their first token: a plain SQL stand-in for clusters, so profiles can be checked on whole tables."""
    return items(spark, sf_dir).withColumn("cluster_id", F.concat(F.lit("c-"), F.coalesce(F.try_element_at(
        "tokens", F.lit(1)), F.lit("none"))))


_CLUSTERED = "clustered AS (SELECT *, concat('c-', coalesce(tokens[1], 'none')) AS cluster_id, list_distinct(tokens) AS tset FROM items)"
_PROFILE_TAIL = f"""prim AS (SELECT analysis_id, cluster_id, count(*) AS size, arg_min(keyword, (-({_case('intent', K.INTENT_PRIMARY_WEIGHT)} * 10 + least(n_tokens, 6) - abs(length(keyword) - 38) / 20.0::DOUBLE), keyword)) AS primary_keyword
   FROM clustered GROUP BY ALL),
 ic AS (SELECT analysis_id, cluster_id, intent, count(*) AS n, max(n_tokens) AS mt, arg_min(keyword, (-n_tokens, keyword)) AS fk FROM clustered GROUP BY ALL),
 dom AS (SELECT analysis_id, cluster_id, arg_min(intent, (-n, -mt, fk)) AS intent FROM ic GROUP BY ALL),
 pairs AS (SELECT a.analysis_id, a.cluster_id, sum(len(list_intersect(a.tset, b.tset)) / len(list_distinct(list_concat(a.tset, b.tset)))::DOUBLE) AS total
   FROM clustered a JOIN clustered b ON a.analysis_id = b.analysis_id AND a.cluster_id = b.cluster_id AND a.normalized < b.normalized
   WHERE len(a.tset) > 0 AND len(b.tset) > 0 GROUP BY ALL),
 freq AS (SELECT analysis_id, cluster_id, token, count(*) AS n FROM (SELECT analysis_id, cluster_id, unnest(tset) AS token FROM clustered) GROUP BY ALL),
 topt AS (SELECT *, row_number() OVER (PARTITION BY analysis_id, cluster_id ORDER BY n DESC, token) AS k FROM freq JOIN prim USING (analysis_id, cluster_id)
   WHERE n >= greatest(2, ceil(size * 0.35))),
 nam AS (SELECT analysis_id, cluster_id, string_agg(concat(upper(substr(token, 1, 1)), substr(token, 2)), ' ' ORDER BY k) AS name FROM topt WHERE k <= 4 GROUP BY ALL),
 profiles AS (SELECT p.analysis_id, p.cluster_id, p.size, p.primary_keyword, d.intent, coalesce(nam.name, p.primary_keyword) AS name,
   {_case('d.intent', K.PAGE_TYPE)} AS page_type,
   concat('/', substr(regexp_replace(regexp_replace(lower(p.primary_keyword), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), '/') AS suggested_slug,
   CAST(CASE WHEN p.size = 1 THEN 100 ELSE floor(round(coalesce(q.total, 0) / (p.size * (p.size - 1) / 2.0::DOUBLE) * 100, 9) + 0.5) END AS INT) AS confidence
   FROM prim p JOIN dom d USING (analysis_id, cluster_id) LEFT JOIN pairs q USING (analysis_id, cluster_id) LEFT JOIN nam USING (analysis_id, cluster_id))"""
_PROFILE = f"{ITEMS_SQL}, {_CLUSTERED}, {_PROFILE_TAIL}"


@query("keyword_intents", f"WITH {ITEMS_SQL} SELECT analysis_id, normalized, keyword, intent, {_case('intent', K.PAGE_TYPE)} AS page_type, CAST(n_tokens AS INT) AS n_tokens FROM items")
def q_intents(spark, sf_dir):
    return items(spark, sf_dir).select("analysis_id", "normalized", "keyword", "intent", "page_type", "n_tokens")


@query("intent_counts", f"WITH {ITEMS_SQL} SELECT analysis_id, " + ", ".join(
    f"count(*) FILTER (WHERE intent = '{i}') AS n_{i}" for i in K.INTENTS) + " FROM items GROUP BY analysis_id")
def q_intent_counts(spark, sf_dir):
    return kw.intent_counts(items(spark, sf_dir))


@query("keyword_input_limits", f"""SELECT analysis_id, count(*) AS input_count, CASE WHEN count(*) > 500 THEN 'too-many-keywords' END AS reject_reason
 FROM {{fx_keywords}} GROUP BY analysis_id""")
def q_limits(spark, sf_dir):
    return kw.analysis_limits(table(spark, sf_dir, "fx_keywords"))


@query("keyword_pairs", f"""WITH {ITEMS_SQL}, s AS (SELECT analysis_id, normalized, list_distinct(tokens) AS t FROM items WHERE len(tokens) > 0),
 p AS (SELECT a.analysis_id, a.normalized AS "left", b.normalized AS "right", len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t)))::DOUBLE AS j
   FROM s a JOIN s b ON a.analysis_id = b.analysis_id AND a.normalized < b.normalized)
 SELECT analysis_id, "left", "right", CAST(floor(j * 1000 + 0.5) AS INT) AS permille FROM p WHERE j >= 0.34""")
def q_pairs(spark, sf_dir):
    pairs = similar_pairs(items(spark, sf_dir), ["analysis_id"], "normalized", "tokens", K.JOIN_SCORE)
    return pairs.select("analysis_id", "left", "right", X.js_round(F.col("jaccard") * 1000).alias("permille"))


@query("cluster_profiles", f"WITH {_PROFILE} SELECT * FROM profiles")
def q_profiles(spark, sf_dir):
    return kw.cluster_profiles(word_clusters(spark, sf_dir))


@query("cluster_overlaps", f"""WITH {_PROFILE}, h AS (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(primary_keyword), '[a-z0-9]+'),
   lambda t: length(t) > 1 AND NOT list_contains({_list(K.STOP_WORDS)}, t))) AS t FROM profiles)
 SELECT a.analysis_id, a.cluster_id AS cluster_a, b.cluster_id AS cluster_b,
   CAST(floor(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t)))::DOUBLE * 100 + 0.5) AS INT) AS similarity
 FROM h a JOIN h b ON a.analysis_id = b.analysis_id AND a.intent = b.intent AND a.cluster_id < b.cluster_id
 WHERE len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t)))::DOUBLE >= 0.3""")
def q_overlaps(spark, sf_dir):
    return kw.cluster_overlaps(kw.cluster_profiles(word_clusters(spark, sf_dir))).drop("reason")


@query("keyword_priorities", f"""WITH {ITEMS_SQL}, {_CLUSTERED}, z AS (SELECT analysis_id, cluster_id, count(*) AS size FROM clustered GROUP BY ALL)
 SELECT analysis_id, keyword, cluster_id, CAST(least(100, 35 + {_case('intent', K.INTENT_PRIORITY_BOOST)} + least(size * 4, 24) + least(n_tokens * 2, 10)) AS INT) AS priority
 FROM clustered JOIN z USING (analysis_id, cluster_id)""")
def q_priorities(spark, sf_dir):
    grouped = word_clusters(spark, sf_dir)
    sizes = kw.primary_keyword(grouped)
    return kw.keyword_rows(grouped, sizes).select("analysis_id", "keyword", "cluster_id", "priority")


@query("numbered_keywords", f"""WITH {ITEMS_SQL} SELECT analysis_id, keyword, concat('keyword-', row_number() OVER (PARTITION BY analysis_id ORDER BY n_tokens DESC, keyword)) AS keyword_id FROM items""")
def q_numbered(spark, sf_dir):
    return kw.numbered_keywords(items(spark, sf_dir)).select("analysis_id", "keyword", "keyword_id")


_LEADERS = f""" ord AS (SELECT *, list_distinct(tokens) AS t, row_number() OVER (PARTITION BY analysis_id ORDER BY n_tokens DESC, keyword) AS i FROM items),
 pr AS (SELECT a.analysis_id, a.i AS ai, b.i AS bi, len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t)))::DOUBLE AS j,
   contains(concat(' ', a.normalized, ' '), concat(' ', b.normalized, ' ')) OR contains(concat(' ', b.normalized, ' '), concat(' ', a.normalized, ' ')) AS inside
   FROM ord a JOIN ord b ON a.analysis_id = b.analysis_id AND a.i < b.i WHERE len(a.t) > 0 AND len(b.t) > 0),
 ed AS (SELECT * FROM pr WHERE j >= 0.34 OR (j >= 0.2 AND inside)),
 nb AS (SELECT o.analysis_id, o.i, coalesce(list(e.ai) FILTER (WHERE e.ai IS NOT NULL), []) AS ns FROM ord o LEFT JOIN ed e ON e.analysis_id = o.analysis_id AND e.bi = o.i GROUP BY ALL),
 walk AS (SELECT analysis_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS leaders FROM (SELECT DISTINCT analysis_id FROM ord)
   UNION ALL SELECT w.analysis_id, n.i, CASE WHEN list_has_any(n.ns, w.leaders) THEN w.leaders ELSE list_append(w.leaders, n.i) END
   FROM walk w JOIN nb n ON n.analysis_id = w.analysis_id AND n.i = w.i + 1),
 fin AS (SELECT analysis_id, arg_max(leaders, i) AS leaders FROM walk GROUP BY analysis_id),
 att AS (SELECT e.analysis_id, e.bi AS i, arg_min(e.ai, (-e.j, e.ai)) AS li FROM ed e JOIN fin f ON f.analysis_id = e.analysis_id
   WHERE list_contains(f.leaders, e.ai) AND NOT list_contains(f.leaders, e.bi) GROUP BY ALL),
 led AS (SELECT o.analysis_id, o.normalized, l.normalized AS leader FROM ord o LEFT JOIN att ON att.analysis_id = o.analysis_id AND att.i = o.i
   JOIN ord l ON l.analysis_id = o.analysis_id AND l.i = coalesce(att.li, o.i))"""
_BY_LEADER = "clustered AS (SELECT items.*, led.leader AS cluster_id, list_distinct(tokens) AS tset FROM items JOIN led USING (analysis_id, normalized))"


@query("keyword_clusters", f"WITH RECURSIVE {ITEMS_SQL}, {_LEADERS} SELECT analysis_id, normalized, leader FROM led")
def q_clusters(spark, sf_dir):
    return keyword_clusters(items(spark, sf_dir)).select("analysis_id", "normalized", "leader")


@query("keyword_analysis", f"""WITH RECURSIVE {ITEMS_SQL}, {_LEADERS}, {_BY_LEADER}, {_PROFILE_TAIL}
 SELECT c.analysis_id, c.keyword, c.intent, {_case('c.intent', K.PAGE_TYPE)} AS page_type,
   CAST(least(100, 35 + {_case('c.intent', K.INTENT_PRIORITY_BOOST)} + least(p.size * 4, 24) + least(c.n_tokens * 2, 10)) AS INT) AS priority,
   p.name AS cluster, p.primary_keyword, p.suggested_slug, p.confidence
 FROM clustered c JOIN profiles p USING (analysis_id, cluster_id)""")
def q_analysis(spark, sf_dir):
    clustered = stage(keyword_clusters(items(spark, sf_dir)))
    profiles = stage(kw.cluster_profiles(clustered))
    rows = kw.keyword_cluster_join(kw.keyword_rows(clustered, profiles), profiles)
    return rows.select("analysis_id", "keyword", "intent", "page_type", "priority", "cluster", "primary_keyword",
                       "suggested_slug", "confidence")


@query("keyword_files", """SELECT analysis_id, 1 + n + CAST(floor(n / 7) AS BIGINT) AS line_no, trim(raw) AS raw FROM (
 SELECT analysis_id, raw, row_number() OVER (PARTITION BY analysis_id ORDER BY line_no) - 1 AS n FROM {fx_keywords})""")
def q_keyword_files(spark, sf_dir):
    """Keyword lists written as files with a header, a second field and a blank line after every seven, and read back."""
    path = f"{staging_dir(spark).rstrip('/')}/siteloom-{uuid.uuid4().hex}"
    rows = bucketed_rank(table(spark, sf_dir, "fx_keywords"), ["analysis_id"], F.floor(F.col("line_no") / 10_000), ["line_no"], "n")
    head = rows.select("analysis_id").distinct().select("analysis_id", F.lit(0).cast("long").alias("n"), F.lit("Keyword;Volume\r").alias("value"))
    body = rows.select("analysis_id", "n", F.concat("raw", F.lit(";12"), F.when(F.col("n") % 7 == 0, "\n").otherwise("")).alias("value"))
    lists = head.unionByName(body).repartition("analysis_id").sortWithinPartitions("analysis_id", "n")
    lists.drop("n").write.partitionBy("analysis_id").text(path)
    found = readers.read_keyword_lists(spark, f"{path}/*/*.txt")
    return found.select(F.regexp_extract("analysis_id", "analysis_id=([0-9]+)", 1).cast("int").alias("analysis_id"), "line_no", "raw")
