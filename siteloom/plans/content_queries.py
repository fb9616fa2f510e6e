"""Registered queries over recommendations, briefs and keyed merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteloom.functions import constants as K
from siteloom.operators import briefs, keywords as kw, recommendations, upsert
from siteloom.plans.keyword_queries import _PROFILE, _case, word_clusters
from siteloom.plans.registry import query
from siteloom.plans.tables import table

_P = K.GATE_WARNINGS


def _alt(patterns) -> str:
    return "(?i)" + "|".join(patterns)


_TESTS = {
    "summary": "length(trim(summary)) < 20", "impact": "length(trim(why_it_matters)) < 30",
    "implementation": "length(trim(implementation)) < 45", "verification": "n_verification < 2", "steps": "n_verification = 3",
    "guarantee": f"regexp_matches(body, '{_alt(K.GUARANTEE_PATTERNS)}')",
    "manipulation": f"regexp_matches(body, '{_alt(K.MANIPULATION_PATTERNS)}')", "code": "length(code) > 12000",
}
_SCORE = "100 " + " ".join(f"- CASE WHEN {t} THEN {_P[k][0]} ELSE 0 END" for k, t in _TESTS.items())
_WARN = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{_P[k][1]}' END" for k, t in _TESTS.items()) + "], lambda x: x IS NOT NULL), '|')"


@query("recommendation_gate", f"""WITH b AS (SELECT *, concat(summary, chr(10), why_it_matters, chr(10), implementation, chr(10), code) AS body FROM {{fx_recommendations}}),
 s AS (SELECT *, greatest(0, least(100, {_SCORE})) AS score, {_WARN} AS warnings FROM b)
 SELECT conv_id, turn, CAST(score AS INT) AS score, warnings, score >= 65 AND NOT contains(warnings, 'manipulative') AS passed FROM s""".replace("{{", "{").replace("}}", "}"))
def q_gate(spark, sf_dir):
    recs = table(spark, sf_dir, "fx_recommendations").withColumn("verification", F.expr(
        "array_repeat(CASE WHEN n_verification = 3 THEN 'look' ELSE 'Run the check again' END, n_verification)"))
    out = recommendations.recommendation_gate(recs)
    return out.select("conv_id", "turn", "score", F.array_join("warnings", "|").alias("warnings"), "passed")


_TITLE = "array_to_string(list_transform(string_split(primary_keyword, ' '), lambda w: concat(upper(substr(w, 1, 1)), substr(w, 2))), ' ')"
_Q = "array_to_string(list_concat([concat('What is ', primary_keyword, '?'), concat('How does ', primary_keyword, ' work?'), concat('What should be checked before using ', primary_keyword, '?')], " \
     "CASE intent WHEN 'transactional' THEN [concat('How should a ', primary_keyword, ' provider be evaluated?'), concat('What affects the cost of ', primary_keyword, '?')] " \
     "WHEN 'commercial' THEN [concat('Which ', primary_keyword, ' option fits each use case?'), 'What are the main trade-offs?'] " \
     "WHEN 'local' THEN [concat('Is ', primary_keyword, ' available in the target area?'), 'What local proof should be verified?'] ELSE [] END), '|')"


def _meta(text: str, n: int) -> str:
    return (f"CASE WHEN length({text}) <= {n} THEN {text} ELSE concat(trim(regexp_replace(substr({text}, 1, {n - 1}), '\\s+\\S*$', '')), '…') END")


_BRIEFS = f"""{_PROFILE}, h AS (SELECT *, {_TITLE} AS h1 FROM profiles),
 t AS (SELECT * EXCLUDE (name), concat(h1, ' — ', CASE page_type WHEN 'comparison' THEN 'Comparison & Selection Guide' WHEN 'landing' THEN 'Services & Solutions' ELSE 'Practical Guide' END) AS full_title,
   concat('Explore ', primary_keyword, ', key considerations, practical steps, and clear recommendations for making an informed decision.') AS full_meta FROM h),
 briefs AS (SELECT *, concat(h1, ' content brief') AS name, {_meta('full_title', 60)} AS title, {_meta('full_meta', 155)} AS meta_description, {_Q} AS questions,
   CAST({_case('page_type', {k: len(v) for k, v in K.OUTLINES.items()})} AS INT) AS n_sections FROM t)"""


def brief_rows(spark, sf_dir):
    items = word_clusters(spark, sf_dir)
    profiles = kw.cluster_profiles(items)
    return briefs.content_briefs(briefs.cluster_keyword_lists(items, profiles))


@query("content_briefs", f"WITH {_BRIEFS} SELECT analysis_id, cluster_id, name, intent, page_type, suggested_slug, title, meta_description, h1, questions, n_sections FROM briefs")
def q_briefs(spark, sf_dir):
    return brief_rows(spark, sf_dir).select(
        "analysis_id", "cluster_id", "name", "intent", "page_type", "suggested_slug", "title", "meta_description", "h1",
        F.array_join("questions", "|").alias("questions"), F.size("outline").alias("n_sections"))


_EDIT_NAME = "CASE WHEN size % 2 = 0 THEN concat('  Edited   ', primary_keyword) WHEN size % 5 = 0 THEN repeat('x', 101) END"


@query("brief_merge", f"""WITH {_BRIEFS}, e AS (SELECT *, {_EDIT_NAME} AS new_name FROM briefs)
 SELECT analysis_id, cluster_id, CASE WHEN new_name IS NULL OR length(new_name) > 100 THEN name ELSE trim(regexp_replace(new_name, '\\s+', ' ', 'g')) END AS name, title,
   CASE WHEN size % 2 = 0 THEN 'review' ELSE 'draft' END AS status FROM e""")
def q_merge(spark, sf_dir):
    items = word_clusters(spark, sf_dir)
    profiles = kw.cluster_profiles(items)
    rows = briefs.content_briefs(briefs.cluster_keyword_lists(items, profiles))
    edits = rows.join(profiles.select("analysis_id", "cluster_id", "size"), ["analysis_id", "cluster_id"]).select(
        "brief_id", F.expr(_EDIT_NAME).alias("name"), F.expr("CASE WHEN size % 2 = 0 THEN 'review' ELSE 'unknown' END").alias("status"))
    merged, _ = briefs.merge_brief_edits(rows, edits)
    return merged.select("analysis_id", "cluster_id", "name", "title", "status")


@query("merge_upsert", """SELECT c_custkey AS id, CAST(100 + count(o_orderkey) AS BIGINT) AS uses, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) FILTER (WHERE o_orderstatus = 'F') AS note,
 arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, coalesce(arg_max(o_orderkey, (o_orderdate, o_orderkey)), -1) AS last_order
 FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey GROUP BY c_custkey""")
def q_upsert(spark, sf_dir):
    base = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id", "100L AS uses", "CAST(NULL AS STRING) AS note", "CAST(NULL AS BIGINT) AS first_order", "-1L AS last_order")
    updates = table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS id", "1L AS uses", "CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS note", "o_orderkey AS first_order",
        "o_orderkey AS last_order", "struct(o_orderdate, o_orderkey) AS at")
    policy = {"uses": "add", "note": "keep", "first_order": "first", "last_order": "overwrite"}
    return upsert.merge_upsert(base, updates, ["id"], policy, "at")
