"""Registered queries over written exports: reports as documents in pieces, read back from their files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siteloom.operators import findings, scoring
from siteloom.plans.audit_queries import ALL_ISSUES_SQL, fixture_audit
from siteloom.plans.registry import query
from siteloom.plans.tables import table
from siteloom.session import stage, staging_dir
from siteloom.sinks import writers

_JSON = "replace(replace(replace(t, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)), chr(10), chr(92) || 'n')"
_G = "audit_id, code, severity, title, recommendation"


def _members(key: str) -> str:
    return f"""SELECT p.audit_id, 'duplicate-{key}' AS code, d.first_seq AS a, CAST(floor(p.seq / 4096) AS BIGINT) AS b, substr(d.value, 1, 240) AS shared, p.seq, p.url
      FROM {{fx_pages}} p JOIN dup_{key} d ON d.audit_id = p.audit_id AND lower(trim(p.{key})) = d.value"""


PIECES_SQL = f"""{ALL_ISSUES_SQL},
 e AS (SELECT {_G}, trim(evidence) AS v, min(seq) AS s, min((seq, rule_no)) AS o, CAST(floor(min(seq) / 4096) AS BIGINT) AS a FROM issues WHERE trim(evidence) <> '' GROUP BY {_G}, trim(evidence)),
 u AS (SELECT {_G}, url AS v, min((seq, rule_no)) AS o, CAST(floor(min(seq) / 4096) AS BIGINT) AS a FROM issues WHERE url <> '' GROUP BY {_G}, url),
 eb AS (SELECT {_G}, a, string_agg(v, chr(10) || chr(10) ORDER BY o, v) AS t FROM e GROUP BY {_G}, a),
 ub AS (SELECT {_G}, a, CASE WHEN count(*) > 1 THEN concat('Affected URLs:', chr(10), string_agg(v, chr(10) ORDER BY o, v)) END AS t FROM u GROUP BY {_G}, a),
 usual AS (SELECT {_G}, a, 0 AS b, chr(10) || chr(10) AS joint, concat_ws(chr(10) || chr(10), eb.t, ub.t) AS t FROM eb FULL OUTER JOIN ub USING ({_G}, a)
   WHERE eb.t IS NOT NULL OR ub.t IS NOT NULL),
 m AS ({_members('title')} UNION ALL {_members('description')}),
 d AS (SELECT audit_id, code, a, b, min(seq) = a AS opens, concat(CASE WHEN min(seq) = a THEN concat(min(shared), chr(10)) ELSE '' END, string_agg(url, chr(10) ORDER BY seq)) AS t
   FROM m GROUP BY audit_id, code, a, b),
 dup AS (SELECT g.audit_id, code, g.severity, g.title, g.recommendation, a, b, CASE WHEN opens THEN chr(10) || chr(10) ELSE chr(10) END AS joint, t
   FROM d JOIN (SELECT DISTINCT {_G} FROM issues) g USING (audit_id, code)),
 pieces AS (SELECT *, row_number() OVER (PARTITION BY {_G} ORDER BY a, b) = 1 AS first FROM (SELECT * FROM usual UNION ALL BY NAME SELECT * FROM dup))"""


@query("report_evidence", f"""WITH {PIECES_SQL}, j AS (SELECT *, concat(CASE WHEN first THEN '' ELSE joint END, t) AS whole FROM pieces)
 SELECT audit_id, code, severity, title, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, {_JSON.replace('(t,', '(whole,')} AS value FROM j""")
def q_report_evidence(spark, sf_dir):
    """The evidence of every group as it stands in the written reports, duplicate findings with their members."""
    audit = fixture_audit(spark, sf_dir)
    parts = stage(audit.parts)
    duplicates = findings.duplicate_evidence(table(spark, sf_dir, "fx_pages"))
    pieces = writers.audit_report_pieces(audit.header, scoring.group_issues(parts), writers.evidence_pieces(scoring.evidence_chunks(parts), duplicates))
    path = f"{staging_dir(spark).rstrip('/')}/siteloom-{uuid.uuid4().hex}"
    writers.write_audit_reports(pieces, path)
    return spark.read.parquet(path).filter(F.col("kind") == 1).select("audit_id", "code", "severity", "title", "a", "b", "value")
