"""Small literal inputs with known answers."""

import datetime as dt
import json

from pyspark.sql import functions as F

from siteloom.functions import text as X
from siteloom.functions import urls as U
from siteloom.functions.html import extract_page_features, page_links
from siteloom.operators import (briefs, findings, history, jobs, keywords as kw, monitoring, network, recommendations,
                                scoring, search, semantic, sitefiles)
from siteloom.operators.leaders import keyword_clusters


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def col(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


def test_targets(spark):
    raw = ["example.com/path#section", "http://127.0.0.1", "10.1.2.3", "192.168.1.1", "http://[::1]/", "example.com:8443",
           "printer.local", "https://u:p@x.com", "", "https://" + "a" * 2100]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(raw)], "i int, raw string")
    rows = U.validate_targets(df, "raw").orderBy("i").collect()
    assert rows[0].normalized_url == "https://example.com/path" and rows[0].reject_reason is None
    assert [r.reject_reason for r in rows[1:]] == [
        "private-address"] * 4 + ["port", "private-host", "credentials", "empty", "too-long"]


def test_canonical_urls(spark):
    many = "/p?" + "&".join(f"k{i}=1" for i in range(13))
    raw = ["/products?utm_source=test&B=2&a=1&fbclid=x", many, "https://other.com/", "/file.pdf", "mailto:a@b.c", "../x/./y?q"]
    df = spark.createDataFrame([(i, v, "https://example.com/a/b") for i, v in enumerate(raw)], "i int, u string, b string")
    got = [r.canonical_url for r in U.canonicalize_urls(df, "u", "b").orderBy("i").collect()]
    assert got == ["https://example.com/products?B=2&a=1", None, None, None, None, "https://example.com/x/y?q="]


def test_url_normal_forms(spark):
    urls = [None, "https://a.com/about/", "https://a.com/about", "https://A.com:443", "https://a.com/x/?q=1#f", "Not A Url "]
    assert col(spark, urls, U.normalize_issue_url) == [
        "site-wide", "https://a.com/about", "https://a.com/about", "https://a.com/", "https://a.com/x?q=1", "not a url"]
    assert col(spark, urls[1:], U.normalize_link_url) == [
        "https://a.com/about", "https://a.com/about", "https://a.com/", "https://a.com/x", "Not A Url "]
    assert col(spark, ["https://a.com/x-y/a+b%20c", "https://a.com/%zz"], U.decoded_path) == ["/x y/a+b c", "https://a.com/%zz"]


def test_robots(spark):
    body = "User-agent: *\nDisallow: /\n\nUser-agent: sitebot\nDisallow: /private/\nAllow: /private/public/\nCrawl-delay: 10"
    rules = sitefiles.parse_robots(spark.createDataFrame([(1, body), (2, "User-agent: *\nDisallow: /*.pdf$")],
                                                         "audit_id int, body string"), "sitebot")
    assert rules.filter("audit_id = 1").select(F.max("crawl_delay_ms")).first()[0] == 2000
    urls = [(1, "https://e.com/private/page"), (1, "https://e.com/private/public/page"), (1, "https://e.com/products"),
            (2, "https://e.com/file.pdf"), (2, "https://e.com/file.pdf?download=1"), (3, "https://e.com/any")]
    out = sitefiles.robots_filter(spark.createDataFrame(urls, "audit_id int, url string"), rules)
    assert {r.url: r.allowed for r in out.collect()} == dict(zip([u for _, u in urls], [False, True, True, False, True, True]))


def test_robots_groups_close_on_directives(spark):
    body = "Disallow: /x\nUser-agent: a\nUser-agent: *\nDisallow:\nUser-agent: b\nDisallow: /b # note\nSitemap: https://e.com/m.xml"
    docs = spark.createDataFrame([(1, body)], "audit_id int, body string")
    assert sitefiles.parse_robots(docs, "zzz").count() == 0
    assert [r.pattern for r in sitefiles.parse_robots(docs, "bbot").collect()] == ["/b"]
    assert [r.doc_url for r in sitefiles.declared_sitemaps(docs).collect()] == ["https://e.com/m.xml"]


def test_sitemaps(spark):
    docs = [("i", "<sitemapindex><sitemap><loc><![CDATA[https://e.com/a.xml?x=1&amp;y=2]]></loc></sitemap></sitemapindex>"),
            ("u", "<urlset><url><loc> https://e.com/1 </loc></url><url><loc>https://e.com/2</loc></url></urlset>"), ("n", "<rss/>"),
            ("c", "<urlset>" + "".join(f"<url><loc>https://e.com/{i}</loc></url>" for i in range(120)) + "</urlset>")]
    landed = spark.createDataFrame(docs, "d string, body string")

    def listed(limit=None):
        out = {}
        for r in sitefiles.sitemap_locations(landed, limit).orderBy("d", "at").collect():
            out.setdefault((r.d, r.kind), []).extend([] if r.loc is None else [r.loc])
        return out
    found = listed()
    assert found["i", "sitemapindex"] == ["https://e.com/a.xml?x=1&y=2"]
    assert found["u", "urlset"] == ["https://e.com/1", "https://e.com/2"]
    assert found["n", None] == [] and len(found["c", "urlset"]) == 120 and len(listed(100)["c", "urlset"]) == 100


def test_sitemap_tree_reaches_its_fixed_point(spark):
    s = "https://e.com"
    index = lambda *urls: "<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in urls) + "</sitemapindex>"
    urls = lambda *paths: "<urlset>" + "".join(f"<url><loc>{s}{p}</loc></url>" for p in paths) + "</urlset>"
    many = [f"/p{i:03d}" for i in range(150)]
    docs = [(1, f"{s}/sitemap.xml", index(*[f"{s}/m{i}.xml" for i in range(9)], "/deep.xml")),
            (1, f"{s}/deep.xml", index(f"{s}/sitemap.xml", "/deeper.xml", f"{s}/m0.xml")), (1, f"{s}/deeper.xml", urls("/z", "/p000")),
            (1, f"{s}/m0.xml", urls(*many)), (1, f"{s}/m8.xml", urls("/y")), (1, f"{s}/other.xml", urls("/never")),
            (2, f"{s}/declared.xml", urls("/d")), (3, f"{s}/sitemap.xml", "<rss/>")]
    roots = spark.createDataFrame([(i, f"{s}/") for i in (1, 2, 3)], "audit_id long, root_url string")
    declared = spark.createDataFrame([(2, f"{s}/declared.xml", 4)], "audit_id long, doc_url string, line int")
    landed = spark.createDataFrame(docs, "audit_id long, doc_url string, body string")
    found, seen = sitefiles.sitemap_tree(landed, roots, declared)
    got = {i: [r.url for r in found.filter(f"audit_id = {i}").orderBy("position").collect()] for i in (1, 2, 3)}
    assert got == {1: [f"{s}{p}" for p in [*many, "/y", "/z"]], 2: [f"{s}/d"], 3: []}
    order = [r.doc_url for r in seen.filter("audit_id = 1").orderBy("position").collect()]
    assert order == [f"{s}/{n}.xml" for n in ["sitemap", *[f"m{i}" for i in range(9)], "deep", "deeper"]]
    assert {(r.audit_id, r.doc_url): r.kind for r in seen.collect()}[3, f"{s}/sitemap.xml"] is None
    few, docs_seen = sitefiles.sitemap_tree(landed, roots, declared, max_files=6, max_urls=100)
    assert [r.url for r in few.filter("audit_id = 1").orderBy("position").collect()] == [f"{s}{p}" for p in many[:100]]
    assert docs_seen.filter("audit_id = 1").count() == 6


HTML = """<html lang="en"><head><title> A &amp; B </title><meta name="Description" content=" d "><meta property="og:title" content="t">
<link rel="canonical" href="/c"><script type="application/ld+json">{}</script></head><body><svg><title>no</title></svg>
<h1>x <b>y</b></h1><h1> </h1><h2>s</h2><p>Visible words only</p><script>var a</script><style>s</style><img alt=""><img src="x">
<a href="../q?x=1#f">k</a><a href="/q?x=1">again</a><a href="https://o.com">o</a><a href="mailto:x@y">m</a></body></html>"""


def test_page_features(spark):
    row = one(extract_page_features(spark.createDataFrame([(1, "https://e.com/a/", HTML)], "audit_id int, url string, html string")))
    assert (row.title, row.description, row.canonical, row.canonical_resolved, row.lang) == (
        "A & B", "d", "/c", "https://e.com/c", "en")
    assert row.h1 == ["x y"] and row.heading_count == 3 and row.schema_count == 1
    assert (row.image_count, row.images_missing_alt, row.og_title, row.og_description) == (2, 1, "t", "")
    assert row.internal_links == ["https://e.com/q?x=1"] and row.external_links == ["https://o.com/"]


def test_word_count_ignores_hidden_text(spark):
    html = "<body><p>Visible words only</p><script>not me</script><style>nor me</style></body>"
    df = extract_page_features(spark.createDataFrame([("https://e.com/", html)], "url string, html string"))
    assert one(df).word_count == 3
    assert page_links(df.withColumn("audit_id", F.lit(1)), "audit_id").count() == 0


def issues(spark, rows):
    return spark.createDataFrame(rows, "audit_id int, seq int, rule_no int, code string, severity string, title string, "
                                       "recommendation string, description string, url string, evidence string")


def test_grouping_and_score(spark):
    three = issues(spark, [(1, i, 0, "h1-missing", "high", "Missing H1", "Add", "No heading.", f"https://e.com/{i}", None)
                           for i in range(3)])
    group = one(scoring.group_issues(scoring.grouped_issue_parts(three)))
    assert group.description == "3 crawled pages are affected. No heading." and group.n_urls == 3
    text = one(scoring.evidence_chunks(scoring.grouped_issue_parts(three))).evidence
    assert text == "Affected URLs:\nhttps://e.com/0\nhttps://e.com/1\nhttps://e.com/2"
    many = issues(spark, [(1, i, 0, "h1-missing", "high", "t", "r", "d", f"https://e.com/{i}", None) for i in range(25)])
    sizes = spark.createDataFrame([(1, 25), (2, 3)], "audit_id int, pages_scanned int")
    scores = {r.audit_id: r.score for r in scoring.audit_score(scoring.issue_url_counts(many), sizes).collect()}
    assert scores == {1: 86, 2: 100}


def test_page_rules_are_exclusive(spark):
    cols = ("audit_id int, seq int, url string, status int, title string, description string, canonical string, robots string, "
            "lang string, h1_count int, word_count int, images_missing_alt int, image_count int, og_title string, "
            "og_description string, load_time_ms int")
    page = spark.createDataFrame([(1, 1, "https://e.com/p", 503, "", "x", "https://o.com/#f", "NOINDEX", "", 0, 10, 1, 2, "", "", 4000)], cols)
    codes = [r.code for r in findings.detect_page_issues(page).orderBy("rule_no").collect()]
    assert codes == ["http-5xx", "title-missing", "description-short", "h1-missing", "canonical-cross-origin", "canonical-fragment",
                     "meta-noindex", "lang-missing", "thin-content", "image-alt-missing", "open-graph-incomplete", "slow-response"]


def test_issue_diff_over_evidence(spark):
    rows = [(1, 0, 0, "c", "high", "t", "r", "d", None, "Shared:\nhttps://e.com/a\nhttps://e.com/b"),
            (2, 0, 0, "c", "high", "t", "r", "d", None, "Shared:\nhttps://e.com/a/\nhttps://e.com/c")]
    pairs = spark.createDataFrame([(2, 1)], "audit_id int, previous_audit_id int")
    got = {r.fingerprint: r.status for r in history.issue_diff(issues(spark, rows), pairs).collect()}
    assert got == {"c|https://e.com/a": "persistent", "c|https://e.com/b": "fixed", "c|https://e.com/c": "new"}


def test_intents(spark):
    texts = ["how to automate SEO reports", "best technical seo tools", "python automation services price", "acme official website",
             "seo consultant in lviv", "сайт компанії"]
    got = col(spark, texts, lambda c: X.classify_intent(X.normalize_keyword(c), X.tokenize(X.normalize_keyword(c))))
    assert got == ["informational", "commercial", "transactional", "navigational", "local", "navigational"]


def test_keyword_lists(spark):
    from siteloom.sources.readers import keyword_lines
    body = "﻿keyword,volume\nTechnical SEO Audit,100\n\"technical seo audit\";5\nseo tools\t3\n\"a, \"\"b\"\" c\",9\n"
    raw = keyword_lines(spark.createDataFrame([("x", body)], "analysis_id string, body string"))
    assert [r.raw for r in raw.orderBy("line_no").collect()] == ["Technical SEO Audit", "technical seo audit", "seo tools", 'a, "b" c']
    assert sorted(r.keyword for r in kw.distinct_keywords(raw).collect()) == ["Technical SEO Audit", 'a, "b" c', "seo tools"]


def test_leader_clusters_of_related_keywords(spark):
    words = ["technical seo audit", "technical seo audit checklist", "seo audit tool", "buy running shoes", "running shoes price"]
    raw = spark.createDataFrame([("x", i, w) for i, w in enumerate(words)], "analysis_id string, line_no int, raw string")
    out = {r.keyword: r.cluster_id for r in keyword_clusters(kw.distinct_keywords(raw)).collect()}
    assert out["technical seo audit"] == out["technical seo audit checklist"] == out["seo audit tool"]
    assert out["buy running shoes"] == out["running shoes price"] != out["seo audit tool"]


def test_large_cluster_confidence_matches_small_path(spark):
    rows = [("x", "c", f"k{i}", [f"t{i % 7}", f"t{i % 5 + 10}", "all"]) for i in range(90)]
    df = spark.createDataFrame(rows, "analysis_id string, cluster_id string, normalized string, tokens array<string>")
    small = one(kw.cluster_confidence(df, small=100)).confidence
    assert one(kw.cluster_confidence(df, small=10, block=16)).confidence == small
    assert one(kw.cluster_confidence(df.limit(1))).confidence == 100


def test_anchor_text(spark):
    titles = ["Technical SEO audit tool", "SEO in-depth guide - Acme", "Guide | Acme"]
    assert col(spark, titles, lambda c: U.anchor_text(F.lit(""), c, F.lit("https://e.com/x/y"))) == [
        "Technical SEO audit tool", "SEO in", "Guide"]


def test_search_opportunities(spark):
    rows = spark.createDataFrame([(1, "q", "p", 3.0, 500.0, 0.006, 8.2), (1, "r", "p", 0.0, 4.0, 0.0, 7.0)],
                                 "snapshot_id int, query string, page string, clicks double, impressions double, ctr double, position double")
    got = {r.kind: r.score for r in search.search_opportunities(rows).collect()}
    assert got == {"striking-distance": 99, "low-ctr": 100, "high-impressions": 85}


def test_addresses(spark):
    ips = ["10.0.0.1", "192.0.2.1", "198.51.100.7", "203.0.113.9", "8.8.8.8", "1.1.1.1", "::1", "fd00::1", "fe80::1", "2001:db8::1",
           "2606:4700::1111", "::ffff:169.254.1.1", "host", "300.1.1.1"]
    got = col(spark, ips, network.blocked_address)
    assert got == [True, True, True, True, False, False, True, True, True, True, False, True, True, True]
    hosts = spark.createDataFrame([("a",), ("b",), ("c",)], "host string")
    res = spark.createDataFrame([("a", "8.8.8.8"), ("b", "8.8.8.8"), ("b", "10.0.0.1")], "host string, ip string")
    assert {r.host: r.public for r in network.public_targets(hosts, res).collect()} == {"a": True, "b": False, "c": False}


def test_next_run_overflows(spark):
    df = spark.createDataFrame([("daily",), ("weekly",), ("monthly",), ("never",)], "c string")
    at = F.lit("2026-01-31 10:00:00").cast("timestamp")
    got = {r.c: r.n for r in df.select("c", monitoring.next_run_at(F.col("c"), at).alias("n")).collect()}
    assert got == {"daily": dt.datetime(2026, 2, 1, 10), "weekly": dt.datetime(2026, 2, 7, 10),
                   "monthly": dt.datetime(2026, 3, 3, 10), "never": None}


def test_alerts(spark):
    audits = spark.createDataFrame([(1, 52, 10, None, -18, "success"), (2, 90, 5, None, None, "failed"), (3, 90, 0, None, None, "idle")],
                                   "audit_id int, score int, pages_scanned int, stopped_reason string, score_delta int, previous_status string")
    diff = spark.createDataFrame([(1, "f1", "new", "critical", "Server error", 1), (1, "f2", "new", "high", "A", 2), (1, "f3", "new", "high", "B", 3),
                                  (1, "f4", "fixed", "high", "C", 4)], "audit_id int, fingerprint string, status string, severity string, title string, seq int")
    got = {(r.audit_id, r.kind): (r.severity, r.title, r.message) for r in monitoring.monitoring_alerts(audits, diff).collect()}
    assert got[(1, "score_drop")] == ("critical", "SEO score dropped by 18 points",
                                      "The score changed from 70 to 52. Review new regressions before the next run.")
    assert got[(1, "new_critical")][1:] == ("1 new critical issue", "Server error")
    assert got[(1, "new_high")][1:] == ("2 new high-priority issues", "A; B")
    assert got[(2, "recovery")][0] == "info" and got[(3, "crawl_problem")][2] == "No HTML pages were scanned."
    assert len(got) == 5


def test_job_progress(spark):
    df = spark.createDataFrame([(0, 25, "discovering"), (0, 25, "crawling"), (25, 25, "crawling"), (10, 25, "crawling"), (25, 25, "finalizing")],
                               "p int, m int, f string")
    assert [r[0] for r in df.select(jobs.job_progress(F.col("p"), F.col("m"), F.col("f"))).collect()] == [5, 8, 92, 42, 95]


def test_gate(spark):
    good = ("Add one descriptive title to every page.", "Search engines use the title to understand what the page offers.",
            "Edit the page template so that each page prints its own title in the head element.", None,
            ["Run the audit again", "Check the rendered head"])
    bad = ("We guarantee rankings.", "x", "Buy backlinks and use cloaking", None, ["ok"])
    df = spark.createDataFrame([good, bad], "summary string, why_it_matters string, implementation string, code string, verification array<string>")
    a, b = recommendations.recommendation_gate(df).collect()
    assert (a.score, a.passed, a.warnings) == (100, True, [])
    assert b.score == 0 and not b.passed and any("manipulative" in w for w in b.warnings)


def test_parse_recommendations(spark):
    raw = ['```json\n{"summary":"s","whyItMatters":"w","implementation":"i","verification":["a","b"]}\n```', "no json", '{"summary":"s"}']
    good, bad = recommendations.parse_recommendations(spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string"), "raw")
    row = one(good)
    assert (row.summary, row.why_it_matters, row.verification, row.code) == ("s", "w", ["a", "b"], None)
    assert {r.i: r.reject_reason for r in bad.collect()} == {1: "invalid-json", 2: "missing-fields"}
    long = {"summary": "s" * 2001, "whyItMatters": "w" * 4001, "implementation": "i" * 8001, "code": "c" * 12001, "verification": ["v"] * 9}
    text = spark.createDataFrame([(0, json.dumps(long))], "i int, raw string")
    whole = one(recommendations.parse_recommendations(text, "raw")[0])
    assert [len(whole[k]) for k in ("summary", "why_it_matters", "implementation", "code", "verification")] == [2001, 4001, 8001, 12001, 9]
    cut = one(recommendations.parse_recommendations(text, "raw", recommendations.LIMITS, 8)[0])
    assert [len(cut[k]) for k in ("summary", "why_it_matters", "implementation", "code", "verification")] == [2000, 4000, 8000, 12000, 8]


def test_cosine(spark):
    rows = [([1.0, 2.0, 3.0], [1.0, 2.0, 3.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0], [1.0, 2.0]), ([], []), ([0.0], [1.0])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a array<double>, b array<double>")
    got = [r.c for r in df.select("i", semantic.cosine_similarity(F.col("a"), F.col("b")).alias("c")).orderBy("i").collect()]
    assert [round(x, 9) for x in got] == [1.0, 0.0, 0.0, 0.0, 0.0]


def test_briefs(spark):
    rows = [("a", "c1", "technical seo services", "transactional", "landing", "/s/", ["technical seo services", "how much is seo", "SEO help"]),
            ("a", "c2", "x", "wrong", "landing", "/s/", [])]
    df = spark.createDataFrame(rows, "analysis_id string, cluster_id string, primary_keyword string, intent string, page_type string, "
                                     "suggested_slug string, keywords array<string>")
    brief = one(briefs.content_briefs(df))
    assert brief.h1 == "Technical Seo Services" and brief.name == "Technical Seo Services content brief"
    assert len(brief.outline) == 7 and brief.outline[0].heading == "Technical Seo Services: outcome and value"
    assert brief.supporting_keywords == ["how much is seo", "SEO help"]
    assert brief.questions[-1] == "how much is seo?" and len(brief.questions) == 6 and brief.schema_types[0] == "Service"
    edits = spark.createDataFrame([(brief.brief_id, "  New   name ", None, "review"), ("other", None, " ", "draft")],
                                  "brief_id string, name string, title string, status string")
    merged, rejected = briefs.merge_brief_edits(briefs.content_briefs(df), edits)
    row = one(merged)
    assert (row.name, row.status, row.title) == ("New name", "review", brief.title)
    assert one(rejected).reject_reason == "title:required"


def test_text_helpers(spark):
    assert col(spark, ["in-depth guide – kyiv", "éa bÉ"], X.title_case) == ["In-Depth Guide – Kyiv", "Éa BÉ"]
    assert col(spark, ["short", "one two three four"], lambda c: X.trim_meta(c, 10)) == ["short", "one two…"]
    assert col(spark, ["7.9", "-1", "x", None, "Infinity"], lambda c: X.positive_limit(c, 5)) == [7, 5, 5, 5, 5]
    assert col(spark, ['a"b', "x\ny", "p,q", None], X.csv_cell) == ['"a""b"', "x y", '"p,q"', ""]
    assert col(spark, ["What’s  ＡＢＣ"], X.normalize_keyword) == ["what's abc"]
    assert col(spark, ["Don't stop", "!!!"], X.slugify) == ["/dont-stop/", "/topic/"]


def test_monitor_folding(spark):
    m = spark.createDataFrame([(1, "daily", True, dt.datetime(2026, 1, 1), None, 7, "idle", None, dt.datetime(2026, 1, 1))],
                              "monitor_id int, cadence string, enabled boolean, next_run_at timestamp, last_run_at timestamp, last_audit_id int, "
                              "last_status string, last_error string, updated_at timestamp")
    runs = spark.createDataFrame([(1, dt.datetime(2026, 1, 2), None, "failed", "boom")],
                                 "monitor_id int, finished_at timestamp, audit_id int, status string, error string")
    row = one(monitoring.monitor_run_update(m, runs))
    assert (row.last_audit_id, row.last_status, row.last_error, row.next_run_at) == (7, "failed", "boom", dt.datetime(2026, 1, 3))
    off = spark.createDataFrame([(1, False)], "monitor_id int, enable boolean")
    assert one(monitoring.set_monitor_enabled(m, off, F.current_timestamp())).next_run_at == dt.datetime(2026, 1, 1)
    assert one(monitoring.failed_run_alerts(runs)).message == "boom"


def test_normal_urls_pass_by_one_test(spark):
    same = ["https://a.example.com/", "http://a-b.example/x/y?q=1&r=%20#f", "https://e.com/.."]
    changed = {"HTTPS://A.example.com/x": "https://a.example.com/x", "https://a.example.com": "https://a.example.com/", "https://e.com:443/x": "https://e.com/x",
               " https://e.com/x ": "https://e.com/x", "https://e.com/x\n": "https://e.com/x", "https://e.com/x y": "https://e.com/x y", "ftp://e.com/": None, None: None}
    rows = spark.createDataFrame([(u,) for u in [*same, *changed]], "u string").select("u", U.absolute_url(F.col("u")).alias("a"),
                                                                                      F.col("u").rlike(U._NORMAL).alias("n")).collect()
    assert {r.u: r.a for r in rows} == {u: u for u in same} | changed
    assert {r.u for r in rows if r.n} == set(same)
