"""Sources, sinks, streaming forms and the capture audit on small inputs."""

import csv
import datetime as dt
import json
import random
import time

from pyspark.sql import functions as F

from siteloom.functions import constants as K
from siteloom.operators import findings, history, jobs, monitoring, scoring, upsert, usage
from siteloom.plans.audit import audit_captures, parse_captures
from siteloom.sinks import writers
from siteloom.sources import readers, schemas
from siteloom.streaming import streams


def page(title, *hrefs):
    return f"<html lang='en'><head><title>{title}</title></head><body><h1>{title}</h1>" + "".join(
        f"<a href='{h}'>x</a>" for h in hrefs) + "</body></html>"


def test_capture_audit(spark):
    s = "https://e.com"
    rows = [(1, f"{s}/", f"{s}/", 200, "text/html", 10, page("Home", "/a", "/b?utm_source=x", "/private", "/gone"), None),
            (1, f"{s}/a", f"{s}/a", 200, "text/html", 10, page("Same", "/", "/away"), None),
            (1, f"{s}/b", f"{s}/b", 200, "text/html", 10, page("same "), None),
            (1, f"{s}/private", f"{s}/private", 200, "text/html", 10, page("P"), None),
            (1, f"{s}/gone", f"{s}/gone", 404, "text/plain", 10, "", None),
            (1, f"{s}/away", "https://other.com/", 200, "text/html", 10, page("O"), None),
            (1, f"{s}/lost", f"{s}/lost", 200, "text/html", 10, page("Lost page nobody links"), None)]
    caps = spark.createDataFrame(rows, "audit_id long, url string, final_url string, status int, content_type string, load_time_ms int, "
                                       "html string, error string")
    roots = spark.createDataFrame([(1, f"{s}/")], "audit_id long, root_url string")
    robots = spark.createDataFrame([(1, "User-agent: *\nDisallow: /private")], "audit_id long, body string")
    maps = spark.createDataFrame([(1, f"{s}/sitemap.xml", f"<urlset><url><loc>{s}/lost</loc></url></urlset>")],
                                 "audit_id long, doc_url string, body string")
    out = audit_captures(caps, roots, robots, maps, "sitebot", 25)
    got = {(r.code, r.url) for r in out.issues.collect()}
    assert ("robots-blocked", f"{s}/private") in got and ("http-404", f"{s}/gone") in got
    assert ("external-redirect", f"{s}/away") in got and ("orphan-in-crawl", f"{s}/lost") in got
    assert ("duplicate-title", f"{s}/a") in got
    assert not {c for c, _ in got} & {"robots-missing", "sitemap-missing"}
    head = out.header.first()
    assert (head.pages_scanned, head.root_url, head.stopped) == (4, f"{s}/", False)


def test_captures_are_chosen_by_key(spark):
    s = "https://e.com"
    rows = [(1, 5, f"{s}/", f"{s}/", 200, "text/html", 10, page("Home", "/a", "/to-b", "/b"), None),
            (1, 2, f"{s}/", f"{s}/", 200, "text/html", 10, page("An older home", "/never"), None),
            (1, 9, f"{s}/a?utm_source=x", f"{s}/a", 200, "text/html", 10, page("A variant", "/never"), None),
            (1, 3, f"{s}/a", f"{s}/a", 200, "text/html", 10, page("Page a"), None),
            (1, 4, f"{s}/to-b", f"{s}/b", 200, "text/html", 10, page("Reached first", "c"), None),
            (1, 8, f"{s}/b", f"{s}/b", 200, "text/html", 10, page("Reached later", "/never"), None),
            (1, 6, f"{s}/c", None, None, None, None, None, "timed out"), (1, 7, f"{s}/never", f"{s}/never", 200, "text/html", 10, page("N"), None),
            (1, 7, "mailto:x", None, 200, "text/html", 10, page("N"), None), (2, 1, "https://f.com/", None, None, None, None, None, "lost")]
    caps = spark.createDataFrame(rows, "audit_id long, seq long, url string, final_url string, status int, content_type string, "
                                       "load_time_ms int, html string, error string")
    roots = spark.createDataFrame([(1, f"{s}/"), (2, "https://f.com/"), (3, "https://g.com/")], "audit_id long, root_url string")
    parsed = parse_captures(caps)
    assert parsed.count() == len(rows) and "html" not in parsed.columns
    none = spark.createDataFrame([], "audit_id long, body string, doc_url string")
    out = audit_captures(caps, roots, none.select("audit_id", "body"), none, "sitebot", 25)
    got = {r.url: r.title for r in out.pages.collect()}
    assert got == {f"{s}/": "Home", f"{s}/a": "Page a", f"{s}/b": "Reached first"}
    found = {(r.audit_id, r.code, r.url, r.description) for r in out.issues.filter("code in ('crawl-failed', 'robots-missing')").collect()}
    assert (1, "crawl-failed", f"{s}/c", "timed out") in found and (2, "crawl-failed", "https://f.com/", "lost") in found
    assert audit_captures(caps.limit(0), roots, none.select("audit_id", "body"), none, "sitebot").header.count() == 0


def test_result_json_keeps_bad_rows(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": ["x"]}'), (2, "broken"), (3, None)], "i int, j string")
    got = {r.i: r.result for r in readers.read_result_json(df, "j", "a int, b array<string>").collect()}
    assert got[1].a == 1 and got[1].b == ["x"] and got[2] is None and got[3] is None


def test_keyword_files_in_several_splits(spark, tmp_path):
    """Line numbers, header and byte-order mark are those of a plain reading, however the files are cut."""
    rng = random.Random(2)
    texts = {"a.txt": "\ufeff\r\n\nKeyword,Volume\r\n" + "".join(rng.choice(["", "  ", "word %d, 3" % i, '"a, ""b"" %d";x' % i, "запит"]) + rng.choice(["\n", "\r\n"]) for i in range(300)),
             "b.txt": "keyword\nquery\n\nlast without an end", "c.txt": "", "d.txt": "\n" * 200 + "ключ\nx", "e.txt": "one\nkeyword"}
    want = set()
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
        first = True
        for i, line in enumerate(text.removeprefix("\ufeff").split("\n")):
            if line.strip():
                field = next(csv.reader([line.strip().replace(";", ",")]))[0].strip()
                if not (first and field.lower() in ("keyword", "query", "term", "ключ", "запит")):
                    want.add((name, i, field))
                first = False
    for size in ("64", "134217728"):
        held = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = readers.read_keyword_lists(spark, str(tmp_path)).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", held)
        assert {(r.analysis_id.rsplit("/", 1)[1], r.line_no, r.raw) for r in got} == want and len(got) == len(want)


def test_search_rows(spark):
    rows = [("s", ["q", "p"], 1.0, None, 0.5, 2.0), ("s", ["q"], 1.0, 1.0, 1.0, 1.0), ("s", None, 1.0, 1.0, 1.0, 1.0)]
    got = readers.search_rows(spark.createDataFrame(rows, schemas.SEARCH_API)).collect()
    assert [(r.query, r.page, r.impressions) for r in got] == [("q", "p", 0.0)]


def test_csv_and_reports(spark, tmp_path):
    cols = "audit_id int, seq int, rule_no int, code string, severity string, title string, recommendation string, description string, url string, evidence string"
    issues = spark.createDataFrame([(1, 0, 0, "a", "high", 'T "x"', "R, r", "D", "https://e.com/", "l1\nl2"),
                                    (1, 1, 0, "b", "low", "U", "S", "E", None, None)], cols)
    fresh = spark.createDataFrame([(1, "a", "https://e.com/")], "audit_id int, code string, url string")
    lines = writers.issues_csv(issues, fresh)
    want = ['new,high,a,"T ""x""",https://e.com/,l1 l2,"R, r"', "existing,low,b,U,,,S"]
    assert [r.value for r in lines.orderBy("seq").collect()] == want
    out = str(tmp_path / "csv")
    writers.write_lines(lines, out, ["audit_id"], ["seq", "rule_no"], writers.ISSUE_COLUMNS)
    text = [r.value for r in spark.read.text(out).collect()]
    assert [x for x in text if not x.startswith("status,")] == want and ",".join(writers.ISSUE_COLUMNS) in text
    parts = scoring.grouped_issue_parts(issues)
    groups = scoring.group_issues(parts)
    header = spark.createDataFrame([(1, "https://e.com/", 2, 90, 2)], "audit_id int, root_url string, pages_scanned int, score int, issue_count int")
    pieces = writers.audit_report_pieces(header, groups, writers.evidence_pieces(scoring.evidence_chunks(parts)))
    report = json.loads("".join(r.value for r in pieces.orderBy(*writers.PIECE_ORDER).collect()))
    assert [i["code"] for i in report["issues"]] == ["a", "b"] and report["issues"][0]["evidence"] == "l1\nl2" and report["score"] == 90
    html = writers.audit_html(header, groups).first().value
    assert "T &quot;x&quot;" in html and "Site-wide" in html


def test_reports_hold_all_evidence_and_are_read_by_id(spark, tmp_path):
    rows = []
    for audit, n in ((1, 40), (2, 3), (3, 0)):
        for i in range(n):
            rows.append((audit, i, f"https://e.com/{i}", ["Same, title", 'Other "title"', f"T{i}"][i % 3], "shared text" if i % 2 else "", i))
    pages = spark.createDataFrame(rows, "audit_id int, seq long, url string, title string, description string, n int")
    base = findings.duplicate_issues(pages, "title").unionByName(findings.duplicate_issues(pages, "description"))
    single = pages.select("audit_id", "seq", F.lit(4).alias("rule_no"), F.lit("thin").alias("code"), F.lit("low").alias("severity"), F.lit("Thin").alias("title"),
                          F.lit("D").alias("description"), F.lit("Fix").alias("recommendation"), "url", F.concat(F.lit("words\n"), "n").alias("evidence"),
                          F.lit(None).cast("long").alias("n_affected"))
    issues = base.unionByName(single)
    parts = scoring.grouped_issue_parts(issues)
    header = pages.groupBy("audit_id").agg(F.count("*").alias("pages_scanned"))
    duplicates = findings.duplicate_evidence(pages, block=8)
    chunks = scoring.evidence_chunks(parts, width=16)
    pieces = writers.audit_report_pieces(header, scoring.group_issues(parts), writers.evidence_pieces(chunks, duplicates))
    writers.write_audit_reports(pieces, str(tmp_path / "reports"))
    assert len(list((tmp_path / "reports").glob("bucket=*"))) <= 2
    for audit, n in ((1, 40), (2, 3)):
        read = writers.read_document(spark, str(tmp_path / "reports"), "audit_id", audit).orderBy(*writers.PIECE_ORDER)
        report = json.loads("".join(r.value for r in read.collect()))
        found = {i["code"]: i["evidence"] for i in report["issues"]}
        own = [r for r in rows if r[0] == audit]
        groups = {}
        for r in own:
            groups.setdefault(r[3].lower(), []).append(r[2])
        assert found.get("duplicate-title", "") == "\n\n".join("\n".join([v, *urls]) for v, urls in groups.items() if len(urls) > 1)
        assert all(f"words\n{r[5]}" in found["thin"] and r[2] in found["thin"] for r in own) and report["pages_scanned"] == n
    read = writers.read_document(spark, str(tmp_path / "reports"), "audit_id", 9)
    assert read.count() == 0
    lines = writers.issues_csv_pieces(issues, spark.createDataFrame([], "audit_id int, code string, url string"), duplicates)
    texts = {}
    for r in lines.orderBy("audit_id", "seq", "rule_no", "kind", "a", "b").collect():
        texts[r.audit_id, r.seq, r.rule_no] = texts.get((r.audit_id, r.seq, r.rule_no), "") + r.value
    parsed = [x for t in texts.values() for x in csv.reader([t])]
    assert all(len(x) == 7 for x in parsed) and len(parsed) == issues.count()
    cell = next(x for k, t in texts.items() for x in csv.reader([t]) if k[0] == 1 and x[2] == "duplicate-title")[5]
    assert cell.startswith('same, title https://e.com/0 https://e.com/3') and 'other "title" https://e.com/1 ' in cell


def test_briefs_are_read_by_id(spark, tmp_path):
    rows = spark.createDataFrame([(f"b{i}", f"# Brief {i}\n\ntext\n") for i in range(200)], "brief_id string, value string")
    writers.write_documents(rows, str(tmp_path / "briefs"), "brief_id", buckets=4)
    assert len(list((tmp_path / "briefs").glob("bucket=*"))) == 4
    assert [r.value for r in writers.read_document(spark, str(tmp_path / "briefs"), "brief_id", "b17", buckets=4).collect()] == ["# Brief 17\n\ntext\n"]


def test_merge_upsert(spark):
    base = spark.createDataFrame([("u", 5, None, "a", 1)], "k string, n int, first string, keep string, last int")
    new = spark.createDataFrame([("u", 2, "x", None, 2, 1), ("u", 1, "y", "b", 3, 2), ("v", 1, None, None, 9, 1)],
                                "k string, n int, first string, keep string, last int, at int")
    out = upsert.merge_upsert(base, new, ["k"], {"n": "add", "first": "first", "keep": "keep", "last": "overwrite"}, "at")
    assert {tuple(r) for r in out.collect()} == {("u", 8, "x", "b", 3), ("v", 1, None, None, 9)}


def in_files(spark, path, schema, *files):
    """A stream that takes one list of rows a batch, in this order."""
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def drained(spark, result, path, mode):
    """The rows of every batch with its number, and the rows that are left in the state."""
    written = streams.BatchTable(spark, f"{path}/out", result.schema)
    query = (result.writeStream.outputMode(mode).foreachBatch(written.replace).option("checkpointLocation", f"{path}/cp")
             .trigger(availableNow=True).start())
    assert query.awaitTermination(200)
    return written.read(), query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]


USAGE = "event_id long, owner_key string, metric string, amount int, ts timestamp"


def test_quota_stream_equals_batch_in_any_file_order(spark, tmp_path):
    at = lambda i: dt.datetime(2024, 1, 30) + dt.timedelta(minutes=7 * i)
    rows = [(i, f"u{i % 2}", "audit_jobs", 1 + i % 4, at(i)) for i in range(500)]  # 58 hours, over the end of a month
    rows += [(500 + i, "u0", "audit_jobs", 2, at(40)) for i in range(5)]  # ties
    limits = {"audit_jobs": 137}
    want = {r.event_id: r.admitted for r in usage.usage_quota(spark.createDataFrame(rows, USAGE), limits).collect()}
    assert {True, False} == set(want.values())
    tick = [(None, None, None, None, at(900))]
    for k, seed in enumerate((1, 2)):
        rng = random.Random(seed)
        shaken = sorted(rows, key=lambda r: (r[4].timestamp() + rng.randint(0, 3000), rng.random()))
        late = [(9000 + i, "u1", "audit_jobs", 1, at(i)) for i in range(3)] + [(9100, "u1", "audit_jobs", 1, None)]
        files = [shaken[i:i + 170] for i in range(0, len(shaken), 170)]
        events = in_files(spark, tmp_path / str(k), USAGE, *files[:-1], files[-1] + late, tick)
        out, state = drained(spark, streams.usage_quota_stream(events, limits), tmp_path / str(k), "append")
        got = {r.event_id: (r.admitted, r.late) for r in out.collect()}
        assert out.count() == len(got) == len(rows) + len(late)
        assert {i: v for i, (v, late) in got.items() if not late} == want
        assert {i for i, (v, late) in got.items() if late and v is None} == {r[0] for r in late}
        assert state < 10  # nothing waits any more; sums of the second month are left


def test_rate_stream_counts_late_calls_aside(spark, tmp_path):
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    first = [(i, "hot", at(1, i % 60)) for i in range(200)] + [(300, "cold", at(2))]
    second = [(400, "hot", at(1, 30)), (401, "cold", at(6))]  # the first hour is still open
    third = [(500, "hot", at(1, 5)), (501, "hot", at(1, 6)), (502, "cold", at(6, 10)), (503, None, at(20))]
    events = in_files(spark, tmp_path, "event_id long, owner_key string, ts timestamp", first, second, third)
    written, _ = drained(spark, streams.rate_limit_stream(events, "owner_key"), tmp_path, "update")
    got = {(r.owner_key, r.window_start): (r["count"], r.allowed, r.late_count) for r in streams.rate_windows(written, "owner_key", 20).collect()}
    assert got == {("hot", at(1)): (201, 20, 2), ("cold", at(2)): (1, 1, 0), ("cold", at(6)): (2, 2, 0)}
    assert written.select("share").distinct().count() > 4


JOBS = "job_id long, seq long, status string, attempts int, ts timestamp"


def test_job_state_stream_folds_times_out_and_forgets(spark, tmp_path):
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    first = [(1, 1, "queued", 0, at(1)), (1, 3, "completed", 1, at(1, 9)), (2, 4, "queued", 0, at(1, 10)), (3, 5, "running", 1, at(1, 20))]
    second = [(1, 2, "running", 1, at(1, 5)), (4, 6, "running", 2, at(8))]  # an older event in time; job 3 falls silent
    third = [(3, 2, "running", 0, at(1, 15)), (5, 8, "failed", 3, at(9))]
    fourth = [(3, 7, "queued", 1, at(9, 30)), (None, None, None, None, at(11))]  # tried again
    events = in_files(spark, tmp_path, JOBS, first, second, third, fourth)
    written, state = drained(spark, streams.job_state_stream(events), tmp_path, "update")
    got = {r.job_id: (r.status, r.attempts, r.updated_at, r.error) for r in streams.latest_jobs(written).collect()}
    assert got == {1: ("completed", 1, at(1, 9), None), 2: ("queued", 0, at(1, 10), None), 3: ("queued", 1, at(9, 30), None),
                   4: ("failed", 2, at(8), K.STALE_MESSAGE), 5: ("failed", 3, at(9), None)}
    failed = [r.seq for r in written.filter("error is not null").orderBy("batch").collect()]
    assert failed == [5, 6]
    assert state < 10  # jobs 2 and 3 are left, with their timers
    plain = spark.createDataFrame([r for r in [*first, *second, *third, *fourth] if r[0]], JOBS)
    now = F.lit(at(10))
    want = {r.job_id: r.status for r in jobs.recover_stale(jobs.job_state(plain), now).collect()}
    assert {i: v[0] for i, v in got.items()} == want


def test_a_late_event_does_not_bring_a_finished_job_back(spark, tmp_path):
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    events = in_files(spark, tmp_path, JOBS, [(1, 2, "completed", 1, at(1)), (2, 3, "queued", 0, at(5))], [(2, 4, "running", 1, at(7))],
                      [(1, 1, "running", 1, at(0, 50))])
    written, _ = drained(spark, streams.job_state_stream(events), tmp_path, "update")
    assert {r.job_id: r.status for r in streams.latest_jobs(written).collect()}[1] == "completed"
    assert [(r.job_id, r.seq) for r in written.filter("late").collect()] == [(1, 1)]


def test_alerts_are_written_once(spark, tmp_path):
    audits = spark.createDataFrame([(1, 7, 3, "r", 90, dt.datetime(2024, 1, 1), 5, None, None), (2, 7, 3, "r", 70, dt.datetime(2024, 1, 2), 5, None, None),
                                    (3, 7, 3, "r", 60, dt.datetime(2024, 1, 3), 0, None, None)],
                                   "audit_id int, owner int, project_id int, root_url string, score int, created_at timestamp, pages_scanned int, "
                                   "stopped_reason string, previous_status string")
    issues = spark.createDataFrame([(2, 1, "x", "critical", "Down", "https://e.com/", None)],
                                   "audit_id int, seq int, code string, severity string, title string, url string, evidence string")
    done = streams.BatchTable(spark, str(tmp_path / "done"), "audit_id int")
    alerts = streams.BatchTable(spark, str(tmp_path / "alerts"), "audit_id int, severity string, kind string, title string, message string")
    run = streams.audit_alert_batch(lambda: (audits, issues), done, alerts)
    rows = lambda: sorted((r.audit_id, r.kind, r.batch) for r in alerts.read().collect())
    run(audits.filter("audit_id = 2"), 0)
    first = [(2, "new_critical", 0), (2, "score_drop", 0)]
    assert rows() == first
    run(audits.filter("audit_id = 2"), 0)  # the batch runs again
    assert rows() == first
    run(audits.filter("audit_id > 1"), 1)  # an audit is delivered again with a new one
    second = first + [(3, "crawl_problem", 1), (3, "score_drop", 1)]
    assert rows() == second
    run(audits.filter("audit_id > 1"), 1)
    run(audits.limit(0), 2)
    assert rows() == second


def test_pairs_of_an_alert_batch_are_worked_out_once(spark, tmp_path, monkeypatch):
    audits = spark.createDataFrame([(i, 7, 3, "r", 90 - i, dt.datetime(2024, 1, i), 5, None, None) for i in (1, 2)],
                                   "audit_id int, owner int, project_id int, root_url string, score int, created_at timestamp, pages_scanned int, "
                                   "stopped_reason string, previous_status string")
    issues = spark.createDataFrame([], "audit_id int, seq int, code string, severity string, title string, url string, evidence string")
    done = streams.BatchTable(spark, str(tmp_path / "done"), "audit_id int")
    alerts = streams.BatchTable(spark, str(tmp_path / "alerts"), "audit_id int, severity string, kind string, title string, message string")
    plans, plain = [], monitoring.monitoring_alerts
    monkeypatch.setattr(monitoring, "monitoring_alerts", lambda pairs, diff: plans.append(
        pairs._jdf.queryExecution().optimizedPlan().toString()) or plain(pairs, diff))
    streams.audit_alert_batch(lambda: (audits, issues), done, alerts)(audits, 0)
    assert len(plans) == 1 and "Join" not in plans[0]


def test_history_lists(spark):
    rows = [(i, i % 2, dt.datetime(2024, 1, 1 + i)) for i in range(10)]
    df = spark.createDataFrame(rows, "id int, owner int, created_at timestamp")
    assert {r.id for r in history.latest_n(df, "owner", 2).collect()} == {9, 8, 7, 6}
    owned = spark.createDataFrame([(0, 1), (1, 2)], "owner int, project_id int")
    assert history.owned_by(owned, spark.createDataFrame([(0, 1)], "owner int, project_id int")).count() == 1
    alerts = spark.createDataFrame([(1, None), (1, dt.datetime(2024, 1, 1))], "owner int, read_at timestamp")
    assert monitoring.unread_alerts(alerts).first().unread == 1


def test_many_small_keys_share_groups_of_the_state(spark, tmp_path):
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    n = 1500
    events = in_files(spark, tmp_path / "r", "event_id long, owner_key string, ts timestamp", [(i, f"u{i}", at(1, i % 60)) for i in range(n)])
    written, state = drained(spark, streams.rate_limit_stream(events, "owner_key"), tmp_path / "r", "update")
    assert written.count() == n and state <= 100  # one value and a timer a share
    usage_rows = [(i, f"u{i % 700}", "audit_jobs", 1, at(1, i % 60)) for i in range(n)]
    events = in_files(spark, tmp_path / "q", USAGE, usage_rows, [(None, None, None, None, at(9))])
    written, state = drained(spark, streams.usage_quota_stream(events, {"audit_jobs": 2}, buckets=16), tmp_path / "q", "append")
    want = {r.event_id: r.admitted for r in usage.usage_quota(spark.createDataFrame(usage_rows, USAGE), {"audit_jobs": 2}).collect()}
    assert {r.event_id: r.admitted for r in written.collect()} == want and state <= 100
    events = in_files(spark, tmp_path / "j", JOBS, [(i, i, "queued", 0, at(1)) for i in range(n)], [(i, n + i, "running", 1, at(2)) for i in range(0, n, 2)],
                      [(None, None, None, None, at(9))])
    written, state = drained(spark, streams.job_state_stream(events, buckets=16), tmp_path / "j", "update")
    got = {r.job_id: r.status for r in streams.latest_jobs(written).collect()}
    assert got == {i: "queued" if i % 2 else "failed" for i in range(n)} and state <= 100


def test_an_issue_with_a_url_is_counted_in_one_row(spark):
    rows = [(1, 5, 0, "a", "low", "T", "R", "https://e.com/1", None, "first"), (1, 6, 0, "a", "low", "T", "R", "https://e.com/1", " x ", "second"),
            (1, 4, 0, "a", "low", "T", "R", None, "x", "earliest"), (1, 7, 0, "a", "low", "T", "R", "https://e.com/2", "", "last")]
    issues = spark.createDataFrame(rows, "audit_id int, seq int, rule_no int, code string, severity string, title string, recommendation string, url string, "
                                   "evidence string, description string")
    parts = scoring.grouped_issue_parts(issues)
    assert {(r.kind, r.value, r.n) for r in parts.collect()} == {("u", "https://e.com/1", 2), ("u", "https://e.com/2", 1), ("g", "", 1), ("e", "x", 2)}
    g = scoring.group_issues(parts).first()
    assert (g.n_issues, g.n_urls, g.n_evidence, g.url, g.description) == (4, 2, 1, "https://e.com/1", "2 crawled pages are affected. earliest")


def test_an_issue_group_holds_its_whole_evidence(spark):
    rows = [(1, 9000, 0, "a", "https://e.com/2", "second"), (1, 5, 0, "a", "https://e.com/9", " first\nline "), (1, 20000, 0, "a", "https://e.com/2", "first\nline"),
            (1, 20001, 0, "a", None, None), (1, 3, 0, "b", "https://e.com/1", ""), (1, 4, 0, "c", None, "alone")]
    issues = spark.createDataFrame(rows, "audit_id int, seq int, rule_no int, code string, url string, evidence string").select(
        "*", *[F.lit(x).alias(x) for x in ("severity", "title", "recommendation", "description")])
    got = {r.code: r.evidence for r in scoring.group_issues(scoring.grouped_issue_parts(issues)).collect()}
    assert got == {"a": "first\nline\n\nsecond\n\nAffected URLs:\nhttps://e.com/9\nhttps://e.com/2", "b": None, "c": "alone"}
