"""Skew-safe forms against straightforward loops on small inputs."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import Window as W, functions as F

from siteloom.functions.urls import normalize_link_url
from siteloom.operators import findings, links, semantic, skew, usage
from siteloom.operators.similarity import dealt_entries, prefix_entries, similar_pairs
from siteloom.plans.crawl import Levels, crawl_order


def test_bucketed_forms_equal_plain_windows(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([None, "a", "a", "b"]), i, rnd.randrange(60), rnd.randrange(9)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, id int, t int, v int")
    w = W.partitionBy("k").orderBy("t", "id")
    plain = df.select("id", F.row_number().over(w).alias("r"), F.lag("v").over(w).alias("p"),
                      F.sum("v").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("s"))
    bucket = F.floor(F.col("t") / 7)
    ours = skew.bucketed_rank(df, ["k"], bucket, ["t", "id"], "r")
    ours = skew.bucketed_lag(ours, ["k"], bucket, ["t", "id"], F.col("v"), "p")
    ours = skew.bucketed_sum(ours, ["k"], bucket, ["t", "id"], F.col("v"), "s").select("id", "r", "p", "s")
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, plain.collect()))


def test_first_rows_of_a_hot_key(spark):
    """One key with nine rows in ten: the first k by blocks, for a k beyond any pruning, and no window holds more than a block."""
    df = spark.range(60_000).select((F.col("id") % 10 == 0).cast("int").alias("k"), F.pmod(F.xxhash64("id"), F.lit(50_000)).alias("t"), "id")
    plain = df.withColumn("r", F.row_number().over(W.partitionBy("k").orderBy("t", "id")))
    for k in (1, 2_500, 53_000, 100_000):
        got = skew.first_per_key(df, ["k"], F.floor(F.col("t") / 500), ["t", "id"], k, "r")
        want = plain.filter(F.col("r") <= k)
        assert got.count() == want.count() and got.exceptAll(want).count() == 0
    by_key = skew.first_per_key(df, ["k"], F.floor(F.col("t") / 500), ["t", "id"], F.when(F.col("k") == 0, 7).otherwise(0), "r")
    assert sorted((r.k, r.r) for r in by_key.collect()) == [(0, i) for i in range(1, 8)]


@pytest.mark.parametrize("threshold", [0.3, 0.34, 0.6])
def test_similar_pairs(spark, threshold):
    rnd = random.Random(7)
    sets = [(1, f"i{n:03}", ["hot"] * (n % 3 > 0) + rnd.sample("abcdefghij", rnd.randrange(0, 5))) for n in range(120)]
    df = spark.createDataFrame(sets, "g int, id string, tokens array<string>")
    got = {(r.left, r.right) for r in similar_pairs(df, ["g"], "id", "tokens", threshold).collect()}
    want = {(a, b) for _, a, x in sets for _, b, y in sets if a < b and x and y
            and len(set(x) & set(y)) / len(set(x) | set(y)) >= threshold}
    assert got == want and want


def test_hot_token_is_many_groups(spark):
    """Nine sets in ten share a token and some sets are equal; each pair comes out once, and no group holds the list whole."""
    rnd = random.Random(9)
    sets = [(1, f"i{n:03}", ["hot"] * (n % 10 > 0) + rnd.sample("abcdefghijklmn", rnd.randrange(0, 4))) for n in range(400)]
    sets += [(2, f"i{n:03}", ["hot", "x"]) for n in range(120)] + [(3, "i0", []), (3, "i1", ["x"]), (3, "i2", ["x", "x"])]
    df = spark.createDataFrame(sets, "g int, id string, tokens array<string>")
    want = {(g, a, b) for g, a, x in sets for h, b, y in sets if g == h and a < b and x and y and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.5}
    for block in (16, 2048):
        rows = similar_pairs(df, ["g"], "id", "tokens", 0.5, block=block).collect()
        got = [(r.g, r.left, r.right) for r in rows]
        assert len(got) == len(set(got)) and set(got) == want
    first, second = dealt_entries(prefix_entries(df, ["g"], "id", "tokens", 0.5, []), ["g"], 16)
    on = ["g", "token", "lo", "hi", "i", "j"]
    most = [side.groupBy(*on).count().agg(F.max("count")).first()[0] for side in (first, second)]
    assert max(most) <= 40  # blocks of about 16, by hash
    assert similar_pairs(df.limit(0), ["g"], "id", "tokens", 0.5).count() == 0


def test_quota_walk(spark):
    rnd = random.Random(3)
    limits = {"m": 17, "n": 40}
    rows = [(i, rnd.choice(["u", "v"]), rnd.choice(["m", "n"]), rnd.randrange(1, 9), f"2024-0{rnd.randrange(1, 3)}-{rnd.randrange(10, 28)} 00:00:00")
            for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, owner_key string, metric string, amount int, ts string").withColumn(
        "ts", F.col("ts").cast("timestamp"))
    used, want = defaultdict(int), {}
    for i, owner, metric, amount, ts in sorted(rows, key=lambda r: (r[4], r[0])):
        key = (owner, ts[:7], metric)
        want[i] = used[key] + amount <= limits[metric]
        used[key] += amount if want[i] else 0
    assert {r.event_id: r.admitted for r in usage.usage_quota(df, limits).collect()} == want


@pytest.mark.parametrize("hot_df", [2, 6, 10_000])
def test_link_suggestions(spark, hot_df):
    rnd = random.Random(11)
    words = ["audit", "guide", "price", "shoes", "map", "linen", "tools", "report", "crawler", "budget"]
    pages = []
    for i in range(70):
        topic = " ".join(rnd.sample(words, rnd.randrange(1, 4))) + (" shop" if i % 2 else "")
        pages.append((1, i, "https://e.com/" if i == 0 else f"https://e.com/{'ab'[i % 2]}/{i:02}x", 200, "", topic, [topic], 100 + 20 * (i % 6),
                      rnd.randrange(0, 30), i % 4))
    df = spark.createDataFrame(pages, "audit_id int, seq long, url string, status int, robots string, title string, h1s array<string>, "
                                      "word_count int, n_links int, incoming_links int")
    edges = [(1, pages[rnd.randrange(70)][2], pages[rnd.randrange(70)][2]) for _ in range(150)]
    edges += [(1, p[2], pages[4][2]) for p in pages[:40]]  # one target with many exclusions
    graph = spark.createDataFrame(edges, "audit_id int, src string, dst string")
    roots = findings.audit_roots(df.select("audit_id", "seq", "url"))
    found, skipped = links.internal_links(df, roots, graph, hot_df=hot_df)
    tokens = {r.seq: list(r.tokens) for r in links.page_profile(df).collect()}
    linked = {(s.rstrip("/") if s != "https://e.com/" else s, t) for _, s, t in edges}
    want, idle = [], []
    for t in sorted((p for p in pages if p[1] != 0 and p[9] < 3), key=lambda p: (p[9], -p[7], p[1])):
        options = []
        for s in pages:
            if s[1] == t[1] or (s[2], t[2]) in linked:
                continue
            shared = len([x for x in tokens[t[1]] if x in tokens[s[1]]])
            if not shared:
                continue
            near = s[2].count("/") == 4 and t[2].count("/") == 4 and s[2].split("/")[3] == t[2].split("/")[3]
            score = int(shared / len(tokens[t[1]]) * 72 + 0.5) + 12 * near + 8 * (s[7] >= 150) + 5 * (s[8] < 20)
            if min(100, score) >= 28:
                options.append((-min(100, score), s[2]))
        best = sorted(options)[:3 if t[9] == 0 else 2]
        want += [(url, t[2], -score) for score, url in best]
        if not best:
            idle.append(t[2])
    got = [(r.source_url, r.target_url, r.score) for r in found.orderBy("position").collect()]
    assert got == want
    assert sorted(r.target_url for r in skipped.collect()) == sorted(idle)


@pytest.mark.parametrize("hot_df", [2, 4, 10_000])
def test_link_suggestions_with_query_variants(spark, hot_df):
    """Variants of linking URLs and of the target itself don't use up a class's offers."""
    topic = "audit guide"
    urls = ["https://e.com/"] + [f"https://e.com/t{i}?v={v}" for i in range(3) for v in range(4)] + [f"https://e.com/s{i}?v={v}" for i in range(6) for v in range(5)]
    pages = [(1, i, u, 200, "", topic, [topic], 200, 3, 0) for i, u in enumerate(urls)]
    df = spark.createDataFrame(pages, "audit_id int, seq long, url string, status int, robots string, title string, h1s array<string>, "
                                      "word_count int, n_links int, incoming_links int")
    norm = dict(spark.createDataFrame(list(enumerate(urls)), "i int, u string").select("u", normalize_link_url(F.col("u"))).collect())
    edges = [(1, f"https://e.com/s{i}?v=0", f"https://e.com/t{t}?v=0") for t in range(3) for i in range(t + 3)]
    graph = spark.createDataFrame(edges, "audit_id int, src string, dst string")
    found, _ = links.internal_links(df, findings.audit_roots(df), graph, hot_df=hot_df)
    barred = {(norm[s], norm[d]) for _, s, d in edges}
    want = {(s, t) for t in urls[1:] for s in sorted(s for s in urls if norm[s] != norm[t] and (norm[s], norm[t]) not in barred)[:3]}
    assert {(r.source_url, r.target_url) for r in found.collect()} == want


def test_semantic_blocks(spark):
    """Any block size gives the sources of a plain loop; more than a hundred pages."""
    rnd = random.Random(4)
    n = 130
    rows = [(1, i, f"https://e.com/p{i:03}", 200, "", f"w{i}", [f"w{i}"], 100 + i, 3, rnd.randrange(0, 3), f"a{i}") for i in range(n)]
    df = spark.createDataFrame(rows, "audit_id int, seq long, url string, status int, robots string, title string, h1s array<string>, "
                                     "word_count int, n_links int, incoming_links int, anchor_text string")
    vectors = {i: [rnd.random() ** 3 for _ in range(4)] for i in range(n)}
    roots = findings.audit_roots(df)
    graph = spark.createDataFrame([(1, rows[rnd.randrange(n)][2], rows[rnd.randrange(n)][2]) for _ in range(200)], "audit_id int, src string, dst string")
    linked = {(r.src, r.dst) for r in graph.collect()}
    none = spark.createDataFrame([], "audit_id int, source_id long, target_id long, source_url string, target_url string, anchor_text string, score int, "
                                     "confidence string, reasons array<string>, status string")
    want = set()
    for t in rows[1:]:
        if t[9] <= 1:
            a = np.array(vectors[t[1]])
            scored = sorted((-int(np.floor(a @ np.array(vectors[s[1]]) / np.linalg.norm(a) / np.linalg.norm(vectors[s[1]]) * 100 + 0.5)), s[1]) for s in rows
                            if s[1] != t[1] and (s[2], t[2]) not in linked)
            want |= {(s, t[1]) for v, s in scored[:3 if t[9] == 0 else 2] if -v >= 48}
    side = spark.createDataFrame([(1, i, v) for i, v in vectors.items()], "audit_id int, seq long, vector array<double>")
    skipped = spark.createDataFrame([], "audit_id int, target_url string")
    for block in (16, 1024):
        out, _ = semantic.semantic_links(none, skipped, df, roots, graph, side, block=block)
        assert {(r.source_id, r.target_id) for r in out.collect()} == want


def test_best_sources_of_a_block():
    """Three sources a target, equal scores by seq; neither a variant of its own URL nor a page that links already."""
    import pandas as pd
    rnd = random.Random(6)
    pages = [(i, f"u{i // 2}", [rnd.choice([0.0, 1.0, 2.0]) for _ in range(3 if i % 9 else 2)]) for i in range(60)]
    taken = {i: [f"u{rnd.randrange(30)}" for _ in range(rnd.randrange(3))] for i in range(20)}
    rows = [(1, i, u, v, [], False) for i, u, v in pages] + [(1, i, u, v, taken[i], True) for i, u, v in pages[:20]]
    rnd.shuffle(rows)
    got = semantic._best_sources((1,), pd.DataFrame(rows, columns=["audit_id", "seq", "norm", "vector", "taken", "is_target"]))
    want = set()
    for i, u, v in pages[:20]:
        scored = []
        for j, w, x in pages:
            size = np.linalg.norm(v) * np.linalg.norm(x)
            score = int(np.floor(np.dot(v, x) / size * 100 + 0.5)) if len(v) == len(x) and size else 0
            if score >= semantic.MIN_SIMILARITY and w != u and w not in taken[i]:
                scored.append((-score, j))
        want |= {(i, j, -s) for s, j in sorted(scored)[:3]}
    assert {(r.target_id, r.source_id, r.semantic) for r in got.itertuples()} == want and len(got) == len(want)


def test_spread_holds_after_a_join_on_the_same_keys(spark):
    """Costly rows stay on all cores where Spark would read a few small partitions in one task."""
    left, right = (spark.range(4000).select((F.col("id") % 3).alias("audit_id"), F.col("id").alias("seq")).hint("merge") for _ in range(2))
    rows = skew.spread(left.join(right, ["audit_id", "seq"]), "audit_id", "seq")
    assert rows.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert rows.count() == 4000


def test_far_blocks_of_vectors_are_skipped(spark):
    """On clustered vectors most block pairs fall away, and none that holds an accepted cosine does."""
    rng = np.random.default_rng(8)
    centres = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    rows = {i: (centres[i % 9] + rng.normal(scale=0.03, size=12)).tolist() for i in range(700)}
    rows |= {i: [0.0] * 12 for i in range(700, 705)} | {i: rng.normal(size=5).tolist() for i in range(705, 720)}
    df = spark.createDataFrame([(1, i, v) for i, v in rows.items()] + [(2, 1, [1.0, 0.0]), (2, 2, [0.9, 0.1])], "audit_id int, seq long, vector array<double>")
    weak = df.filter("seq % 3 = 0 or audit_id = 2").select("audit_id", "seq")
    cells, between = semantic.vector_blocks(df, 24)
    placed = {(r.audit_id, r.seq): (r.cell, r.part) for r in cells.collect()}
    assert len(placed) == cells.count() == len(rows) + 2
    pairs = {(r.audit_id, tuple(r.i), tuple(r.j)) for r in semantic.block_pairs(cells, between, weak).collect()}
    blocks = len({v for (a, _), v in placed.items() if a == 1})
    aimed = len({v for (a, i), v in placed.items() if a == 1 and i % 3 == 0})
    share = len([p for p in pairs if p[0] == 1]) / (blocks * aimed)
    assert blocks > 15 and share < 0.5, share
    unit = {i: np.array(v) / max(np.linalg.norm(v), 1e-12) for i, v in rows.items()}
    for t in range(0, 720, 3):
        for i in rows:
            if len(rows[t]) == len(rows[i]) and unit[t] @ unit[i] >= 0.475:
                assert (1, placed[1, t], placed[1, i]) in pairs
    assert (2, placed[2, 1], placed[2, 2]) in pairs


def test_suggestion_budget(spark):
    rows = [(1, i, f"https://e.com/{i:02}", 200, "", "same words", ["same words"], 200, 1, 0) for i in range(20)]
    df = spark.createDataFrame(rows, "audit_id int, seq long, url string, status int, robots string, title string, h1s array<string>, "
                                     "word_count int, n_links int, incoming_links int")
    graph = spark.createDataFrame([(1, "https://e.com/none", "https://e.com/other")], "audit_id int, src string, dst string")
    found, skipped = links.internal_links(df, findings.audit_roots(df), graph, budget=7)
    got = [(r.target_id, r.position) for r in found.orderBy("position").collect()]
    assert got == [(1, 1), (1, 2), (1, 3), (2, 4), (2, 5), (2, 6), (3, 7)] and skipped.count() == 0


def test_crawl_limits(spark):
    roots = spark.createDataFrame([(1, "https://e.com/")], "audit_id int, root_url string")
    urls = ["https://e.com/"] + [f"https://e.com/p?q={i}" for i in range(8)] + ["https://e.com/a", "https://e.com/b", "https://e.com/c"]
    edges = [(1, "https://e.com/", u, n) for n, u in enumerate(urls[1:])] + [(1, "https://e.com/a", "https://e.com/p?q=9", 0)]
    captures = [(1, u, "https://e.com/a" if u.endswith("/b") else u, not u.endswith("/c"), not u.endswith("q=1")) for u in urls]
    graph = spark.createDataFrame(edges, "audit_id int, src string, dst string, position int")
    caps = spark.createDataFrame(captures, "audit_id int, url string, final_url string, is_html boolean, allowed boolean")
    visited, stopped = crawl_order(roots, graph, caps, max_pages=25)
    order = [r.url for r in visited.filter("audited").orderBy("seq").collect()]
    assert {r.url for r in visited.filter("not audited").collect()} == {"https://e.com/p?q=1", "https://e.com/b"}
    # q=5.. exceed five variants, q=1 is blocked, /b lands on /a
    assert order == ["https://e.com/"] + [f"https://e.com/p?q={i}" for i in (0, 2, 3, 4)] + ["https://e.com/a", "https://e.com/c"]
    assert stopped.count() == 0
    visited, stopped = crawl_order(roots, graph, caps, max_pages=3)
    assert [r.url for r in visited.filter("audited").orderBy("seq").collect()] == order[:3] and stopped.count() == 1


@pytest.mark.parametrize("pairs_per_entry", [0, 64])
def test_leader_clusters(spark, monkeypatch, pairs_per_entry):
    from siteloom.operators import keywords as kw, leaders
    rnd = random.Random(13)
    vocab = ["seo", "audit", "tool", "price", "kyiv", "shoes", "run", "map", "art", "linen"]
    texts = list(dict.fromkeys(" ".join(rnd.choices(vocab, k=rnd.randrange(1, 6))) for _ in range(140)))
    raw = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "analysis_id int, line_no int, raw string")
    items = kw.distinct_keywords(raw)
    if pairs_per_entry == 0:  # head rounds until nothing is left to pair
        load = leaders._pair_load
        monkeypatch.setattr(leaders, "_pair_load", lambda e: (0, 0) if load(e)[0] < 150 else (1e12, 1))
    got = {r.normalized: r.leader for r in leaders.keyword_clusters(items, max(1, pairs_per_entry)).collect()}
    rows = sorted(items.collect(), key=lambda r: (-r.n_tokens, r.keyword))
    want, heads = {}, []
    for r in rows:
        best = None
        for h in heads:
            a, b = set(r.tokens), set(h.tokens)
            score = len(a & b) / len(a | b) if a and b else 0
            inside = f" {r.normalized} " in f" {h.normalized} " or f" {h.normalized} " in f" {r.normalized} "
            if (score >= 0.34 or (score >= 0.2 and inside)) and (best is None or score > best[0]):
                best = (score, h.normalized)
        if best is None:
            heads.append(r)
        want[r.normalized] = best[1] if best else r.normalized
    assert got == want


def test_crawl_state_is_one_scan_of_few_folders(spark):
    levels = Levels(spark, width=3)
    for depth in range(20):
        written = levels.add(spark.createDataFrame([(depth, f"u{depth}")], "depth int, url string"))
        assert [tuple(r) for r in written.collect()] == [(depth, f"u{depth}")]
        assert len(levels.folders) <= 6
    assert sorted(tuple(r) for r in levels.all().collect()) == [(i, f"u{i}") for i in range(20)]
    assert "Union" not in levels.all()._jdf.queryExecution().toString()


CRAWL = "audit_id int, src string, dst string, position int"


def crawled(frames, **kw):
    visited, stopped = crawl_order(*frames, **kw)
    return (sorted((tuple(r) for r in visited.collect()), key=repr), sorted(r.audit_id for r in stopped.collect()))


@pytest.mark.parametrize("linked_by,max_pages", [("final_url", 1 << 30), ("url", 12)])
def test_small_audits_walk_as_the_rounds_do(spark, linked_by, max_pages):
    rnd = random.Random(5)
    urls = {a: [f"https://e{a}.com/"] + [f"https://e{a}.com/p{i % 9}" + (f"?q={i}" if i % 3 == 0 and a != 2 else f"/{i}") for i in range(1, 40)] for a in (1, 2, 3)}
    edges = [(a, rnd.choice(us), rnd.choice([*us, None]), n) for a, us in urls.items() for n in range(130)]
    odd = [True] * 12 + [False, None]
    landings = [(a, u, rnd.choice(us) if rnd.random() < 0.15 else u, rnd.choice(odd), rnd.choice(odd))
                for a, us in urls.items() for u in us if u == us[0] or rnd.random() < 0.95] + [(1, None, "https://e1.com/x", True, True)]
    # captures and links that come twice, and one whose final URL is not known
    landings += landings[3:9] + [(3, urls[3][5], None, True, True)]
    roots = spark.createDataFrame([(a, us[0]) for a, us in urls.items()] + [(None, "https://e.com/"), (4, "https://e4.com/"), (5, None)], "audit_id int, root_url string")
    graph = spark.createDataFrame(edges + edges[:20], CRAWL)
    caps = spark.createDataFrame(landings, "audit_id int, url string, final_url string, is_html boolean, allowed boolean")
    seeds = spark.createDataFrame([(1, urls[1][7], 0), (1, urls[1][30], None), (3, "https://e3.com/p3?q=99", 1)], "audit_id int, url string, position int")
    frames = (roots, graph, caps)
    want = crawled(frames, max_pages=max_pages, seeds=seeds, linked_by=linked_by, local_rows=0)
    assert crawled(frames, max_pages=max_pages, seeds=seeds, linked_by=linked_by) == want and len(want[0]) > 40
    # the largest audits by rounds, the others in a task
    assert linked_by == "final_url" or crawled(frames, max_pages=max_pages, seeds=seeds, linked_by=linked_by, local_rows=175) == want


def test_a_deep_audit_takes_no_round_a_level(spark, monkeypatch):
    from siteloom.plans import crawl
    staged = []
    keep = crawl.stage
    monkeypatch.setattr(crawl, "stage", lambda df: staged.append(1) or keep(df))
    depth = 500
    roots = spark.createDataFrame([(1, "https://e.com/0")], "audit_id int, root_url string")
    graph = spark.createDataFrame([(1, f"https://e.com/{i}", f"https://e.com/{i + 1}", 0) for i in range(depth)], CRAWL)
    caps = spark.createDataFrame([(1, f"https://e.com/{i}", f"https://e.com/{i}", True, True) for i in range(depth + 1)],
                                 "audit_id int, url string, final_url string, is_html boolean, allowed boolean")
    visited, stopped = crawl_order(roots, graph, caps, max_pages=1 << 30)
    assert [(r.url, r.depth) for r in visited.orderBy("seq").collect()] == [(f"https://e.com/{i}", i) for i in range(depth + 1)]
    assert stopped.count() == 0 and len(staged) <= 4


def test_link_candidates_in_blocks(spark):
    """Any block size gives the same sources; no pair of pages that share a token becomes a row of a shuffle."""
    rnd = random.Random(21)
    words = [f"w{i}" for i in range(12)]
    pages = [(a, i, f"https://e{a}.com/" if i == 0 else f"https://e{a}.com/{'ab'[i % 2]}/x{i}" + ("?v=1" if i % 7 == 0 else ""), 200, "", topic, [topic], 100 + 9 * (i % 13),
              rnd.randrange(0, 30), i % 4) for a in (1, 2) for i in range(90) for topic in [" ".join(["the", "same"] + rnd.sample(words, rnd.randrange(0, 5)))]]
    pages += pages[5:9]  # pages that come twice
    df = spark.createDataFrame(pages, "audit_id int, seq long, url string, status int, robots string, title string, h1s array<string>, "
                                      "word_count int, n_links int, incoming_links int")
    edges = [(rnd.choice((1, 2)), rnd.choice(pages)[2], rnd.choice(pages)[2]) for _ in range(300)]
    existing = spark.createDataFrame(edges, "audit_id int, src string, dst string").select(
        "audit_id", normalize_link_url(F.col("src")).alias("src_norm"), normalize_link_url(F.col("dst")).alias("dst_norm"))
    profile, roots = links.page_profile(df).cache(), findings.audit_roots(df)
    got = [{tuple(r) for r in links.link_candidates(profile, roots, existing, hot_df, block).collect()} for hot_df, block in ((512, 1 << 15), (3, 16))]
    assert got[0] == got[1] and len(got[0]) > 200
    plan = links.link_candidates(profile, roots, existing)._jdf.queryExecution().toString()
    assert "token" not in plan.replace("tokens", "")
