"""The training-text operators against plain loops, and their defined edge cases."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siteloom.llm import (
    disclosure, jaccard_join, kneser_ney, order, packing, quality_rules, repair, sharding, templates, textkit, token_cache, url_filter)

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_ascii(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


@pytest.fixture(scope="module")
def landed(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, ties, repeated rows, a long text, characters outside the BMP; clashing column names."""
    rng = random.Random(7)
    texts = [None, "", " \n\t", "one", "a b c", "a b c", "x" * 5000, "word " * 3000, "😀 émoji <|endoftext|> it's I'LL", "a\u00a0b\u2003c \n\n d"]
    texts += ["".join(rng.choice("ab AB'\n\t .,!?19é\u0301😀@+-") for _ in range(rng.randint(0, 90))) for _ in range(60)]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(3, "one", None, None, None), (None, "no id here", None, None, None)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    return df.withColumns({c: F.lit(1) for c in ("key", "id", "row", "m", "v", "node", "token", "shard", "n", "spans", "at", "__w")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words_of_rows(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


# 1 sharding

def check_shards(df, rows, shards):
    out = sharding.shard_rows(df, shards=shards, slack=0.0).collect()
    assert collections.Counter(r["doc_id"] for r in out) == collections.Counter(d for d, _ in rows)
    crcs = collections.Counter((zlib.crc32(t.encode()), len(t.encode()) + 1) for _, t in rows)
    assert collections.Counter((r["text_crc32"], r["size"]) for r in out) == crcs
    for s in {r["shard"] for r in out}:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    load = collections.Counter()
    for r in out:
        load[r["shard"]] += r["size"]
    largest, mean = max((n for _, n in crcs), default=0), sum(load.values()) / shards
    assert all(load[s] <= mean + 2 * largest for s in load)


def test_shards_are_bounded(landed, odd, empty):
    check_shards(landed, words_of_rows(landed), 8)
    check_shards(odd, words_of_rows(odd), 3)
    assert sharding.shard_rows(empty).count() == 0


def test_overflow_goes_clockwise():
    points = sharding.ring_points(4, 16)
    prefer = sharding.clockwise(points, 4)
    assert all(sorted(p) == [0, 1, 2, 3] and p[0] == points[i][1] for i, p in enumerate(prefer))
    rng = random.Random(3)
    loads = [rng.randint(0, 50) for _ in points]
    pieces = sharding.place_arcs(loads, prefer, 4, 0.1)
    got, cover = collections.Counter(), collections.Counter()
    for arc, a, b, s in pieces:
        got[s] += b - a
        cover[arc] += b - a
    assert [cover[i] for i in range(len(loads))] == loads and max(got.values()) <= 1.1 * sum(loads) / 4 + 1
    # One more shard moves at most what it takes in and what overflows.
    more = sharding.clockwise(sharding.ring_points(5, 16), 5)
    assert len(more) == 80


# 2 Kneser-Ney

def trigram_model(texts):
    """Plain interpolated modified Kneser-Ney over folded bytes."""
    fold = lambda t: [32 if c in b" \t\n\x0b\f\r" else 48 if 48 <= c < 58 else c for c in t.encode()]
    g3 = collections.Counter()
    for t in texts:
        s = fold(t)
        g3.update(zip(s, s[1:], s[2:]))
    g2 = collections.Counter((b, c) for _, b, c in g3)
    g1 = collections.Counter(c for _, c in g2)

    def disc(counts):
        n = collections.Counter(counts.values())
        if not (n[1] and n[2] and n[3] and n[4]):
            return lambda k: (0.5, 0.75, 1.0)[min(k, 3) - 1]
        y = n[1] / (n[1] + 2 * n[2])
        d = [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05) for k in (1, 2, 3)]
        return lambda k: d[min(k, 3) - 1]

    d3, d2, d1 = disc(g3), disc(g2), disc(g1)
    t1 = sum(g1.values())
    p1 = lambda c: ((g1[c] - d1(g1[c]) if c in g1 else 0) + sum(map(d1, g1.values())) / 256) / t1
    by_b, by_ab = collections.defaultdict(list), collections.defaultdict(list)
    for (b, _), n in g2.items():
        by_b[b].append(n)
    for (a, b, _), n in g3.items():
        by_ab[a, b].append(n)

    def p2(b, c):
        if b not in by_b:
            return p1(c)
        t = sum(by_b[b])
        return ((g2[b, c] - d2(g2[b, c]) if (b, c) in g2 else 0) + sum(map(d2, by_b[b])) * p1(c)) / t

    def p3(a, b, c):
        if (a, b) not in by_ab:
            return p2(b, c)
        t = sum(by_ab[a, b])
        return ((g3[a, b, c] - d3(g3[a, b, c]) if (a, b, c) in g3 else 0) + sum(map(d3, by_ab[a, b])) * p2(b, c)) / t

    def perplexity(t):
        s = fold(t)
        lp = [math.log(p3(*x)) for x in zip(s, s[1:], s[2:])]
        return math.exp(-sum(lp) / len(lp)) if lp else None

    return perplexity


def test_perplexities_match_a_plain_model(landed, odd, empty):
    docs = landed.filter("doc_id < 40").select("doc_id", "text", "lang").unionByName(odd.filter("doc_id > 3").select(F.col("doc_id") + 1000, "text", "lang").toDF("doc_id", "text", "lang"))
    trusted = docs.filter("doc_id < 25").select("doc_id")
    rows = {r["doc_id"]: r for r in kneser_ney.classify(docs, trusted).collect()}
    texts = dict(words_of_rows(docs))
    plain = trigram_model([t for d, t in texts.items() if d < 25])
    assert rows.keys() == texts.keys()
    for d, t in texts.items():
        mine, theirs = rows[d]["perplexity"], plain(t)
        assert (mine is None) == (theirs is None) and (mine is None or abs(mine - theirs) < 1e-6 * theirs), d
        assert rows[d]["kept"] == (mine is not None and mine <= rows[d]["threshold"])
    assert kneser_ney.classify(empty, trusted).count() == 0
    assert {round(r["perplexity"], 6) for r in kneser_ney.classify(docs.filter("doc_id < 5"), trusted.filter("doc_id < 0")).collect()} == {256.0}


# 3 and 5 and 7: tokens

@pytest.mark.parametrize("name, joined", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_chunk_encoder_equals_the_library(name, joined):
    rng = random.Random(11)
    alphabet = list("abAB'\n\t  .,!?19é\u0301Σσ<|>endoftext漢\u2019\u200b😀\x1c\x0b\u00a0\u3000\u2003")
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(4000)] + [None, "", " ", "x" * 3000, "it's I'LL <|endoftext|> a"]
    enc = textkit.ChunkEncoder(name, joined)
    enc.LIMIT = 3000  # forgets in between
    found = [(ids, counts) for _, ids, counts in enc.encode(pa.array(texts, pa.string()))]
    ids, counts = np.concatenate([i for i, _ in found]), np.concatenate([c for _, c in found])
    whole = enc.tok.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert counts.tolist() == [len(e.ids) for e in whole]
    assert ids.tolist() == [x for e in whole for x in e.ids]


def test_a_run_stays_whole_after_a_join_on_its_token(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2000")  # below the estimate, above what the filter leaves
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the pieces of a small table, each in a task
        bits = jaccard_join.parity(np.arange(100, dtype=np.uint64))
        rows = spark.range(0, 160, 1, 8).selectExpr("id % 16 AS token", "id AS node", "100 AS n", "0 AS pos", "id AS comp").withColumn("bits", F.lit(bits))
        few = spark.range(0, 5000, 1, 4).selectExpr("id AS token").groupBy("token").agg(F.count("*").alias("c")).filter("c > 1 OR token < 16").select("token")
        pairs = jaccard_join.named_pairs(rows.join(few, "token", "left_semi"), 80, True).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert sorted((r["a"], r["b"]) for r in pairs) == [(a, b) for a in range(160) for b in range(a) if (a - b) % 16 == 0]


def test_repair_round_trip():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 300))
        ids, ends = rng.integers(0, rng.integers(1, 6) + 1, n).astype(np.uint16), rng.random(n) < 0.1
        ends[-1] = True
        symbols, stops, rules = repair.repair(ids.copy(), ends.copy(), 10, least=2)
        assert repair.expand(symbols, rules.astype(np.int64), 10).tolist() == ids.tolist() and stops.sum() == ends.sum()
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        if a < b:
            assert repair.read_span(symbols, rules.astype(np.int64), repair.rule_lengths(rules, 10), 10, a, b).tolist() == ids[a:b].tolist()
        width = np.concatenate([np.ones(10, np.int64), repair.rule_lengths(rules, 10)])
        assert width[symbols].sum() == n


def test_repair_counts_only_pairs_that_may_still_be_frequent(monkeypatch):
    rng = np.random.default_rng(11)
    rare = rng.permutation(40_000).astype(np.uint16)  # no pair of these comes twice
    often = rng.integers(0, 6, 2000).astype(np.uint16) + 40_000
    ids = np.concatenate([rare, often])
    ends = np.zeros(len(ids), bool)
    ends[-1] = True
    sorted_at, sort = [], np.sort
    monkeypatch.setattr(np, "sort", lambda a, *args, **kw: (sorted_at.append(len(a)), sort(a, *args, **kw))[1])
    symbols, _, rules = repair.repair(ids.copy(), ends.copy(), 49408)
    monkeypatch.undo()
    assert sorted_at[0] >= 41_000 and max(sorted_at[1:]) <= 2000
    assert repair.expand(symbols, rules, 49408).tolist() == ids.tolist()
    lengths = repair.rule_lengths(rules, 49408)
    assert len(rules) > 50 and repair.expand(symbols, rules, 49408, lengths).tolist() == ids.tolist()


def test_repair_goes_on_until_no_pair_pays():
    rng = np.random.default_rng(2)
    passage = rng.integers(0, 40_000, 600)
    ids = np.concatenate([x for _ in range(5) for x in (passage, rng.integers(0, 40_000, 50))] + [np.full(90, 7)]).astype(np.uint16)
    ends = np.zeros(len(ids), bool)
    ends[np.arange(649, len(ids), 650)] = ends[-1] = True
    symbols, stops, rules = repair.repair(ids.copy(), ends.copy(), 49408)
    assert repair.expand(symbols, rules.astype(np.int64), 49408).tolist() == ids.tolist()
    assert repair.rule_lengths(rules, 49408).max() >= 500
    seen, last = collections.Counter(), {}
    for i, pair in enumerate(zip(symbols[:-1].tolist(), symbols[1:].tolist())):
        if not stops[i] and last.get(pair) != i - 1:
            seen[pair] += 1
            last[pair] = i
    assert max(seen.values()) < 3


def whole_ids(name, texts, joined):
    enc = textkit.ChunkEncoder(name, joined)
    return [np.array(e.ids + [1], "<u4") for e in enc.tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_id_file(spark, landed, odd, empty, tmp_path):
    for k, df in enumerate([landed, odd]):
        path = str(tmp_path / str(k))
        repair.write_ids(df, path, segment=2000)
        out = {}
        for r in repair.read_ids(spark, path, 49408).collect():
            out.setdefault(r["doc_id"], []).append(r)
        rows = sorted(words_of_rows(df), key=lambda r: (r[0] is not None, r[0] or 0))
        at = 0
        for (d, _), ids in zip(rows, whole_ids("word_bpe_49k.json", [t for _, t in rows], False)):
            assert any((r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes())) for r in out[d])
            at += len(ids)
    repair.write_ids(empty, str(tmp_path / "none"))
    assert repair.read_ids(spark, str(tmp_path / "none"), 49408).count() == 0


def test_token_cache_encodes_only_misses(spark, landed, odd, empty, tmp_path):
    path = str(tmp_path / "cache")
    for df in (landed, odd, landed, empty):
        rows = words_of_rows(df)
        want = collections.Counter((d, len(t.encode()), len(i) - 1) for (d, t), i in zip(rows, whole_ids("word_bpe_49k.json", [t for _, t in rows], False)))
        got = token_cache.count_tokens(df, path, "word_bpe_49k.json").collect()
        assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
    cached = spark.read.parquet(path)
    assert cached.count() == cached.select("digest").distinct().count()


def test_packing(landed, odd, empty):
    for df, size in ((landed, 256), (odd, 64)):
        out = packing.pack_documents(df, size, "byte_bpe_50k.json", joined=True).collect()
        rows, by = words_of_rows(df), collections.defaultdict(list)
        for r in out:
            by[r["sequence_id"]].append(r)
        for seq in by.values():
            at = 0
            for r in sorted(seq, key=lambda r: r["offset"]):
                assert r["offset"] == at
                at += r["length"]
            assert at <= size
        assert sorted(by) == list(range(len(by)))
        want = collections.Counter()
        for (d, _), ids in zip(rows, whole_ids("byte_bpe_50k.json", [t for _, t in rows], True)):
            want.update((d, a, min(size, len(ids) - a), zlib.crc32(ids[a:a + size].tobytes()), len(ids)) for a in range(0, len(ids), size))
        assert collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in out) == want
    assert sum(r["length"] for r in out) / (64 * len(by)) > 0.9
    assert packing.pack_documents(empty, 64, "byte_bpe_50k.json", joined=True).count() == 0


def test_histogram_packing_places_all():
    rng = random.Random(5)
    for _ in range(50):
        hist = {rng.randint(1, 100): rng.randint(1, 40) for _ in range(rng.randint(1, 30))}
        got = collections.Counter()
        for lengths, packs in packing.pack_histogram(hist, 100):
            assert sum(lengths) <= 100 and packs > 0
            got.update({n: lengths.count(n) * packs for n in set(lengths)})
        assert got == collections.Counter(hist)


def test_numbered(landed):
    rows = order.numbered(landed.select("lang", "doc_id"), ["lang", "doc_id"]).collect()
    assert [r["__n"] for r in sorted(rows, key=lambda r: (r["lang"], r["doc_id"]))] == list(range(len(rows)))


# 4 personal data

PLAIN = [("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")), ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
         ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")), ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"))]


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN):
        for m in pattern.finditer(text or ""):
            digits = [int(c) for c in m.group() if c.isdigit()]
            luhn = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0
            if (kind != "ip" or all(int(p) < 256 for p in m.group().split("."))) and (kind != "card" or 12 <= len(digits) <= 19 and luhn) \
                    and (kind != "phone" or 9 <= len(digits) <= 15):
                out.append((m.start(), k, m.end()))
    return ",".join(f"{PLAIN[k][0]}:{s}:{e}" for s, k, e in sorted(out))


def test_base_spans(spark, landed, odd):
    rng = random.Random(5)
    texts = ["".join(rng.choice(a) for _ in range(rng.randint(0, 80))) for a in ("ab@@..--_%+ 0123456789  ()\né😀x,", "0123456789.. -+@a") for _ in range(1500)]
    texts += [None, "", "4111 1111 1111 1111 and a@b.c_d@e.f x 1.2.3.4.5.6.7.8 +1 (469) 555-3334", "1" * 2000, "a" * 2000, "a@b" * 500, "1 " * 2000, "é😀 the.72@mail3.example.com, 255.255.255.256"]
    texts += [t for df in (landed, odd) for _, t in words_of_rows(df)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = df.select("doc_id", disclosure.spans_text(disclosure.base_spans(F.coalesce("text", F.lit("")))).alias("s")).collect()
    assert {r["doc_id"]: r["s"] for r in got} == {i: plain_spans(t) for i, t in enumerate(texts)}
    long = spark.createDataFrame([("9" * 300_000,), ("a" * 300_000,), ("a." * 150_000 + "@b.c",)], "text string")
    assert long.select(F.size(disclosure.base_spans(F.col("text"))).alias("n")).agg(F.sum("n")).first()[0] == 1


def test_disclosing_terms(spark, odd, empty):
    rows = [(k, f"alpha{k} beta{k} zorblax met bob@mail.example.com near{k} the delta{k} common word") for k in range(6)]
    rows += [(100 + k, f"nothing {k} the common word here") for k in range(60)] + [(200, "zorblax alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r["doc_id"]: r["s"] for r in disclosure.find(df, threshold=0.9).select("doc_id", disclosure.spans_text(F.col("spans")).alias("s")).collect()}
    text = dict(rows)[2]
    a, b = text.index("zorblax"), text.index("met")
    assert spans[2] == f"term:{a}:{a + 7},term:{b}:{b + 3},email:{text.index('bob')}:{text.index(' near')}"
    assert spans[103] == "" and spans[200] == ""
    clean = {r["doc_id"]: r["text"] for r in disclosure.sanitise(df).collect()}
    # "met" is never without the entity and goes; "zorblax" also stands elsewhere and is generalised.
    assert clean[2] == "alpha2 beta2 <term>  <email> near2 the delta2 common word" and clean[103] == dict(rows)[103]
    # Copies are one context: no evidence.
    copies = spark.createDataFrame([(k, "rare words near bob@mail.example.com only") for k in range(9)] + [(100 + k, "other") for k in range(9)], "doc_id long, text string")
    assert disclosure.find(copies).filter("size(spans) > size(base)").count() == 0
    assert disclosure.find(odd).count() == odd.count()
    same = disclosure.sanitise(odd)
    assert same.columns == odd.columns and same.count() == odd.count() and same.filter("text is null").count() == odd.filter("text is null").count()
    assert disclosure.find(empty).count() == 0 and disclosure.sanitise(empty).count() == 0


def test_terms_disclose_over_whole_documents(spark):
    filler = lambda k: " ".join(f"f{k}x{i}" for i in range(120))
    rows = [(k, f"quillfeather {filler(k)} write to bob@mail.example.com") for k in range(4)]
    # Near in one document, far in three.
    rows += [(10 + k, f"marrowgate {filler(10 + k) if k else ''} call eve@mail.example.com") for k in range(4)]
    # The same words in every document: copies of one text, and of one text with other punctuation.
    rows += [(20 + k, f"ploverdale{'.' * k} {filler(20)} ask amy@mail.example.com") for k in range(5)]
    rows += [(100 + k, f"nothing {k} to write, call or ask") for k in range(60)]
    out = disclosure.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text = dict(rows)
    got = {r["doc_id"]: {x["v"] for x in r["spans"] if x["k"] == len(disclosure.KINDS)} for r in out}
    assert all(got[k] == {"quillfeather"} for k in range(4)) and all(got[10 + k] == {"marrowgate"} for k in range(4))
    assert not any(got[k] for k in got if k >= 20)
    assert all(text[r["doc_id"]][x["s"]:x["e"]] == x["v"] for r in out for x in r["spans"])


# 6 Jaccard join

def plain_links(rows, k, percent):
    sets = []
    for d, t in rows:
        w = WORD.findall(lower_ascii(t))
        sets.append((d, frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(sets):
        low[find(i)] = min((x for x in (low.get(find(i)), d) if x is not None), default=None)
    return collections.Counter((d, len(s), low[find(i)]) for i, (d, s) in enumerate(sets))


def near_copies(rng, n, words, edits):
    base = [f"w{rng.randint(0, 10 ** 6)}" for _ in range(words)]
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 10 ** 6)}"
        yield " ".join(copy)


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80), (1, 50)])
def test_join_matches_all_pairs(spark, landed, odd, empty, k, percent):
    rng = random.Random(k)
    texts = [t for n, w, e in ((40, 60, 4), (60, 150, 7), (5, 30, 1), (3, 4, 1)) for t in near_copies(rng, n, w, e)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [f"{passage} " + " ".join(f"q{rng.randint(0, 10 ** 6)}" for _ in range(20)) for _ in range(40)] + texts[:30]
    made = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for df in (made, landed, odd):
        got = jaccard_join.link(df, k=k, percent=percent).collect()
        assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == plain_links(words_of_rows(df), k, percent)
    assert jaccard_join.link(empty, k=k, percent=percent).count() == 0


def test_one_of_each_group_stays(landed, odd):
    for df in (landed, odd):
        left = jaccard_join.one_of_each(df)
        keep = {d for d, _, c in plain_links(words_of_rows(df), 5, 80) if d == c}
        assert left.columns == df.columns
        assert collections.Counter(r["doc_id"] for r in left.select("doc_id").collect()) == collections.Counter(keep)


def test_only_doubtful_texts_travel(spark):
    """Rows whose text is neither gone nor there twice take no part in the last join, however large both sides are."""
    rows = spark.range(3000).select("id", F.xxhash64("id").alias("h"))
    named = rows.filter("id % 100 = 0")
    doubtful, rest = jaccard_join.split_by_hash(rows, "h", named.select(F.col("h").alias("node")))
    hit, free = ([r["id"] for r in part.collect()] for part in (doubtful, rest))
    assert sorted(hit + free) == list(range(3000))
    assert {i for i in range(3000) if i % 100 == 0} <= set(hit) and len(hit) < 60
    none, every = jaccard_join.split_by_hash(rows, "h", named.limit(0).select(F.col("h").alias("node")))
    assert none.count() == 0 and every.count() == 3000


def test_null_and_reused_keys_count_with_their_text(spark):
    rng = random.Random(9)
    base = [[f"{x}{rng.randint(0, 10 ** 6)}" for _ in range(80)] for x in "ab"]
    near = [" ".join([*base[b], *"xyz"[:n]]) for b, n in ((0, 0), (0, 1), (0, 2), (1, 0), (1, 1))]
    other = [" ".join(f"o{rng.randint(0, 10 ** 6)}" for _ in range(60)) for _ in range(3)]
    rows = [(1, near[0]), (None, near[1]), (2, near[2]), (2, other[0]), (None, near[3]), (None, near[4]), (None, other[1]), (None, None), (3, other[2]), (3, other[2])]
    left = collections.Counter((r["doc_id"], r["text"]) for r in jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    pair = [x for x in ((None, near[3]), (None, near[4])) if x in left]
    assert len(pair) == 1
    assert left == collections.Counter([(1, near[0]), (2, other[0]), pair[0], (None, other[1]), (None, None), (3, other[2])])
    item = "the farmer walks to the far fields while the sheep and the goats are counted before noon today"
    rows = [(None, f"so {item}"), (None, "clean"), (None, None), (5, f"so {item} then"), (5, "clean too"), (6, "clean")]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = templates.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in left) == collections.Counter([rows[1], rows[2], rows[4], rows[5]])


# 8 urls

def test_url_parts_and_rules(spark):
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
    cases = {None: ("", "", None), "no scheme": ("", "", None), "http://A.Example.NET/en/x?y": ("a.example.net", "/en/x", "example.net/en/"),
             "http://b.net/fr": ("b.net", "/fr", "net/"), "http://net/": ("net", "/", "net/"), "http://b.net": ("b.net", "", None), "http://xnet/": ("xnet", "/", None),
             "x://example.com/de/1#/": ("example.com", "/de/1", "example.com/de/"), "a://b.org/fr/://c.net/": ("b.org", "/fr/://c.net/", "org/fr/"), "h://?q": ("", "", None)}
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string")
    labelled = spark.createDataFrame([(f"http://{w}{i}.example.org/p{i}", int(w == "casino")) for i in range(40) for w in ("casino", "garden")], "url string, label int")
    out = {r["page_id"]: r for r in url_filter.judge(pages, labelled, rules).collect()}
    for i, want in enumerate(cases.values()):
        assert (out[i]["host"], out[i]["path"], out[i]["rule"]) == want
        if want[2]:
            assert out[i]["verdict"] == dict((b, a) for a, b in rules)[want[2]]
    fresh = spark.createDataFrame([(0, "https://www.casino777.example.org/a"), (1, "https://garden888.example.org/b")], "page_id long, url string")
    assert [r["verdict"] for r in url_filter.judge(fresh, labelled, []).orderBy("page_id").collect()] == ["block", "allow"]
    assert {r["verdict"] for r in url_filter.judge(fresh, labelled.filter("label = 0"), []).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), labelled, rules).count() == 0


def test_repeated_urls_count_once(spark):
    """Captures of one url don't fill the sample, wherever its hash puts it."""
    urls = [(f"http://{w}{i}.example.org/p{i}", int(w == "casino")) for i in range(40) for w in ("casino", "garden")]
    made = spark.createDataFrame(urls, "url string, label int")
    first = made.orderBy(F.xxhash64("url"), "url").first()
    labelled = made.union(made.filter(F.col("url") == first["url"]).crossJoin(spark.range(200)).select("url", "label"))
    fresh = spark.createDataFrame([(0, "https://www.casino777.example.org/a"), (1, "https://garden888.example.org/b")], "page_id long, url string")
    assert [r["verdict"] for r in url_filter.judge(fresh, labelled, [], bound=80).orderBy("page_id").collect()] == ["block", "allow"]


# 9 decontamination

def test_template_leaks(spark, odd, empty):
    item = "the farmer walks Anna to 12 km of fields while Anna counts 30 sheep and 12 goats before noon today"
    docs = {0: f"Some opening words here. {item} and it goes on", 1: item.upper().replace("ANNA", "Anna"), 2: item.replace("Anna", "Boris").replace("12", "7").replace("30", "99"),
            3: item.replace("12", "7", 1), 4: "nothing of the kind but the farmer walks Anna home", 5: None, 6: "", 7: f"{item} {item}"}
    items = spark.createDataFrame([(9, item), (10, "too short"), (11, None), (12, "")], "item_id long, text string")
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in templates.matches(df, items, width=6, literal=3).collect()}
    # 3 says 7 for one 12 and 12 for the other: its slots clash.
    assert set(got) == {(0, 9), (2, 9), (7, 9), (1, 9)} and got[0, 9]["first_word"] == 4
    left = templates.decontaminate(df, items, width=6, literal=3)
    assert {r["doc_id"] for r in left.collect()} == {3, 4, 5, 6} and left.columns == df.columns
    assert templates.decontaminate(odd, items).count() == odd.count()
    assert templates.matches(empty, items).count() == 0 and templates.matches(df, items.limit(0)).count() == 0


def test_exact_passages_are_found(spark, landed):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in templates.matches(landed, items).collect()}
    bench = [(r["item_id"], r["text"]) for r in items.collect()]
    assert got >= {(d, i) for d, t in words_of_rows(landed) for i, x in bench if x in t}


# 10 quality rules

def plain_measures(text):
    w = WORD.findall(text)
    wins = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    seen, cover = collections.Counter(wins), set()
    for i, x in enumerate(wins):
        if seen[x] > 1:
            cover |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)


def test_measures_and_verdicts(landed, odd, empty):
    for df in (landed, odd):
        rows = quality_rules.judge(df, ["doc_id", "text"]).collect()
        assert len(rows) == df.count()
        for r in rows:
            want = plain_measures(r["row"]["text"] or "")
            assert tuple(r["m"][:5]) == want
            assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["base_failed"] and r["kept"])
        kept = collections.Counter(r["row"]["doc_id"] for r in rows if r["kept"])
        left = quality_rules.keep_good(df)
        assert left.columns == df.columns and collections.Counter(r["doc_id"] for r in left.select("doc_id").collect()) == kept
    assert quality_rules.judge(empty, ["doc_id"]).count() == 0


def test_expectation_maximisation(spark):
    """Rates that made the votes are found again, and match a plain loop."""
    rng, rules = random.Random(2), [f"r{i}" for i in range(5)]
    seen = collections.Counter()
    for _ in range(4000):
        good = rng.random() < 0.8
        seen[tuple(0 if rng.random() < 0.2 else 1 if rng.random() < (0.95 if good else 0.2) else -1 for _ in rules)] += 1
    table = spark.createDataFrame([(dict(zip(rules, v)), n) for v, n in seen.items()], f"v struct<{','.join(f'{r}:int' for r in rules)}>, n long")
    got = quality_rules.fit(table, rules)
    assert abs(got["prior"] - 0.8) < 0.05 and all(abs(got["good"][r] - 0.95) < 0.03 and abs(got["bad"][r] - 0.2) < 0.08 for r in rules)


def test_rules_agree_with_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select(F.col("doc_id").alias("d"), F.col("quality").alias("truth"))
    rows = quality_rules.judge(docs, ["doc_id"]).join(labels, F.col("row.doc_id") == F.col("d"))
    counts = {(r["truth"], r["kept"]): r["n"] for r in rows.filter("not base_failed").groupBy("truth", "kept").agg(F.count("*").alias("n")).collect()}
    assert counts[1, True] >= 0.98 * (counts[1, True] + counts.get((1, False), 0)) and counts.get((0, True), 0) <= 0.2 * counts[0, False]


def test_items_without_template_windows_are_found_word_by_word(spark):
    items = [("short", "What is 3 plus 4?"), ("numbers", "12 34 56 78 90 12 34 56 78"), ("tiny", "Yes"), ("none", None), (None, "seven blue boats leave")]
    filler = "the old mill stands near a quiet river and nobody walks there after dark".split()
    rng = random.Random(3)
    def around(text):
        return " ".join([*rng.choices(filler, k=40), text, *rng.choices(filler, k=40)])
    texts = [around(t) for _, t in items if t] + [around("What is 3 plus 5?"), around("12 34 56 78 90"), around("what is  3 PLUS 4"), None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id string, text string")

    def plain(text):
        return re.sub(r"[^\w\s]+", "", (text or "").lower()).split()

    wanted = {(d, i) for d, t in enumerate(texts) for i, item in items if len(q := plain(item)) >= 3
              and any(plain(t)[p:p + len(q)] == q for p in range(len(plain(t))))}
    got = {(r["doc_id"], r["item_id"]) for r in templates.matches(df, table).collect()}
    assert got == wanted and len(wanted) == 4
    assert {r["item_id"] for r in templates.unsearched(table).collect()} == {"tiny", "none"}
    kept = {r["doc_id"] for r in templates.decontaminate(df, table).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in wanted}


def test_columns_of_any_name_stay(spark):
    rng = random.Random(4)
    names = ["__h", "__t", "__gone", "__leak", "__id", "k", "h", "hash", "doc", "id", "key"]
    texts = [*near_copies(rng, 6, 80, 2), None, "", "a b"]
    df = spark.createDataFrame([(i, t, *range(len(names))) for i, t in enumerate(texts)], "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))
    items = spark.createDataFrame([("x", texts[3])], "item_id string, text string")
    for out in (jaccard_join.one_of_each(df), templates.decontaminate(df, items)):
        rows = out.collect()
        assert out.columns == df.columns and len(rows) >= 3
        assert all([r[n] for n in names] == list(range(len(names))) for r in rows)


def test_wide_signatures_bound_the_overlap(monkeypatch):
    """The spare distance never falls below zero for sets as similar as the threshold asks, at any mix of widths."""
    rng = np.random.default_rng(5)
    for size in (40, 300, 520, 1100, 2600):
        base = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        sets = [base] + [np.unique(np.concatenate([base[rng.integers(0, drop + 1):], rng.integers(0, 1 << 63, drop, dtype=np.uint64)]))
                         for drop in (1, size // 20, size // 12, size // 2)]
        table = jaccard_join.Signatures(pa.chunked_array([[jaccard_join.parity(s) for s in sets]], type=pa.binary()))
        x, y = (a.ravel() for a in np.indices((len(sets), len(sets))))
        true = np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in zip(x, y)])
        for step in (1 << 21, 64):
            monkeypatch.setattr(jaccard_join, "AT_ONCE", step)
            assert (table.spare(x, y, true) >= 0).all()
        assert (table.spare(x, y, np.zeros(len(x), np.int64))[x == y] == 0).all()
