"""Toxicity, filter interaction and importance resampling against plain loops, and their defined edge cases."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteloom.llm import filter_audit, ngram_importance, queries, string_kernel

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
CLASHES = ("key", "id", "row", "n", "body", "part", "mask", "digest", "bag", "toxic", "quality", "score", "hits", "weight", "rank", "__n", "s", "f")


@pytest.fixture(scope="module")
def landed(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def odd_rows():
    """Nulls, empty and blank texts, ties, repeated rows, very long texts, characters outside the BMP."""
    rng = random.Random(5)
    texts = [None, "", " \n\t", "one", "a b c", "a b c", "x" * 5000, "word " * 3000, "😀 émoji # it's I'LL", "ÄB AB b c \n\n d", "A" * 40]
    texts += ["".join(rng.choice("ab AB'\n\t .,!?19é́😀@#-") for _ in range(rng.randint(0, 400))) for _ in range(60)]
    rows = [(i, t, None, [None, "", "one", "two"][i % 4], None) for i, t in enumerate(texts)]
    return rows + [(3, "one", None, "two", None), (3, "one", None, "two", None), (None, "a b c", None, "one", None), (None, "a b c", None, "one", None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3).withColumns({c: F.lit(1) for c in CLASHES})


@pytest.fixture(scope="module")
def odd_labels(spark):
    rows = [(i, i % 2, i % 3 % 2) for i in range(40)] + [(3, 1, 1), (4, None, None), (None, 1, 1), (900, 1, 1), (5, 0, 1), (5, 1, 0)]
    return spark.createDataFrame(rows, LABELS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# 12 filter interaction

def plain_audit(docs, labels):
    """Every order run over the documents one by one."""
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    fails = []
    for i, t, part in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        held = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        fails.append((part or "", i, {k for k, v in held.items() if v}))
    out, share = {}, collections.Counter()
    for part in {p for p, _, _ in fails}:
        own = [(i, f) for p, i, f in fails if p == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, k in enumerate(order, 1):
                gone = [(i, f) for i, f in left if k in f]
                left = [(i, f) for i, f in left if k not in f]
                share[part, k] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(k in f for _, f in own) - len(gone), sum(f == {k} for _, f in own),
                                                   sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
    return {(p, o, s): (*v, share[p, o[s - 1]]) for (p, o, s), v in out.items()}


def check_audit(docs, labels):
    held = [(r["doc_id"], r["text"], r["source"]) for r in docs.select("doc_id", "text", "source").collect()]
    marks = [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect() if r["doc_id"] is not None]
    got = filter_audit.audit(docs, labels).collect()
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got} == plain_audit(held, marks)
    assert len(got) == 600 * len({s or "" for _, _, s in held})


def test_all_orders_match_a_plain_run(landed, labels, odd, odd_labels):
    check_audit(landed, labels)
    check_audit(odd, odd_labels)


def test_audit_of_an_empty_table(empty, odd_labels, landed):
    assert filter_audit.audit(empty, odd_labels).count() == 0
    bare = filter_audit.audit(landed, odd_labels.limit(0))
    assert bare.agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def test_lattice_counts_every_order():
    edges = filter_audit.lattice(5)
    assert len(edges) == 80 and all(sum(o for _, f, o in edges if f == k) == 120 for k in range(5))
    passed = collections.Counter(k for _, path in filter_audit.orders_of("ABCDE") for k in path)
    assert passed == {f"{s}:{f}": o for s, f, o in edges}


# 13 importance resampling

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, n=2):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return [" ".join(words[i:i + k]) for i in range(len(words)) for k in range(1, n + 1) if i + k <= len(words)], len(words)


def plain_resample(docs, target, percent=25, n=2, buckets=10_000, least_words=20, seed=7):
    hashed = lambda t: [zlib.crc32(x.encode()) % buckets for x in plain_features(t, n)[0]]
    held = [(i, hashed(t), plain_features(t, n)[1]) for i, t in docs]
    s, t = collections.Counter(b for _, f, _ in held for b in f), collections.Counter(b for x in target for b in hashed(x))
    ss, tt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in range(buckets)]
    rows = []
    for i, f, words in held:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in rows if r[1] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0]))
    for k, r in enumerate(fit[:percent * len(fit) // 100], 1):
        r[5] = k
    return sorted(map(tuple, rows), key=repr)


def check_resample(docs, target, **args):
    held = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    wanted = [r["text"] for r in target.select("text").collect()]
    got = ngram_importance.resample(docs, target, **args).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=repr) == plain_resample(held, wanted, **args)


def test_features_are_all_runs_of_words():
    import regex
    for n in (1, 2, 3):
        pattern, table = regex.compile(ngram_importance.run_pattern(n)), ngram_importance.folding()
        for text in [r[1] for r in odd_rows()] + ["-a--B\x00c!é_É9", " ", "--", "x"]:
            got, words = ngram_importance.features(text, pattern, table)
            want, many = plain_features(text, n)
            assert got == [zlib.crc32(x.encode()) for x in want] and words == many


def test_resampling_matches_a_plain_loop(spark, landed, odd):
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    check_resample(landed, target)
    check_resample(odd, target.withColumn("key", F.lit("x")), least_words=2, percent=60)
    check_resample(odd, target.limit(0), n=3, buckets=50, percent=100, least_words=0)


def test_resampling_an_empty_table(spark, empty):
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert ngram_importance.resample(empty, target).count() == 0
    with pytest.raises(ValueError):
        ngram_importance.scan(empty, "doc_id", "text", 2, 1 << 17)


def test_the_resampling_query(spark):
    held = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    wanted = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = queries.op13_overlapped_scan(spark, SF).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((r[0], *r[2:]) for r in plain_resample(held, wanted)), key=repr)


# 11 toxicity

def plain_kernel(a, b, p=string_kernel.P, gaps=string_kernel.GAPS, decay=string_kernel.DECAY):
    """The gap-limited subsequence kernel of two strings by listing all sequences."""
    def vector(s):
        out = collections.Counter()
        for i in range(len(s)):
            for rest in itertools.combinations(range(i + 1, min(len(s), i + p + gaps)), p - 1):
                out["".join(s[j] for j in (i, *rest))] += decay ** (rest[-1] - i + 1 - p)
        return out
    x, y = vector(a), vector(b)
    dot = lambda u, v: sum(u[k] * v[k] for k in u)
    return dot(x, y) / math.sqrt(dot(x, x) * dot(y, y)) if x and y else 0.0


def dense(span):
    window, bucket, weight, _ = string_kernel.sequences([span])
    out = np.zeros(1 << string_kernel.BITS)
    out[bucket[window == 0]] = weight[window == 0]
    return out


def test_kernel_matches_all_sequences():
    words = ["idiot", "idxiot", "ideal", "i.d-iot", "riot", "idiotic", "clown", "aaaaaaaaaaaa", "é😀éxé", "banana", "bananas", "a"]
    framed = lambda w: "\x02" + "".join(c for c in w if c.isalnum()) + "\x03"
    for a in words:
        for b in words:
            assert abs(dense(a) @ dense(b) - plain_kernel(framed(a), framed(b))) < 1e-9
    # Marks are dropped; an inserted character leaves more in common than another word that begins alike.
    assert abs(dense("idiot") @ dense("i.d-iot") - 1) < 1e-9
    assert dense("idiot") @ dense("idxiot") > 0.25 > dense("idiot") @ dense("ideal")


def test_spans_of_sentences():
    assert string_kernel.sentences("You are an I D I O T.  So there!\nFine") == [
        ["you", "are", "an", "i", "d", "i", "o", "t", "idiot"], ["so", "there"], ["fine"]]
    assert string_kernel.sentences(None) == [] == string_kernel.sentences(" \n")
    long = "x" * 20 + "worthless" + "y" * 31
    assert all(len(w) <= string_kernel.WINDOW for w in string_kernel.windows(long)) and any("worthless" in w for w in string_kernel.windows(long))


def test_machine_separates_and_folds_back():
    bad, good = {"idiot": 5, "clown": 3, "morons": 2}, ["ideal", "crown", "motors", "table", "window", "paper", "riot", "a"]
    columns, values, b = string_kernel.train(good, bad, 11)
    scorer = string_kernel.Scorer(columns, values, b)
    scorer.learn({*bad, *good, "idxiot", "cl0wn", "paperback"})
    assert min(scorer.known[w] for w in bad) > 0 > max(scorer.known[w] for w in good)
    assert scorer.known["idxiot"] > scorer.known["paperback"]


def made_up(rng, n):
    """Documents of random words; toxic ones hold a word of three stems with any ending, spelled out or with marks inserted."""
    syllables = ["ba", "ro", "ti", "men", "lo", "sa", "ker", "du", "vi", "non"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        sents = [[word() for _ in range(rng.randint(3, 12))] for _ in range(rng.randint(1, 6))]
        if toxic:
            bad = rng.choice(["gruzt", "fwecki", "plomph"]) + rng.choice(["", "s", "ing", "ly"])
            way = rng.random()
            bad = " ".join(bad) if way < 0.15 else "-".join(bad) if way < 0.3 else bad[:3] + "x" + bad[3:] if way < 0.45 else bad
            rng.choice(sents).insert(1, bad)
        rows.append((i, ". ".join(" ".join(s) for s in sents) + ".", int(toxic)))
    return rows


def test_held_out_documents_are_told_apart(spark):
    rows = made_up(random.Random(11), 1200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1, y) for i, _, y in rows], LABELS)
    out = {r["doc_id"]: r for r in string_kernel.classify(docs, marks).collect()}
    held = [(out[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r["held_out"] for r, _ in held) and sum(r["held_out"] for r in out.values()) == len(held)
    caught, kept = [r["predicted"] for r, y in held if y], [1 - r["predicted"] for r, y in held if not y]
    assert sum(caught) / len(caught) >= 0.95 and sum(kept) / len(kept) >= 0.97
    assert all((r["predicted"] == 1) == (r["score"] >= 0.5) and r["n_toxic_sentences"] <= r["n_sentences"] for r in out.values())


def test_labels_of_held_out_rows_and_other_columns_are_not_read(spark, odd, odd_labels):
    first = {(r["doc_id"], r["n_sentences"]): r["score"] for r in string_kernel.classify(odd, odd_labels).collect()}
    turned = odd_labels.withColumn("toxic", F.when(string_kernel.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = odd.withColumns({"lang": F.lit("xx"), "source": F.lit("yy"), "n_chars": F.lit(0)})
    again = {(r["doc_id"], r["n_sentences"]): r["score"] for r in string_kernel.classify(other, turned).collect()}
    assert first.keys() == again.keys() and all(abs(first[k] - again[k]) < 1e-9 for k in first)


def test_odd_rows_and_bare_labels(spark, odd, odd_labels, empty):
    out = string_kernel.classify(odd, odd_labels).collect()
    assert collections.Counter(r["doc_id"] for r in out) == collections.Counter(r[0] for r in odd_rows())
    assert all(0 <= r["score"] <= 1 for r in out)
    blank = {r["score"] for r in out if r["doc_id"] in (0, 1, 2)}
    assert len(blank) == 1 and len({r["score"] for r in out if r["doc_id"] in (4, 5, None)}) == 1
    assert string_kernel.classify(empty, odd_labels).count() == 0
    for kept, share in ((odd_labels.limit(0), 0.0), (odd_labels.filter("toxic = 0"), 0.0), (odd_labels.filter("toxic = 1"), 1.0)):
        assert {r["score"] for r in string_kernel.classify(odd, kept).collect()} == {share}
    few = string_kernel.labelled_sample(odd, odd_labels, "doc_id", "text", 5)
    assert few.count() == 5 and few.select("bag").distinct().count() == 5
