"""Toxic documents by a subsequence string-kernel support vector machine with Nyström landmarks, trained on labelled sentences.

The kernel compares two spans by the sequences of ``P`` characters they share, in order and not necessarily side by side; each
character skipped (at most ``GAPS`` in a sequence) multiplies its weight by ``DECAY``. So "idxiot" still resembles "idiot", and a
stem is recognised under any ending. A span is one word of a sentence, lowered and without its marks ("i.d-iot"), or three or more
single characters in a row taken together ("i d i o t"); a word of more than ``LONG`` characters counts as its windows of
``WINDOW`` characters, so that no insult is diluted by what it is glued to. A sentence scores its highest span; a document is judged
by its ``BEST`` highest spans and how many it has to choose from.

Labels hold for documents, so their sentences are bags: some sentence of a toxic document is toxic, none of a clean one is.
``fit`` starts from the sequences that toxic bags hold more often, then takes turns: pick the span that speaks most for each toxic
bag and the hardest span of each clean bag, choose landmarks among them, train a linear machine on the Nyström features
K(x, z) K(z, z)^(-1/2), score again. The machine is folded back into one weight a character sequence, which is the same
function: scoring needs no landmark. A logistic regression over what the bags are judged by gives probabilities.

Bounds: at most ``bound`` different labelled texts, the first by hash of the text, with their whole sentences; what the driver
holds follows that number (a span or two a text and turn), ``landmarks`` and ``2 ** BITS`` counts. Sequences share ``2 ** BITS``
buckets by hash; a collision adds two weights. Every text is scored whole; memory follows one batch and ``REMEMBER`` spans.

Defined cases: a null, empty or blank text has no span and scores as one without evidence; repeated rows score alike; equal labelled
texts count once, as toxic if any of them is; a null key hashes as an empty one; with labels of one class only, or none, every
document gets the share of toxic labels (0 without labels); an empty table gives no rows.
"""

from __future__ import annotations

import re
from itertools import combinations
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siteloom.session import stage

P, GAPS, DECAY, BITS, BEST = 4, 2, 0.5, 20, 3
LONG, WINDOW, STRIDE = 14, 12, 3
REMEMBER, SLICE = 400_000, 1 << 20
#: Places of a sequence's characters after its first, with the sequence's weight.
SHAPES = [((*inner, last), DECAY ** (last - P + 1)) for last in range(P - 1, P + GAPS) for inner in combinations(range(1, last), P - 2)]
#: Odd multipliers of a sequence's characters.
FACTORS = [0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93]
SENTENCE_END = re.compile(r"[.!?]\s+|\n+")
SPELLED = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")


def sentences(text: str | None) -> list[list[str]]:
    """The raw spans of every sentence that has any; "" never occurs among them."""
    text = (text or "").lower()
    parts = SENTENCE_END.split(text)
    if SPELLED.search(text):
        spans = [p.split() + ["".join(m[0].split()) for m in SPELLED.finditer(p)] for p in parts]
    else:
        spans = map(str.split, parts)
    return [s for s in spans if s]


def windows(span: str) -> list[str]:
    """A raw span's letters and digits between marks of their ends; in windows if there are many."""
    if not span.isalnum():
        span = "".join(c for c in span if c.isalnum())
    framed = f"\x02{span}\x03"
    if len(span) <= LONG:
        return [framed]
    last = len(framed) - WINDOW
    return [framed[i:i + WINDOW] for i in [*range(0, last, STRIDE), last]]


def sequences(spans: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Window, bucket and weight of the sequences of all windows of some spans, sorted and each once; and each window's span.
    The weights of a window have length one."""
    parts = [windows(s) for s in spans]
    owner = np.repeat(np.arange(len(spans)), [len(p) for p in parts])
    flat = [w for p in parts for w in p]
    length = np.array([len(w) for w in flat], np.int64)
    chars = np.frombuffer("".join(flat).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    where, end = np.repeat(np.arange(len(flat)), length), np.repeat(np.cumsum(length), length)
    # A sequence's hash is the mixed sum of one product a character; in the last bits of a key stands how much was skipped.
    at, factors, found = np.arange(len(chars)), [chars * np.uint64(f) for f in FACTORS], []
    base = where.astype(np.uint64) << np.uint64(BITS + 2)
    for places, _ in SHAPES:
        last = places[-1]
        n = max(0, len(chars) - last)
        h = factors[0][:n] + sum(factors[i + 1][k:k + n] for i, k in enumerate(places))
        h = ((h ^ (h >> np.uint64(32))) * np.uint64(FACTORS[0])) >> np.uint64(64 - BITS)
        found.append((base[:n] | h << np.uint64(2) | np.uint64(last + 1 - P))[at[:n] + last < end[:n]])
    keys = np.sort(np.concatenate(found))
    weight, keys = DECAY ** (keys & np.uint64(3)).astype(np.float64), keys >> np.uint64(2)
    first = np.flatnonzero(np.diff(keys, prepend=np.uint64(1 << 63)))
    keys, weight = keys[first], np.add.reduceat(weight, first) if len(first) else weight
    window, bucket = (keys >> np.uint64(BITS)).astype(np.int64), (keys & np.uint64((1 << BITS) - 1)).astype(np.int64)
    norm = np.sqrt(np.bincount(window, weight * weight, minlength=len(flat)))
    return window, bucket, weight / norm[window], owner


def span_scores(spans: list[str], table: np.ndarray) -> np.ndarray:
    """The highest window of every span under a weight a bucket; 0 for a span without sequences."""
    if not spans:
        return np.zeros(0)
    window, bucket, weight, owner = sequences(spans)
    value = np.bincount(window, weight * table[bucket], minlength=len(owner))
    out = np.full(len(spans), -np.inf)
    np.maximum.at(out, owner, value)
    return out


class Scorer:
    """Scores raw spans and remembers them."""

    def __init__(self, buckets: np.ndarray, values: np.ndarray, intercept: float):
        self.table, self.intercept, self.known = np.zeros(1 << BITS), intercept, {}
        self.table[buckets] = values

    def learn(self, spans: set[str]) -> None:
        new = [s for s in spans if s not in self.known]
        if len(self.known) + len(new) > REMEMBER:
            self.known, new = {}, list(spans)
        for i in range(0, len(new), 20_000):
            part = new[i:i + 20_000]
            self.known.update(zip(part, (span_scores(part, self.table) + self.intercept).tolist()))

    def documents(self, texts: list[str | None]):
        """For each text the score of every sentence, what its probability is read from, and its sentences' spans.

        The second are the ``BEST`` highest different scores of spans and the logarithm of how many spans there are; what is missing
        counts as the score of a span without evidence. New spans are learnt for about ``SLICE`` characters of texts at once.
        """
        at = 0
        while at < len(texts):
            part, size = [], 0
            while at < len(texts) and size < SLICE:
                part.append(sentences(texts[at]))
                size += len(texts[at] or "")
                at += 1
            self.learn({span for parts in part for spans in parts for span in spans})
            yield from map(self.read, part)

    def read(self, parts: list[list[str]]) -> tuple[list[float], list[float], list[list[str]]]:
        known = self.known.__getitem__
        scores = [max(map(known, spans)) for spans in parts]
        spans = set().union(*parts)
        top = sorted(set(map(known, spans)), reverse=True)[:BEST]
        top += [min([self.intercept, *top[-1:]])] * (BEST - len(top))
        return scores, [*top, log1p(len(spans))], parts

    def highest(self, parts: list[list[str]]) -> str | None:
        return max((span for spans in parts for span in spans), key=lambda s: (self.known[s], s), default=None)


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, bound: int) -> DataFrame:
    """(bag, toxic, text) of the different labelled texts, at most ``bound``: those of the least hashes. Staged."""
    marks = labels.select(F.col(key).alias("key"), F.col("toxic").alias("toxic")).dropna().groupBy("key").agg(F.max("toxic").alias("toxic"))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("bag", F.xxhash64("text"))
    told = rows.select("key", "bag").join(marks, "key").groupBy("bag").agg(F.max("toxic").alias("toxic"))
    chosen = stage(told.orderBy("bag").limit(bound))
    most = chosen.agg(F.max("bag")).first()[0]
    if most is None:
        return stage(rows.limit(0).select("bag", F.lit(0).alias("toxic"), "text"))
    # Only texts up to the last chosen hash move, and each once.
    texts = rows.filter(F.col("bag") <= most).join(chosen, "bag").groupBy("bag").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    return stage(texts.select("bag", "toxic", "text"))


def evidence(sample: DataFrame) -> np.ndarray:
    """For each bucket, how many standard errors more often toxic bags hold one of its sequences than clean ones; 0 if fewer."""
    def each(batches):
        held, bags = np.zeros((2, 1 << BITS), np.int64), [0, 0]
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans = list(set().union(*sentences(text)))
                bags[toxic] += 1
                if spans:
                    held[toxic, np.unique(sequences(spans)[1])] += 1
        at = np.flatnonzero(held.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(held[0][at], bags[0])), pa.array(np.append(held[1][at], bags[1]))],
                                         names=["bucket", "clean", "toxic"])

    sums = sample.select((F.col("toxic") > 0).cast("int").alias("toxic"), "text").mapInArrow(each, "bucket long, clean long, toxic long").groupBy("bucket").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).filter("toxic > 0").toArrow()
    bucket, clean, toxic = (sums.column(i).to_numpy() for i in range(3))
    out, whole = np.zeros(1 << BITS), bucket < 0
    if whole.any():
        n0, n1 = clean[whole][0], toxic[whole][0]
        share = (clean + toxic) / (n0 + n1)
        z = (toxic / n1 - clean / max(n0, 1)) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n1 + 1 / max(n0, 1)))
        out[bucket[~whole]] = np.maximum(z[~whole], 0)
    return out


def strongest(sample: DataFrame, buckets: np.ndarray, values: np.ndarray, intercept: float) -> list[tuple[int, str | None, list[float]]]:
    """(toxic, highest span or null, what the probability is read from) of each bag."""
    def each(batches):
        scorer = Scorer(buckets, values, intercept)
        for batch in batches:
            read = [(scorer.highest(parts), x) for _, x, parts in scorer.documents(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([best for best, _ in read], pa.string()),
                                              pa.array([x for _, x in read], pa.list_(pa.float64()))], names=["toxic", "span", "x"])

    rows = sample.select((F.col("toxic") > 0).cast("int").alias("toxic"), "text").mapInArrow(each, "toxic int, span string, x array<double>")
    return sorted((tuple(r) for r in rows.collect()), key=lambda r: (r[0], r[1] or "", r[2]))


def ordinary(sample: DataFrame, many: int) -> list[str]:
    """Some spans of clean bags, one or two a bag, at most ``many``: the least by hash."""
    def each(batches):
        for batch in batches:
            found = []
            for text in batch.column(0).to_pylist():
                found += sorted(set().union(*sentences(text)), key=lambda s: hash_of(s))[:2]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["span"])

    rows = sample.filter("toxic <= 0").select("text").mapInArrow(each, "span string").distinct()
    return sorted(r["span"] for r in rows.orderBy(F.xxhash64("span"), "span").limit(many).collect())


def hash_of(span: str) -> int:
    from zlib import crc32

    return crc32(span.encode("utf-8", "surrogatepass"))


def kernel_rows(spans: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Row, bucket and weight of each span by its first window's sequences, for training."""
    window, bucket, weight, owner = sequences(spans)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    row = np.full(len(owner), -1)
    row[first] = owner[first]
    keep = row[window] >= 0
    return row[window[keep]], bucket[keep], weight[keep], len(spans)


def against(rows, columns: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """Kernel values of sparse rows with landmarks given densely over the sorted buckets ``columns``; in blocks of rows."""
    row, bucket, weight, n = rows
    place = np.minimum(np.searchsorted(columns, bucket), len(columns) - 1)
    hit = columns[place] == bucket
    row, place, weight = row[hit], place[hit], weight[hit]
    out = np.zeros((n, len(dense)))
    for a in range(0, n, 1000):
        lo, hi = np.searchsorted(row, [a, a + 1000])
        block = np.zeros((min(1000, n - a), len(columns)))
        block[row[lo:hi] - a, place[lo:hi]] = weight[lo:hi]
        out[a:a + 1000] = block @ dense.T
    return out


def machine(x: np.ndarray, y: np.ndarray, c: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, by Newton steps; ``y`` is +1 or -1, ``c`` weighs rows to a sum of 1."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w, eye = np.zeros(x1.shape[1]), np.full(x1.shape[1], ridge)
    eye[-1] = 1e-9
    for _ in range(100):
        slack = 1 - y * (x1 @ w)
        on = slack > 0
        xs = x1[on] * c[on, None]
        step = np.linalg.solve(np.diag(eye) + x1[on].T @ xs, eye * w - xs.T @ (y[on] * slack[on]))
        loss = lambda v: (eye * v * v).sum() + (c * np.maximum(1 - y * (x1 @ v), 0) ** 2).sum()
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if size * np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def train(good: list[str], bad: dict[str, int], landmarks: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets, weights and intercept of a machine that tells the spans ``bad`` (with their counts) from ``good``."""
    often = sorted(bad, key=lambda s: (-bad[s], s))
    marks = often[:landmarks // 2]
    marks = marks + good[:landmarks - len(marks)]
    row, bucket, weight, m = kernel_rows(marks)
    columns = np.unique(bucket)
    dense = np.zeros((m, len(columns)))
    dense[row, np.searchsorted(columns, bucket)] = weight
    values, vectors = np.linalg.eigh(dense @ dense.T)
    kept = values > 1e-6
    root = vectors[:, kept] / np.sqrt(values[kept])
    spans = often + good
    y = np.array([1.0] * len(often) + [-1.0] * len(good))
    c = np.array([float(bad[s]) for s in often] + [1.0] * len(good))
    for side in (y > 0, y < 0):
        c[side] /= 2 * c[side].sum()
    w, b = machine(against(kernel_rows(spans), columns, dense) @ root, y, c)
    return columns, (root @ w) @ dense, b


def logistic(x: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression (the last one without a factor), with targets smoothed by the classes' sizes."""
    n1, n0 = toxic.sum(), (1 - toxic).sum()
    target = np.where(toxic > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), 1e-2
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (p - target) + ridge * w)
        step *= min(1, 2 / max(np.abs(step).max(), 1e-12))
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(sample: DataFrame, landmarks: int = 256, turns: int = 4, ordinary_spans: int = 4000) -> dict:
    """The model from (toxic, text) rows: buckets, values, intercept of the machine, slope and shift of the probability."""
    classes = {r["t"]: r["n"] for r in sample.groupBy((F.col("toxic") > 0).alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = classes.get(True, 0), classes.get(False, 0)
    model = {"buckets": np.zeros(0, np.int64), "values": np.zeros(0), "intercept": 0.0, "curve": None, "share": n1 / max(n1 + n0, 1)}
    if not n1 or not n0:
        return model
    start = evidence(sample)
    buckets = np.flatnonzero(start)
    values, intercept = start[buckets], 0.0
    common, hard = ordinary(sample, ordinary_spans), set()
    found = strongest(sample, buckets, values, intercept)
    for _ in range(turns):
        bad: dict[str, int] = {}
        for toxic, span, _ in found:
            if span is not None and toxic:
                bad[span] = bad.get(span, 0) + 1
        hard |= {span for toxic, span, _ in found if span is not None and not toxic}
        bad = {s: n for s, n in bad.items() if s not in hard} or bad
        good = sorted(hard - bad.keys(), key=hash_of) + [s for s in common if s not in hard and s not in bad]
        if not bad or not good:
            break
        buckets, values, intercept = train(good, bad, landmarks)
        found = strongest(sample, buckets, values, intercept)
    curve = logistic(np.array([x for _, _, x in found]), np.array([float(t) for t, _, _ in found]))
    return model | {"buckets": buckets, "values": values, "intercept": intercept, "curve": curve}


def score(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, score (probability), n_sentences, n_toxic_sentences (on the machine's toxic side) of every row."""
    curve, share = model["curve"], float(model["share"])

    def each(batches):
        scorer = Scorer(model["buckets"], model["values"], model["intercept"])
        for batch in batches:
            read = [(scores, x) for scores, x, _ in scorer.documents(batch.column(1).to_pylist())]
            many = [len(scores) for scores, _ in read]
            if curve is None:
                out, toxic = [share] * len(read), [0] * len(read)
            else:
                x = np.array([x for _, x in read]).reshape(len(read), BEST + 1)
                out = 1 / (1 + np.exp(-np.clip(x @ curve[:-1] + curve[-1], -30, 30)))
                toxic = [sum(f > 0 for f in scores) for scores, _ in read]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64()), pa.array(many, pa.int64()), pa.array(toxic, pa.int64())],
                                             names=["key", "score", "n_sentences", "n_toxic_sentences"])

    held = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = held.schema["key"].dataType.simpleString()
    return held.mapInArrow(each, f"key {kind}, score double, n_sentences long, n_toxic_sentences long").withColumnRenamed("key", key)


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 5 == 0


def classify(docs: DataFrame, labels: DataFrame, bound: int = 6000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``score`` of every row with ``held_out`` and ``predicted``; the labels of held-out keys are never read."""
    seen = labels.filter(~held_out(F.col(key)))
    model = fit(labelled_sample(docs, seen, key, text, bound))
    rows = score(docs, model, key, text)
    return rows.withColumn("held_out", held_out(F.col(key))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
