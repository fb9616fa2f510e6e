"""Exact Jaccard join of documents on word n-grams, as a blocked product of the document by n-gram incidence matrix.

Documents of equal n-gram sets are one class (named by a 64-bit digest of the set). The product runs over the columns (n-grams)
that can matter: in one order of all n-grams, two sets of Jaccard >= t share an n-gram among the first n - ceil(t n) + 1 of
each. The order puts frequent n-grams last (their counts come from a table of ``BUCKETS`` hashed counters over all
documents), so shared passages seldom fall into that part. Any order gives the same result.

1. one pass over the texts: class, size, and the counters
2. second pass: the leading n-grams of every class, shuffled by n-gram; a class stays where another one fits by size and place
3. third pass: parity signatures of the classes that are left, found through a bit filter of ``FILTER_BITS`` bits. A signature
   has two bits or more for each n-gram, 512 to 4096 in all; a longer one folds onto a shorter one
4. for each n-gram, pairs of its classes, in blocks, are discarded by bounds: on size, on the overlap that places of the
   shared n-gram leave, and on the overlap that the signatures leave (all upper bounds of the true overlap)
5. another pass: the whole sets of the classes in pairs, which are counted exactly: |intersection| and |union|
6. connected components

Steps 4 to 6 run in three turns, each over classes that are still apart. In the first, a class stands only in the run of the n-gram
that most classes share with it and names one partner there, which joins a large group of near copies with one pair a class. In the
second it names one partner for every run of more than SMALL classes; the third names every remaining pair.
A pair that is never named is either below the bounds or within one component, so no link between components is lost.

Defined cases: null and empty texts and texts without words have no n-grams, size 0 and are linked with nothing; a text of
fewer than k words is its whole sequence; repeated rows are of one class; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siteloom.llm.components import components
from siteloom.llm.textkit import LOWER, mix, shingle_hashes, span_hash, text_slices, words_of
from siteloom.session import stage

BUCKETS, FILTER_BITS, SMALL, BLOCK = 1 << 16, 1 << 23, 4, 512
#: Least and most words of 64 bits of a signature, and how many of them are compared at once.
NARROW, WIDE, AT_ONCE = 8, 64, 1 << 21


def sets_of(column: pa.Array, k: int):
    """(row, sorted distinct n-gram hashes, class) of every document of the column that has words."""
    for first, buf, offsets in text_slices(column):
        buf = LOWER[buf]
        starts, ends, docs = words_of(buf, offsets)
        grams, owner = shingle_hashes(span_hash(buf, starts, ends), docs, len(offsets) - 1, k)
        cuts = np.searchsorted(owner, np.arange(len(offsets)))
        for d in range(len(offsets) - 1):
            if cuts[d] < cuts[d + 1]:
                own = np.sort(grams[cuts[d]:cuts[d + 1]])
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
                yield first + d, own, class_of(own)


def class_of(grams: np.ndarray) -> int:
    """A signed 64-bit digest of a set given in sorted order."""
    folded = mix(grams + mix(np.arange(len(grams), dtype=np.uint64)))
    return int(np.uint64(mix(np.array([folded.sum(dtype=np.uint64) ^ np.uint64(len(grams))], np.uint64))[0]).astype(np.int64))


def needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of sets of sizes a and b whose Jaccard similarity reaches the threshold."""
    return -(-percent * (a + b) // (100 + percent))


def measure(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """Staged rows (key, n, node) of documents and (bucket, count) of the counters of each task."""
    kind = dict(docs.dtypes)[key]

    def scan(batches):
        counters = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            n, node = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for row, grams, name in sets_of(batch.column("text"), k):
                n[row], node[row] = len(grams), name
                np.add.at(counters, (grams >> np.uint64(48)).astype(np.int64), 1)
            none = pa.nulls(len(batch), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n), pa.array(node, mask=n == 0), none, none],
                                             names=["key", "n", "node", "bucket", "count"])
        full = np.flatnonzero(counters)
        none = pa.nulls(len(full), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.nulls(len(full), key_type), none, none, pa.array(full), pa.array(counters[full])],
                                         names=["key", "n", "node", "bucket", "count"])

    from pyspark.sql.pandas.types import to_arrow_type
    key_type = to_arrow_type(docs.schema[key].dataType)
    return stage(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        scan, f"key {kind}, n long, node long, bucket long, count long"))


def frequency_classes(measured: DataFrame) -> np.ndarray:
    """0 for a bucket of usual count, then 1, 2, ... with the logarithm of what it has beyond that. BUCKETS numbers."""
    rows = measured.filter("bucket is not null").groupBy("bucket").agg(F.sum("count").alias("n")).collect()
    counts = np.zeros(BUCKETS)
    for r in rows:
        counts[r["bucket"]] = r["n"]
    usual = np.median(counts)
    beyond = counts - usual - 4 * np.sqrt(usual) - 4
    return np.where(beyond > 0, 1 + np.floor(np.log2(np.maximum(beyond, 1))), 0).astype(np.uint64)


def leading(docs: DataFrame, text: str, k: int, percent: int, classes: np.ndarray) -> DataFrame:
    """token, node, n, pos: the leading n-grams of every class of more than one candidate; classes twice in a task go once."""
    def scan(batches):
        done: set[int] = set()
        for batch in batches:
            tokens, nodes, sizes, places = [], [], [], []
            for _, grams, name in sets_of(batch.column("text"), k):
                if name in done:
                    continue
                done.add(name)
                n = len(grams)
                take = n + (-percent * n // 100) + 1
                order = np.argsort((classes[(grams >> np.uint64(48)).astype(np.int64)] << np.uint64(58)) | (grams >> np.uint64(6)), kind="stable")[:take]
                tokens.append(grams[order])
                nodes.append(np.full(take, name))
                sizes.append(np.full(take, n))
                places.append(np.arange(take))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(nodes)),
                                                  pa.array(np.concatenate(sizes).astype(np.int32)), pa.array(np.concatenate(places).astype(np.int32))],
                                                 names=["token", "node", "n", "pos"])

    return docs.select(F.col(text).alias("text")).mapInArrow(scan, "token long, node long, n int, pos int")


def dealt_by_token(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with whole runs of one token in one partition, sorted by token and ``order``.

    Dealt by a hash of the token: Spark leaves out a repartition by a column that its input is already dealt by, and may then read
    that input in pieces of a run (a join that turns into a broadcast, a skewed partition).
    """
    return rows.repartition(F.xxhash64("token")).sortWithinPartitions("token", *order)


def by_token(batches, work):
    """Calls ``work`` on columns of whole runs of one token; rows come sorted by token. Yields its record batches."""
    held: list = []
    for batch in batches:
        if not len(batch):
            continue
        token = batch.column("token").to_numpy()
        cut = int(np.searchsorted(token, token[-1]))  # the last run may go on
        if cut and held:
            yield from work(pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks())
            held = []
        elif cut:
            yield from work(pa.Table.from_batches([batch.slice(0, cut)]))
        elif held and held[-1].column("token")[0].as_py() != token[0]:
            yield from work(pa.Table.from_batches(held).combine_chunks())
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from work(pa.Table.from_batches(held).combine_chunks())


def has_partner(token: np.ndarray, n: np.ndarray, pos: np.ndarray, percent: int) -> np.ndarray:
    """Whether another row of the token passes the bounds on size and place with the row. Rows are sorted by (token, n).

    From place pos on, n - pos n-grams are left, so a partner has at most ``top`` of them: the largest m with
    (100 + percent) (n - pos) >= percent (n + m). Rows i and j fit if m_j <= top_i and n_i <= top_j, so row i asks for the highest
    top among the rows of up to top_i n-grams, other than itself; running maxima answer that.
    """
    top = (100 + percent) * (n - pos) // percent - n
    fresh = np.concatenate([[True], token[1:] != token[:-1]])
    run = np.cumsum(fresh) - 1
    step = np.int64(1) << 40
    first = np.maximum.accumulate(top + run * step)
    before = np.where(fresh, run * step - (step >> 1), np.concatenate([[0], first[:-1]]))
    second = np.maximum.accumulate(np.minimum(top + run * step, before))
    last = np.searchsorted(run * step + n, run * step + np.maximum(top, 0), side="right") - 1
    begin = np.flatnonzero(fresh)[run]
    best, other = first[last] - run * step, second[last] - run * step
    return (last >= begin) & np.where(top == best, other >= n, best >= n)


def shared(rows: DataFrame, percent: int) -> DataFrame:
    """The rows that another class of their token may match by size and place, each once, and their number (run)."""
    def work(table):
        token, node, n, pos = (table.column(c).to_numpy().astype(np.int64) for c in ("token", "node", "n", "pos"))
        order = np.lexsort((node, n, token))
        order = order[np.concatenate([[True], (token[order[1:]] != token[order[:-1]]) | (node[order[1:]] != node[order[:-1]])])]
        order = order[has_partner(token[order], n[order], pos[order], percent)]
        _, at, many = np.unique(token[order], return_inverse=True, return_counts=True)
        left = table.take(pa.array(order))
        yield from left.append_column("run", pa.array(many[at].astype(np.int32), pa.int32())).to_batches()

    return dealt_by_token(rows).mapInArrow(
        lambda batches: by_token(batches, work), "token long, node long, n int, pos int, run int")


def node_bits(nodes: DataFrame) -> np.ndarray:
    """A bit filter of ``FILTER_BITS`` bits that holds all of ``nodes`` (column node) and few others."""
    place = F.col("node").bitwiseAND(F.lit(FILTER_BITS - 1))
    rows = nodes.select(F.shiftright(place, 6).alias("w"), F.expr("shiftleft(1L, cast(node & 63 as int))").alias("b"))
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    for r in rows.groupBy("w").agg(F.bit_or("b").alias("b")).collect():
        bits[r["w"]] = r["b"]
    return bits.view(np.uint64)


def filtered_sets(docs: DataFrame, text: str, k: int, nodes: DataFrame, column: str, encode) -> DataFrame:
    """node and ``column`` (binary: ``encode`` of the set) of the classes in ``nodes`` and of few others, a row each."""
    bits = node_bits(nodes)

    def scan(batches):
        done: set[int] = set()
        for batch in batches:
            names, cells = [], []
            for _, grams, name in sets_of(batch.column("text"), k):
                spot = name & (FILTER_BITS - 1)
                if name not in done and int(bits[spot >> 6]) >> (spot & 63) & 1:
                    done.add(name)
                    names.append(name)
                    cells.append(encode(grams))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(cells, pa.binary())], names=["node", column])

    found = docs.select(F.col(text).alias("text")).mapInArrow(scan, f"node long, {column} binary")
    return found.groupBy("node").agg(F.first(column).alias(column))


def split_by_hash(rows: DataFrame, column: str, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``column`` (long) is one of ``nodes`` (column node) or shares its bit in their filter, and all other rows."""
    bits = node_bits(nodes)

    def look(column: pd.Series) -> pd.Series:
        spot = column.to_numpy() & (FILTER_BITS - 1)
        return pd.Series(bits[spot >> 6] >> (spot & 63).astype(np.uint64) & np.uint64(1) == 1)

    hit = F.pandas_udf(look, "boolean")(F.col(column))
    return rows.filter(hit), rows.filter(~hit)


def parity(grams: np.ndarray) -> bytes:
    """A signature; the distance of two, folded to one width, is at most the size of the sets' symmetric difference."""
    width = 64 * min(WIDE, max(NARROW, 1 << (2 * len(grams) - 1).bit_length() >> 6))
    spot = (mix(grams) & np.uint64(width - 1)).astype(np.int64)
    return np.packbits(np.bincount(spot, minlength=width).astype(np.uint8) & 1).tobytes()


class Signatures:
    """The signatures of a table's rows at every width that they have or fold to."""

    def __init__(self, column: pa.ChunkedArray):
        cells = column.to_pylist()
        self.words = np.array([len(c) >> 3 for c in cells], np.int64)
        self.sheets, self.spots = {}, {}
        width, wider = WIDE, None
        while width >= NARROW:
            own = np.flatnonzero(self.words == width)
            sheet = np.frombuffer(b"".join(cells[i] for i in own), np.uint64).reshape(-1, width)
            rows = own
            if wider is not None:
                folded = self.sheets[2 * width]
                sheet, rows = np.concatenate([sheet, folded[:, :width] ^ folded[:, width:]]), np.concatenate([own, wider])
            self.sheets[width], self.spots[width] = sheet, np.full(len(cells), -1)
            self.spots[width][rows] = np.arange(len(rows))
            width, wider = width >> 1, rows

    def apart(self, x: np.ndarray, y: np.ndarray, width: int) -> np.ndarray:
        """Distances of rows x and y at a width that both have or fold to."""
        sheet, spot, out = self.sheets[width], self.spots[width], np.empty(len(x), np.int64)
        step = max(1, AT_ONCE // width)
        for a in range(0, len(x), step):
            out[a:a + step] = np.bitwise_count(sheet[spot[x[a:a + step]]] ^ sheet[spot[y[a:a + step]]]).sum(1, dtype=np.int64)
        return out

    def spare(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """By how much the distance of rows x and y stays below ``most`` at the least width and, if it does, at the common one."""
        left = most - self.apart(x, y, NARROW)
        common = np.minimum(self.words[x], self.words[y])
        for width in np.unique(common[(left >= 0) & (common > NARROW)]).tolist():
            at = np.flatnonzero((left >= 0) & (common == width))
            left[at] = most[at] - self.apart(x[at], y[at], width)
        return left


def named_pairs(rows: DataFrame, percent: int, everyone: bool) -> DataFrame:
    """Distinct (a, b), a > b, that no bound rules out, of rows token, node, n, pos, bits, comp whose comps differ.

    With ``everyone`` all of them, otherwise one partner for each class in a run of more than SMALL classes: the one whose signature
    is nearest among the first block that has any.
    """
    def passing(t, i, j):
        """1 and the spare distance of each pair that no bound rules out, else 0."""
        n, m = t["n"][i], t["n"][j]
        least = needed(n, m, percent)
        fits = (t["comp"][i] != t["comp"][j]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
        fits &= np.minimum(n - t["pos"][i], m - t["pos"][j]) >= least
        at = np.flatnonzero(fits.ravel())
        x, y = np.broadcast_to(i, fits.shape).ravel()[at], np.broadcast_to(j, fits.shape).ravel()[at]
        score = np.zeros(fits.shape, np.int64)
        score.ravel()[at] = np.maximum(1 + t["bits"].spare(x, y, t["n"][x] + t["n"][y] - 2 * least.ravel()[at]), 0)
        return score

    def work(table):
        t = {c: table.column(c).to_numpy().astype(np.int64) for c in ("token", "node", "n", "pos", "comp")}
        t["bits"] = Signatures(table.column("bits"))
        first = np.flatnonzero(np.concatenate([[True], t["token"][1:] != t["token"][:-1]]))
        size = np.diff(np.append(first, len(t["token"])))
        left, right = [], []
        for s in np.unique(size[(size > 1) & (size <= SMALL)]):
            u, v = np.triu_indices(s, 1)
            heads = first[size == s]
            for a in range(0, len(heads), max(1, 200_000 // len(u))):
                i, j = (heads[a:a + max(1, 200_000 // len(u)), None] + u).ravel(), (heads[a:a + max(1, 200_000 // len(u)), None] + v).ravel()
                ok = passing(t, i, j) > 0
                left.append(i[ok])
                right.append(j[ok])
        for head, s in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist()):
            for a in range(head, head + s, BLOCK):
                i = np.arange(a, min(a + BLOCK, head + s))
                open_rows = np.ones(len(i), bool)
                for b in range(head, a + 1, BLOCK):
                    j = np.arange(b, min(b + BLOCK, head + s))
                    mine = i[open_rows]
                    score = passing(t, mine[:, None], j[None, :]) * (j[None, :] < mine[:, None])
                    if everyone:
                        x, y = np.nonzero(score)
                    else:
                        x = np.flatnonzero(score.any(1))
                        y = score[x].argmax(1)
                        open_rows[np.flatnonzero(open_rows)[x]] = False
                    left.append(mine[x])
                    right.append(j[y])
                    if not open_rows.any():
                        break
        if left:
            x, y = t["node"][np.concatenate(left)], t["node"][np.concatenate(right)]
            pairs = np.unique(np.stack([np.maximum(x, y), np.minimum(x, y)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    return dealt_by_token(rows, "n", "node").mapInArrow(lambda batches: by_token(batches, work), "a long, b long").distinct()


def verified(pairs: DataFrame, docs: DataFrame, text: str, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold. Only sets of classes in pairs move, once for both sides."""
    def compare(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = np.sort(np.concatenate([x, y]), kind="stable")
                overlap = int((both[1:] == both[:-1]).sum())
                ok.append(100 * overlap >= percent * (len(x) + len(y) - overlap))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    # Pairs and sets grow together, so neither is broadcast at any size.
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    sets = filtered_sets(docs, text, k, nodes, "grams", lambda grams: grams.astype("<u8").tobytes())
    mine = sets.select(F.col("node").alias("na"), F.col("grams").alias("x"))
    other = sets.select(F.col("node").alias("nb"), F.col("grams").alias("y"))
    pairs = pairs.hint("merge").join(mine.hint("merge"), F.col("a") == F.col("na"))
    return pairs.join(other.hint("merge"), F.col("b") == F.col("nb")).select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """key, n_shingles, component_id (smallest key reachable by links of Jaccard >= percent / 100) of every row."""
    measured = measure(docs, key, text, k)
    rows = measured.filter("bucket is null").select("key", "n", "node")
    candidates = stage(shared(leading(docs, text, k, percent, frequency_classes(measured)), percent))
    marks = stage(filtered_sets(docs, text, k, candidates, "bits", parity))
    busiest = candidates.groupBy("node").agg(F.max(F.struct("run", "token", "n", "pos")).alias("at")).select("node", "at.token", "at.n", "at.pos")
    tried = stage(named_pairs(busiest.join(marks, "node").withColumn("comp", F.col("node")), percent, everyone=False))
    roots = stage(components(stage(verified(tried, docs, text, k, percent))))
    for everyone in (False, True):
        # Classes still apart, over the n-grams that more than one component has; only what is left of these travels with its signature.
        labelled = candidates.drop("run").join(roots.withColumnRenamed("node", "nd"), F.col("node") == F.col("nd"), "left").withColumn("comp", F.coalesce("root", "node")).drop("nd", "root")
        mixed = labelled.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")
        rest = stage(named_pairs(labelled.join(mixed, "token", "left_semi").join(marks, "node"), percent, everyone).join(tried, ["a", "b"], "left_anti"))
        if not rest.isEmpty():
            more = stage(verified(rest, docs, text, k, percent))
            roots = stage(components(more.union(roots.filter("node <> root").select("node", "root"))))
            tried = stage(tried.union(rest))

    # A class's least key, then a component's; only classes travel, their many rows are combined first.
    least = rows.filter("node is not null").groupBy("node").agg(F.min("key").alias("low"))
    least = least.join(roots.withColumnRenamed("node", "nd"), F.col("node") == F.col("nd"), "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    total = least.groupBy("root").agg(F.min("low").alias("component_id"))
    named = least.join(total, "root").select(F.col("node").alias("nd"), "component_id")
    return rows.join(named, F.col("node") == F.col("nd"), "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest key, then of the least hash of its text.

    A row is its key and its text: equal rows of one key and text count as one, other texts of a reused key stand for themselves.
    A null key is a key like any other and comes last, so it stays only in components of null keys alone.
    """
    row = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.xxhash64(text).alias("hash"))
    groups = link(docs.select(row.alias("row"), F.col(text).alias("text")), "row", "text", k, percent)
    gone = stage(groups.filter(~F.col("row").eqNullSafe(F.col("component_id"))).select(F.col("row.key").alias("key"), F.col("row.hash").alias("hash")).distinct())
    # The columns travel in one struct, so that no name of theirs can clash.
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(key).alias("k"), F.xxhash64(text).alias("h"))
    twice = stage(held.groupBy("k", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    # Only rows whose text may be gone or stand twice are shuffled; all others stay where they are read.
    doubtful, rest = split_by_hash(held, "h", gone.select(F.col("hash").alias("node")).union(twice.select("h")))
    left = doubtful.join(gone, (F.col("h") == F.col("hash")) & F.col("k").eqNullSafe(F.col("key")), "left_anti")
    if not twice.isEmpty():
        left = left.dropDuplicates(["k", "h"])
    return left.select("doc.*").union(rest.select("doc.*"))
