"""Token ids of documents in a grammar-compressed file (Re-Pair), with random access.

File format: a Parquet table of segments in ascending order of ids, one grammar each:

    shard, segment        order of the segments; ``shard`` rises with the document ids
    n_tokens              ids in the segment
    keys                  the document ids
    counts                little-endian uint32 for each document: its number of ids
    heads                 little-endian uint32 for each document: its first symbol
    rules                 little-endian uint16 pairs: nonterminal ``base + k`` stands for the two symbols of pair k
    lengths               little-endian uint32 for each rule: how many ids it expands to
    symbols               little-endian uint16 symbols of all documents; below ``base`` a token id, otherwise a rule

Re-Pair: count the pairs of neighbouring symbols of a segment, give the frequent ones nonterminals, replace them from the most
frequent on, and repeat until no pair stands in ``LEAST`` places that don't overlap (a rule costs two symbols and saves one a
place, so it pays from three on) or no nonterminal is left. A round takes all pairs of at least a sixteenth of the leading count
that don't overlap, so a segment needs some dozens of rounds rather than one for each rule. No pair crosses the end of a document, so every document decodes by itself.
The rules of a segment are as many as fit uint16 symbols; past that its symbols stay as they are.

Defined cases: a null text is empty and holds the end id alone; null ids come first; rows of equal id keep any order.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from siteloom.llm.textkit import encoder

SEGMENT, LEAST = 1 << 18, 3


def repair(ids: np.ndarray, ends: np.ndarray, base: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, ends, rules). ``ends`` marks the last symbol of each document."""
    seq, rules = ids.astype(np.uint32), []
    room = (1 << 16) - base
    alive = ~ends  # places of pairs that may still be frequent; a pair that is rare once never gets more places
    while room > 0:
        places = np.flatnonzero(alive[:-1])
        if not len(places):
            break
        # Pairs in order of their code, the places of each in order.
        ordered = np.sort((((seq[places] << np.uint32(16)) | seq[places + 1]).astype(np.uint64) << np.uint64(32)) | places.astype(np.uint64))
        code, places = (ordered >> np.uint64(32)).astype(np.uint32), (ordered & np.uint64(0xFFFFFFFF)).astype(np.int64)
        fresh = np.concatenate([[True], code[1:] != code[:-1]])
        cut = np.flatnonzero(fresh)
        size = np.diff(np.append(cut, len(code)))
        # In a run of one pair (aaaa) every other place counts, as the others overlap.
        same = np.flatnonzero(~fresh[1:] & (places[1:] == places[:-1] + 1)) + 1
        count = size
        if len(same):
            run = np.maximum.accumulate(np.where(np.append(-1, same[:-1]) + 1 != same, same, 0))
            count = size - np.bincount(np.searchsorted(cut, same[((same - run) & 1) == 0], side="right") - 1, minlength=len(size))
        if count.max() < least:
            break
        often = np.flatnonzero(count >= max(least, int(count.max()) // 16))
        often = often[np.argsort(-count[often], kind="stable")][:room]
        alive = np.zeros(len(seq), bool)
        alive[places[np.repeat(count >= least, size)]] = True
        order = np.full(len(cut), len(often))
        order[often] = np.arange(len(often))
        rank = np.repeat(order, size)
        asked = rank < len(often)
        ordered = np.sort((places[asked] << 16) | rank[asked])
        spots, rank = ordered >> 16, ordered & 0xFFFF
        # A place is taken if its pair outranks both neighbours'; in a run of one pair (aaaa) every other place.
        close = spots[1:] == spots[:-1] + 1
        before, after = np.full(len(spots), len(often)), np.full(len(spots), len(often))
        before[1:][close], after[:-1][close] = rank[:-1][close], rank[1:][close]
        run = np.maximum.accumulate(np.where(rank != before, spots, 0))
        take = (((spots - run) & 1) == 0) & (rank <= after)
        take &= (rank < before) | ((rank == before) & np.append(np.zeros(2, bool), take[:-2])[:len(take)])
        take[1:] &= ~(take[:-1] & close)
        # The leading pair gets all its places, so each round has a rule; the places of pairs left with too few stay for later ones.
        enough = np.bincount(rank[take], minlength=len(often)) >= least
        take &= enough[rank]
        used = np.flatnonzero(enough)
        name = np.zeros(len(often), np.uint32)
        name[used] = base + len(rules) + np.arange(len(used))
        rules += code[cut[often[used]]].tolist()
        room -= len(used)
        spots, rank = spots[take], rank[take]
        seq[spots] = name[rank]
        ends[spots] = ends[spots + 1]
        alive[spots] = alive[np.maximum(spots - 1, 0)] = True
        keep = np.ones(len(seq), bool)
        keep[spots + 1] = False
        keep = np.flatnonzero(keep)
        seq, ends, alive = seq[keep], ends[keep], alive[keep]
        alive &= ~ends
    codes = np.array(rules, np.uint32)
    return seq.astype(np.uint16), ends, np.stack([codes >> np.uint32(16), codes & np.uint32(0xFFFF)], 1).astype(np.uint16) if len(codes) else np.zeros((0, 2), np.uint16)


def rule_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """How many ids each rule expands to; a rule uses only earlier ones."""
    known = [1] * base
    for a, b in rules.tolist():
        known.append(known[a] + known[b])
    return np.array(known[base:], np.uint32)


def expand(symbols: np.ndarray, rules: np.ndarray, base: int, lengths: np.ndarray | None = None) -> np.ndarray:
    """The ids of a run of symbols, all nonterminals of a pass at once; each symbol's place follows from the lengths of those before."""
    width = np.concatenate([np.ones(base, np.int64), rule_lengths(rules, base) if lengths is None else lengths.astype(np.int64)])
    todo = symbols.astype(np.int64)
    place = np.cumsum(width[todo])
    out = np.empty(int(place[-1]) if len(place) else 0, np.int64)
    place -= width[todo]
    while len(todo):
        done = todo < base
        out[place[done]] = todo[done]
        deep = np.flatnonzero(~done)
        place, pairs = place[deep], rules[todo[deep] - base].astype(np.int64)
        place = np.concatenate([place, place + width[pairs[:, 0]]])
        todo = np.concatenate([pairs[:, 0], pairs[:, 1]])
    return out


def read_span(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a run of symbols; only the symbols that overlap the span are expanded."""
    width = np.ones(len(symbols), np.int64)
    deep = symbols >= base
    width[deep] = lengths[symbols[deep].astype(np.int64) - base]
    upto = np.cumsum(width)
    a = int(np.searchsorted(upto, start, side="right"))
    b = int(np.searchsorted(upto, stop, side="left")) + 1
    skipped = int(upto[a - 1]) if a else 0
    return expand(symbols[a:b], rules, base, lengths)[start - skipped:stop - skipped]


def write_ids(docs: DataFrame, path: str, name: str = "word_bpe_49k.json", joined: bool = False, end_id: int = 1, key: str = "doc_id",
              text: str = "text", segment: int = SEGMENT) -> None:
    """Encode every text, append ``end_id`` and write the file at ``path``, in ascending order of ``key``."""
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).repartitionByRange("key").sortWithinPartitions("key")
    rows = rows.withColumn("shard", F.spark_partition_id())

    def compress(batches):
        enc = encoder(name, joined)
        base = enc.tok.get_vocab_size()
        held: list = []
        size, segments = 0, 0

        def close():
            nonlocal held, size, segments
            keys, ids = pa.concat_arrays([k for k, _, _, _ in held]), np.concatenate([i for _, i, _, _ in held])
            counts = np.concatenate([c for _, _, c, _ in held])
            ends = np.zeros(len(ids), bool)
            ends[np.cumsum(counts) - 1] = True
            symbols, ends, rules = repair(ids, ends, base)
            stops = np.flatnonzero(ends) + 1
            heads = np.concatenate([[0], stops[:-1]])
            cells = [pa.array([held[0][3]], pa.int32()), pa.array([segments], pa.int32()), pa.array([len(ids)], pa.int64()),
                     pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)]
            cells += [pa.array([x.tobytes()], pa.binary()) for x in (
                counts.astype("<u4"), heads.astype("<u4"), rules.astype("<u2"), rule_lengths(rules, base).astype("<u4"), symbols.astype("<u2"))]
            segments += 1
            held, size = [], 0
            return pa.RecordBatch.from_arrays(cells, names=["shard", "segment", "n_tokens", "keys", "counts", "heads", "rules", "lengths", "symbols"])

        for batch in batches:
            shard = batch.column("shard")[0].as_py() if len(batch) else 0
            for row, ids, counts in enc.encode(batch.column("text")):
                stops = np.cumsum(counts + 1)
                full = np.full(int(stops[-1]), end_id, np.uint16)
                inner = np.ones(len(full), bool)
                inner[stops - 1] = False
                full[inner] = ids
                held.append((batch.column("key").slice(row, len(counts)), full, counts + 1, shard))
                size += len(full)
                if size >= segment:
                    yield close()
        if held:
            yield close()

    schema = f"shard int, segment int, n_tokens long, keys array<{kind}>, counts binary, heads binary, rules binary, lengths binary, symbols binary"
    rows.mapInArrow(compress, schema).write.parquet(path)


def read_ids(spark, path: str, base: int, key: str = "doc_id") -> DataFrame:
    """``key``, start (ids of all documents before), n_tokens, ids_crc32 (of little-endian uint32 ids) from the file."""
    kind = next(f.dataType.elementType.simpleString() for f in spark.read.parquet(path).schema if f.name == "keys")
    file = spark.read.parquet(path)
    sizes = file.groupBy("shard").agg(F.sum("n_tokens").alias("all"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    shards = sizes.select(F.col("shard").alias("s"), F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("shard").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    starts = file.select("shard", "segment", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("local"))
    starts = starts.join(shards, F.col("shard") == F.col("s")).select(F.col("s"), F.col("segment").alias("g"), (F.col("base") + F.col("local")).alias("first"))

    def decode(batches):
        for batch in batches:
            for i in range(len(batch)):
                cell = lambda k, t: np.frombuffer(batch.column(k)[i].as_py(), t)  # noqa: E731, B023
                keys, counts = batch.column("keys")[i].values, cell("counts", "<u4").astype(np.int64)
                ids = expand(cell("symbols", "<u2"), cell("rules", "<u2").reshape(-1, 2), base, cell("lengths", "<u4")).astype("<u4")
                stops = np.cumsum(counts)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (b - n):4 * b]) for b, n in zip(stops.tolist(), counts.tolist())]
                n = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("shard")[i].as_py()] * n, pa.int32()), pa.array([batch.column("segment")[i].as_py()] * n, pa.int32()),
                     keys, pa.array(stops - counts), pa.array(counts), pa.array(crc, pa.int64())],
                    names=["shard", "segment", "key", "within", "n_tokens", "ids_crc32"])

    rows = file.select("shard", "segment", "keys", "counts", "rules", "lengths", "symbols").mapInArrow(
        decode, f"shard int, segment int, key {kind}, within long, n_tokens long, ids_crc32 long")
    return rows.join(starts, (F.col("shard") == F.col("s")) & (F.col("segment") == F.col("g"))).select(
        F.col("key").alias(key), (F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "shard", "segment")


