"""Shortest-pack-first packing over the length histogram.

Every document (its ids and an end id) is cut into pieces of ``size`` ids; the last piece is what is left over. The histogram of
piece lengths - at most ``size`` rows - is packed longest first: a length goes to the pack with the most room that can
take it, all equal packs at once, else into new packs. The result is a table of patterns (lengths of one pack) with counts. Pieces take
their seats by rank: the r-th piece of a length sits on the r-th seat for that length.

Documents are encoded once; after that only one row a piece moves. Ranks come from ranges of (length, document, start), so the
very common full length spreads over many tasks.

Defined cases: a null text is empty: one piece with the end id; equal rows each get seats; rows whose ids are equal get
seats in any order; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siteloom.llm.order import numbered
from siteloom.llm.textkit import encoder
from siteloom.session import stage


def pack_histogram(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, packs) of all packing patterns."""
    open_packs: dict[int, list] = {}  # by room left
    rooms: list[int] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and rooms and rooms[-1] >= length:
            room = rooms[-1]
            lengths, packs = open_packs[room].pop()
            taken = min(packs, left)
            if taken < packs:
                open_packs[room].append((lengths, packs - taken))
            elif not open_packs[room]:
                del open_packs[room]
                rooms.pop()
            keep(open_packs, rooms, room - length, (*lengths, length), taken)
            left -= taken
        # New packs take as many copies of the length as fit, as the most room is always in the newest pack.
        packs, rest = divmod(left, size // length)
        if packs:
            keep(open_packs, rooms, size % length, (length,) * (size // length), packs)
        if rest:
            keep(open_packs, rooms, size - rest * length, (length,) * rest, 1)
    return [p for packs in open_packs.values() for p in packs]


def keep(open_packs: dict, rooms: list, room: int, lengths: tuple, packs: int) -> None:
    if room not in open_packs:
        open_packs[room] = []
        insort(rooms, room)
    open_packs[room].append((lengths, packs))


def seats(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Columns length, first rank, first sequence, offset: a row for each place in each pattern, by length and rank."""
    rows, ranks, sequence = [], {}, 0
    for lengths, packs in patterns:
        offset = 0
        for length in lengths:
            rank = ranks.get(length, 0)
            rows.append((length, rank, sequence, offset))
            ranks[length] = rank + packs
            offset += length
        sequence += packs
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return tuple(table.T.copy())


def cut_documents(docs: DataFrame, size: int, name: str, joined: bool, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece: key, start, length, ids_crc32 (of little-endian uint32 ids), doc_tokens."""
    kind = dict(docs.dtypes)[key]

    def cut(batches):
        enc = encoder(name, joined)
        for batch in batches:
            for row, ids, counts in enc.encode(batch.column("text")):
                stops = np.cumsum(counts + 1)
                full = np.full(int(stops[-1]), end_id, np.uint32)
                inner = np.ones(len(full), bool)
                inner[stops - 1] = False
                full[inner] = ids
                raw = memoryview(full.astype("<u4").tobytes())
                total = counts + 1
                pieces = -(-total // size)
                doc = np.repeat(np.arange(len(total)), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * size
                length = np.minimum(size, total[doc] - start)
                at = (stops - total)[doc] + start
                crc = [zlib.crc32(raw[4 * a:4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(pa.array(row + doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(total[doc])],
                    names=["key", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        cut, f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack_documents(docs: DataFrame, size: int, name: str, joined: bool, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All pieces with sequence_id and offset; a sequence's pieces follow each other from offset 0, the rest is padding."""
    pieces = stage(cut_documents(docs, size, name, joined, end_id, key, text))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    lengths, first, sequence, offset = seats(pack_histogram(histogram, size))
    below = {n: sum(v for k, v in histogram.items() if k < n) for n in histogram}
    base = np.zeros(size + 1, np.int64)
    for n, v in below.items():
        base[n] = v
    seat_key = lengths * (1 << 44) + first
    kind = dict(pieces.dtypes)["key"]

    def sit(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("__n").to_numpy() - base[length]
            seat = np.searchsorted(seat_key, length * (1 << 44) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence[seat] + rank - first[seat]), pa.array(offset[seat])],
                                             names=["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    ranked = numbered(pieces, ["length", "key", "start"]).select("key", "start", "length", "ids_crc32", "doc_tokens", "__n")
    return ranked.mapInArrow(sit, f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
                             ).withColumnRenamed("key", key)


