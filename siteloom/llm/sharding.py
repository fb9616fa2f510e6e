"""Consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a 64-bit ring; a text's hash is its place, and the first point clockwise is its shard.
A shard takes at most ``(1 + slack)`` times the mean load; what overflows goes on clockwise to the next other shard that has
room; a row on a cut goes where its middle lies. Overflow is decided arc by arc (an arc ends at a point of the ring) in rounds: in round r every arc offers what it
still has to its r-th shard clockwise. A shard becomes full once, so at most one arc for each shard is cut in two.

Rows are in ring order (place, id). Only sums for each arc reach the driver: ``shards * vnodes`` rows, whatever the corpus.

Defined cases: a null text is empty (size 1, checksum 0, one place for all empty texts); equal texts share a place, and ids
order them, so a group larger than a shard is cut at ids; equal ids keep any order; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from siteloom.session import stage


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(place, shard) in ring order; the points of a shard don't depend on how many others there are."""
    points = [(int.from_bytes(hashlib.sha256(f"shard {s} point {v}".encode()).digest()[:8], "big", signed=True), s)
              for s in range(shards) for v in range(vnodes)]
    return sorted(points)


def clockwise(points: list[tuple[int, int]], shards: int) -> list[list[int]]:
    """For each point, all shards in the order in which a key of its arc meets them."""
    owners = [s for _, s in points] * 2
    out = []
    for i in range(len(points)):
        seen: dict[int, None] = {}
        for s in owners[i:i + len(points)]:
            seen.setdefault(s)
            if len(seen) == shards:
                break
        out.append(list(seen))
    return out


def place_arcs(loads: list[int], prefer: list[list[int]], shards: int, slack: float) -> list[tuple[int, int, int, int]]:
    """(arc, from, to, shard): where each stretch of an arc's load goes; from and to count within the arc."""
    total = sum(loads)
    capacity = max(-(-total // shards), int((1 + slack) * total / shards))
    room, start, pieces = [capacity] * shards, [0] * len(loads), []
    for turn in range(shards):
        for arc, load in enumerate(loads):
            left = load - start[arc]
            if left > 0 and (take := min(left, room[s := prefer[arc][turn]])) > 0:
                pieces.append((arc, start[arc], start[arc] + take, s))
                room[s] -= take
                start[arc] += take
    return pieces


def shard_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8, vnodes: int = 128,
               slack: float = 0.05) -> DataFrame:
    """``key``, size, text_crc32, place, arc, home (shard without bounds), shard and slot of every row.

    Slots number a shard's rows from 0 in ring order, stretch by stretch.
    """
    spark = docs.sparkSession
    points = ring_points(shards, vnodes)
    places = np.array([p for p, _ in points], np.int64)
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = stage(docs.select(F.col(key).alias("key"), (F.octet_length(body) + 1).cast("long").alias("size"),
                               F.crc32(body).alias("crc"), F.xxhash64(body).alias("place")))

    def located(batches):
        row, load = 0, 0
        for batch in batches:
            size = batch.column("size").to_numpy()
            before = load + np.cumsum(size) - size
            arc = np.searchsorted(places, batch.column("place").to_numpy()) % len(places)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.arange(row, row + len(size))), pa.array(before), pa.array(arc.astype(np.int32))],
                names=[*batch.schema.names, "row", "before", "arc"])
            row, load = row + len(size), load + int(size.sum())

    kind = dict(narrow.dtypes)["key"]
    ordered = narrow.repartitionByRange("place", "key").sortWithinPartitions("place", "key").withColumn("part", F.spark_partition_id())
    rows = stage(ordered.mapInArrow(located, f"key {kind}, size long, crc long, place long, part int, row long, before long, arc int"))

    # Load and rows before each partition: a running sum over one row a partition.
    sums = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("load"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(F.col("part").alias("p"), F.coalesce(F.sum("load").over(before), F.lit(0)).alias("base"),
                          F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base_row"))
    at = rows.join(offsets, F.col("part") == F.col("p")).select(
        "key", "size", "crc", "place", "arc", (F.col("base") + F.col("before")).alias("at"), (F.col("base_row") + F.col("row")).alias("n"))
    # Arc 0 is met twice in ring order: before the first point and after the last.
    wraps = (F.col("arc") == 0) & (F.col("place") > F.lit(int(places[0])))
    at = at.withColumn("stretch", F.when(wraps, F.lit(len(places))).otherwise(F.col("arc")))
    loads = {r["stretch"]: r for r in at.groupBy("stretch").agg(F.min("at").alias("at"), F.sum("size").alias("load")).collect()}

    prefer = clockwise(points, shards)
    ring = sorted(loads)
    pieces = place_arcs([loads[s]["load"] for s in ring], [prefer[s % len(points)] for s in ring], shards, slack)
    table = [(ring[i], loads[ring[i]]["at"] + a, loads[ring[i]]["at"] + b, s, k) for k, (i, a, b, s) in enumerate(pieces)]
    plan = spark.createDataFrame(table, "s int, low long, high long, shard int, piece int")
    middle = F.col("at") + F.expr("size div 2")
    placed = at.join(plan, (F.col("stretch") == F.col("s")) & (middle >= F.col("low")) & (middle < F.col("high")))

    taken = {r["piece"]: r for r in placed.groupBy("piece").agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("first")).collect()}
    used, bases = [0] * shards, []
    for k, (_, _, _, s) in enumerate(pieces):
        if k in taken:
            bases.append((k, used[s] - taken[k]["first"]))
            used[s] += taken[k]["rows"]
    slots = spark.createDataFrame(bases, "k int, shift long")
    home = F.element_at(F.array(*[F.lit(s) for _, s in points]), F.col("arc") + 1)
    return placed.join(slots, F.col("piece") == F.col("k")).select(
        F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), "place", "arc", home.alias("home"), "shard",
        (F.col("n") + F.col("shift")).alias("slot"))
