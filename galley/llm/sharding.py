"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `virtual_nodes` points of the ring; a key belongs to the arc that ends in the next point clockwise. A shard
takes keys until its capacity is used up and the rest of the arc moves on clockwise, arc by arc, until a shard has room. The
capacities are the sizes of a division of all rows as even as can be (they differ by one at most and sum to the row count), so
all shards fill up exactly: the law that holds is `rows`.

Only counts of arcs reach the driver: shards x virtual_nodes numbers, however many rows there are. The order inside an arc is
that of `cells`, pieces of an arc by a second hash, so that a window sorts one cell and never a whole arc.

Edge cases: a null text has size 1 and the checksum of no bytes; a null doc_id is a key like any other and its rows are
dealt by their text; equal rows are interchangeable; an empty table gives an empty table; other columns are not returned.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARDS, VIRTUAL_NODES, CELLS = 16, 64, 64


def ring_points(shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """(position, shard), sorted; positions are signed 64-bit as xxhash64 gives them."""
    points = []
    for shard in range(shards):
        for node in range(virtual_nodes):
            digest = hashlib.sha256(f"shard-{shard}/{node}".encode()).digest()
            points.append((int.from_bytes(digest[:8], "big", signed=True), shard))
    return sorted(points)


def arc_flow(counts: list[int], owners: list[int], capacity: list[int]) -> list[tuple[int, int, int, int]]:
    """Deals the arcs' keys: (arc, first rank, keys, shard). Keys that a full shard can't take go on to the next arc's shard."""
    room, taken, dealt = list(capacity), [0] * len(counts), []
    arcs = len(owners)
    for hop in range(arcs):
        open_arcs = [a for a in range(arcs) if taken[a] < counts[a]]
        if not open_arcs:
            break
        for a in open_arcs:
            shard = owners[(a + hop) % arcs]
            n = min(room[shard], counts[a] - taken[a])
            if n:
                dealt.append((a, taken[a], n, shard))
                taken[a] += n
                room[shard] -= n
    return dealt


def ring_shards(df: DataFrame, key: str = "doc_id", text_col: str = "text", shards: int = SHARDS, virtual_nodes: int = VIRTUAL_NODES, cells: int = CELLS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row."""
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(key).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    points = ring_points(shards, virtual_nodes)
    position = F.xxhash64(F.col("doc_id"))
    arc = _arc_of([p for p, _ in points])(position)
    cell = F.pmod(F.xxhash64(F.lit("cell"), "doc_id", "text_crc32", "size"), F.lit(cells)).cast("int")
    keyed = rows.withColumn("arc", arc).withColumn("cell", cell)
    counts = keyed.groupBy("arc", "cell").count()
    by_arc = [0] * len(points)
    starts = {}
    for arc_no, cell_no, n in sorted(tuple(r) for r in counts.collect()):  # shards x virtual_nodes x cells rows at most
        starts[arc_no, cell_no] = by_arc[arc_no]
        by_arc[arc_no] += n
    total = sum(by_arc)
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    dealt = arc_flow(by_arc, [s for _, s in points], capacity)
    first = [0] * shards
    pieces = []
    for a, start, n, shard in sorted(dealt):
        pieces.append((a, start, n, shard, first[shard]))
        first[shard] += n
    # Both tables have a size that the parameters fix, not the data.
    start_of = spark.createDataFrame([(a, c, s) for (a, c), s in starts.items()], "arc int, cell int, cell_start long")
    piece_of = spark.createDataFrame(pieces, "arc int, from_rank long, n long, shard int, first_slot long")
    piece_of = piece_of.groupBy("arc").agg(F.sort_array(F.collect_list(F.struct("from_rank", "n", "shard", "first_slot"))).alias("pieces"))
    order = Window.partitionBy("arc", "cell").orderBy(position, "doc_id", "text_crc32", "size")
    ranked = keyed.withColumn("in_cell", F.row_number().over(order) - 1).join(F.broadcast(start_of), ["arc", "cell"])
    ranked = ranked.withColumn("rank", F.col("in_cell") + F.col("cell_start")).join(F.broadcast(piece_of), "arc")
    piece = F.filter("pieces", lambda p: (p["from_rank"] <= F.col("rank")) & (F.col("rank") < p["from_rank"] + p["n"]))[0]
    return ranked.withColumn("piece", piece).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("piece.shard").alias("shard"),
        (F.col("piece.first_slot") + F.col("rank") - F.col("piece.from_rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def _arc_of(points: list[int]):
    """A column function: the index of the first point at or after a position, 0 past the last."""

    @F.pandas_udf("int")
    def arc(position: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(points), position.to_numpy()) % len(points)).astype("int32")

    return arc
