"""Vectors as four one-byte codes: integer product quantisation whose nearest entries are looked up in GNATs, one over each codebook.

A tree node holds a few split points (entries far from each other) and, for each split point and child, the least and the largest distance
from the split point to the child's entries. By the triangle inequality a query farther from that range than from its best entry so far
can't have its nearest entry in the child, and the whole subtree is left out. Distances are squared integers, computed exactly (in float64
while all sums stay under 2^53, else as Python integers); only bounds are roots, rounded away from pruning, and a subtree goes only when its
bound is strictly larger, so entries at equal distance are still compared as integers and the lower index wins.

Each round is one pass: tasks look up their vectors and hand on sums per entry, which are added up per entry; the driver holds nothing but
the codebooks (256 entries of one vector's length in all). The labels of a thousandth of the rows or more, 1,000 at most, are joined by a broadcast, the others by a shuffle.

Edge cases: rows whose vector is null or holds null or non-finite components are dropped, and so are rows whose vector isn't as long as that
of the smallest kept vec_id; a length that 4 doesn't divide is cut at i * length div 4; null vec_ids come last and equal ones by vector; with fewer than 256 kept rows
codebooks have as many entries as rows; null labels are one label; an error that no long holds is null; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import bounded_batches, join_hot, stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Split points of a tree node, and entries up to which a node isn't split.
SPLITS, BUCKET = 8, 16


@dataclass
class Node:
    ids: np.ndarray  # ascending: split points, or all entries of a leaf
    points: np.ndarray
    low: np.ndarray | None = None  # [split point, child]: range of distances, rounded outwards
    high: np.ndarray | None = None
    children: list[Node | None] = field(default_factory=list)


def squares(q: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances, exact."""
    if q.dtype == object:
        return ((q[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)
    return (q * q).sum(axis=1)[:, None] + (points * points).sum(axis=1)[None, :] - 2 * (q @ points.T)


def roots(square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots rounded down and up."""
    if square.dtype == object:
        down = np.frompyfunc(math.isqrt, 1, 1)(square)
        return down, down + 1
    root = np.sqrt(square)
    return root * (1 - 2**-50), root * (1 + 2**-50)


def gnat(points: np.ndarray, splits: int = SPLITS, bucket: int = BUCKET) -> Node:
    """A tree over the rows of points; of equal rows only the first can be nearest, so only that is kept."""
    first = {}
    for i, p in enumerate(map(tuple, points.tolist())):
        first.setdefault(p, i)
    return _node(points, np.array(sorted(first.values())), splits, bucket)


def _node(points: np.ndarray, ids: np.ndarray, splits: int, bucket: int) -> Node:
    if len(ids) <= max(bucket, splits):
        return Node(ids, points[ids])
    chosen = [ids[0]]
    gap = squares(points[ids], points[ids[:1]])[:, 0]
    while len(chosen) < splits:
        chosen.append(ids[np.argmax(gap)])
        gap = np.minimum(gap, squares(points[ids], points[chosen[-1:]])[:, 0])
    heads = np.array(sorted(chosen))
    rest = ids[~np.isin(ids, heads)]
    square = squares(points[rest], points[heads])
    down, up = roots(square)
    owner = np.argmin(square, axis=1)
    low, high, children = np.zeros((splits, splits), square.dtype), np.zeros((splits, splits), square.dtype), []
    for j in range(splits):
        own = owner == j
        if own.any():
            low[:, j], high[:, j] = down[own].min(axis=0), up[own].max(axis=0)
        children.append(_node(points, rest[own], splits, bucket) if own.any() else None)
    return Node(heads, points[heads], low, high, children)


def nearest(tree: Node, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the nearest entry of each row of q, of equal ones the lowest."""
    n, exact = len(q), q.dtype != object
    best = np.full(n, np.inf) if exact else np.full(n, 1 << 4096, dtype=object)
    index = np.full(n, np.iinfo(np.int64).max)
    todo = [(tree, np.arange(n), None)]
    while todo:
        node, rows, bound = todo.pop()
        if bound is not None:
            rows = rows[~(bound > roots(best[rows])[1]).astype(bool)]
        if not len(rows):
            continue
        square = squares(q[rows], node.points)
        at = np.argmin(square, axis=1)
        least, entry = square[np.arange(len(rows)), at], node.ids[at]
        better = ((least < best[rows]) | ((least == best[rows]) & (entry < index[rows]))).astype(bool)
        best[rows[better]], index[rows[better]] = least[better], entry[better]
        if not node.children:
            continue
        down, up = roots(square)
        near, later = [], []
        for j, child in enumerate(node.children):
            if child is None:
                continue
            apart = np.maximum(down - node.high[:, j], node.low[:, j] - up).max(axis=1)
            if exact:
                apart = apart * (1 - 2**-50)  # a negative bound leaves nothing out
            own = at == j
            near.append((child, rows[own], apart[own]))
            later.append((child, rows[~own], apart[~own]))
        todo += later + near  # the child of the nearest split point first
    return index, best


def integers(x: np.ndarray, ceiling: float) -> np.ndarray:
    """floor(1024 * x): float64 that hold integers, or Python integers beyond ceiling."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * SCALE)
    if not x.size or np.abs(scaled).max() <= ceiling:
        return scaled
    whole = np.frompyfunc(lambda v: int(v) * SCALE if abs(v) >= 2**53 else math.floor(v * SCALE), 1, 1)
    return whole(x)


def cuts(length: int, parts: int = PARTS) -> list[int]:
    return [i * length // parts for i in range(parts + 1)]


class Codebooks:
    """The entries of each part (lists of integers) and, made in each task when first needed, the trees over them."""

    def __init__(self, parts: list[list[list[int]]], length: int):
        self.parts, self.length, self.trees = parts, length, {}
        self.largest = max((abs(x) for part in parts for entry in part for x in entry), default=0)

    def __getstate__(self):
        return self.__dict__ | {"trees": {}}

    def ceiling(self) -> float:
        """The components up to which every sum of a distance stays under 2^53."""
        most = math.isqrt(2**53 // (4 * max(1, self.length)))
        return float(most) if self.largest <= most else -1.0

    def encoded(self, vectors: np.ndarray):
        """(integers, entry, squared distance) of each part of vectors (rows of floats)."""
        whole, at = integers(vectors, self.ceiling()), cuts(self.length, len(self.parts))
        for p, entries in enumerate(self.parts):
            key = p, whole.dtype
            if key not in self.trees:
                points = np.empty((len(entries), at[p + 1] - at[p]), whole.dtype)
                points[:] = entries
                self.trees[key] = gnat(points)
            own = whole[:, at[p] : at[p + 1]]
            yield own, *nearest(self.trees[key], own)


def _vectors(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def learned(kept: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one round over kept (vector)."""
    fields = "part int, entry int, n long, sums string"

    def added(batches):
        sums = {}
        for batch in batches:
            for p, (own, entry, _) in enumerate(books.encoded(_vectors(batch.column("vector"), books.length))):
                used, place, n = np.unique(entry, return_inverse=True, return_counts=True)
                total = np.zeros((len(used), own.shape[1]), object if own.dtype == object else np.int64)
                np.add.at(total, place, own if own.dtype == object else own.astype(np.int64))
                for e, k, row in zip(used.tolist(), n.tolist(), total.tolist(), strict=True):
                    m, old = sums.get((p, e), (0, [0] * len(row)))
                    sums[p, e] = m + k, [a + b for a, b in zip(old, row, strict=True)]
        rows = [(p, e, n, ",".join(map(str, row))) for (p, e), (n, row) in sums.items()]
        if rows:
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "entry", "n", "sums"])

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        each = [[int(x) for x in s.split(",")] if s else [] for s in rows["sums"]]
        total = ",".join(str(sum(c)) for c in zip(*each, strict=True))
        return pd.DataFrame({"part": rows["part"][:1], "entry": rows["entry"][:1], "n": [rows["n"].sum()], "sums": [total]})

    partial = kept.select("vector").mapInArrow(added, fields)
    parts = [list(part) for part in books.parts]
    for part, entry, n, sums in partial.groupBy("part", "entry").applyInPandas(joined, fields).collect():  # parts x entries rows at most
        parts[part][entry] = [int(x) // n for x in sums.split(",")] if sums else []
    return Codebooks(parts, books.length)


def first_codebooks(kept: DataFrame, entries: int, parts: int) -> Codebooks | None:
    """The parts of the rows with the smallest vec_ids; None of an empty table."""
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()  # as many rows as a codebook has entries
    if not first:
        return None
    length = len(first[0]["vector"])
    rows = [integers(np.array([r["vector"]], float), 2.0**53)[0].tolist() for r in first if len(r["vector"]) == length]
    at = cuts(length, parts)
    return Codebooks([[[int(x) for x in row[at[p] : at[p + 1]]] for row in rows] for p in range(parts)], length)


def compress(df: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, parts: int = PARTS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each row of df (vec_id, embedding, label) that isn't dropped."""
    spark = df.sparkSession
    bounded_batches(spark)
    finite = F.expr("forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < cast('inf' AS double))")
    rows = df.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), "label").filter(F.col("vector").isNotNull() & finite)
    books = first_codebooks(rows, entries, parts)
    if books is None:
        none = rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
        return none.filter("false")
    kept = rows.filter(F.size("vector") == books.length)
    for _ in range(rounds):
        books = learned(kept, books)
    listed = ",".join(str(x) for part in books.parts for entry in part for x in entry)
    kinds = {f.name: f.dataType for f in rows.schema}
    schema = StructType([StructField("vec_id", kinds["vec_id"]), StructField("label", kinds["label"])]).add("code", "string").add("error", "long")

    def coded(batches):
        for batch in batches:
            found = list(books.encoded(_vectors(batch.column("vector"), books.length)))
            codes = np.stack([entry for _, entry, _ in found], axis=1)
            width = max(2, len(f"{entries - 1:x}"))
            errors = [int(sum(x)) for x in zip(*(square.tolist() for _, _, square in found), strict=True)]
            code = ["".join(f"{x:0{width}x}" for x in row) for row in codes.tolist()]
            error = pa.array([x if x < 1 << 63 else None for x in errors], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), error], names=["vec_id", "label", "code", "error"])

    table = stored(kept.mapInArrow(coded, schema), "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error")
    labels = table.groupBy("label").agg(total)
    return join_hot(table, labels, "label").select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(listed.encode()).hexdigest()).alias("codebooks_sha256"))
