"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints: one pass over the texts. The distinct fingerprints are the leaves of a binary trie; node pairs are traversed
together from the root down, the differing bits of their prefixes are added up and a pair ends where they exceed the budget.

A budget of 4 errors over 64 bits leaves one of the three blocks 0-20, 21-41 and 42-63 with one error at most, so three tries
are walked, each with another block on top and a budget of 1 inside that block: this prunes near the root, where an
unsplit trie hardly prunes at all. Coarse nodes (cells) of bounded size are found from counts of prefixes, made deeper where
fingerprints crowd, and pairs of cells within the budget are the tasks. A task keeps its own components while it walks, skips
node pairs that lie in one component already, and returns one link per fingerprint at most, never all pairs of a group.
Links then join in connected components by alternating large and small stars.

Edge cases: a null text counts as empty; texts without words have fingerprint zero and are linked like any other; copies
share a fingerprint and are one leaf; a null doc_id never is the smallest unless alone, and rows without an id are told apart by a hash of their text; an empty table gives an empty one.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh_name, stored

BITS, BUDGET = 64, 4
#: Where each trie's block starts and how many bits it has.
BLOCKS = ((0, 21), (21, 21), (42, 22))
#: Fingerprints in a cell at most (more where 4,096 cells a trie would not do), and bits by which prefixes grow.
CELL_MAX, CELLS_MOST, STEP = 8192, 4096, 2


# ---- fingerprints


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64).view(np.uint8)
        n = 1
    else:
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        starts = [0, *(gaps + 1).tolist()]
        ends = [*gaps.tolist(), len(joined)]
        digest = xxhash.xxh64_digest
        found = b"".join([digest(joined[s:e], seed) for s, e in zip(starts, ends[width - 1 :])])
        n = len(words) - width + 1
        hashes = np.frombuffer(found, ">u8").astype(np.uint64).view(np.uint8)
    ones = np.zeros(BITS, np.int64)
    table = hashes.reshape(n, 8)
    for at in range(0, n, 65_536):
        ones += np.unpackbits(table[at : at + 65_536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, keep: list[str], text_col: str = "text", name: str = "fp") -> DataFrame:
    """The columns in keep and the fingerprint as a signed 64-bit number."""
    bounded_batches(df.sparkSession)
    inner = fresh_name(keep, "_text")
    kept = df.select(*[f"`{c}`" for c in keep]).schema

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(x.as_py()) for x in batch.column(inner)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(found, pa.int64())], names=[*keep, name])

    return df.selectExpr(*[f"`{c}`" for c in keep], f"`{text_col}` AS `{inner}`").mapInArrow(run, kept.add(name, "long"))


# ---- one task: the walk over two subtrees


def rotated(fps: np.ndarray, by: int) -> np.ndarray:
    return fps if by % BITS == 0 else (fps << np.uint64(by)) | (fps >> np.uint64(BITS - by))


class Components:
    """Smallest index reachable from each index; batches of links at a time."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.changes = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up
        self.changes = np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])])

    def joined(self, a_low, a_high, b_low, b_high) -> np.ndarray:
        """Which pairs of ranges lie whole in one component."""
        return (self.changes[a_low] == self.changes[a_high - 1]) & (self.changes[b_low] == self.changes[b_high - 1]) & (self.label[a_low] == self.label[b_low])


def walk(fps: np.ndarray, ranges: tuple[int, int, int, int], depth: int, head: int, budget: int = BUDGET, head_budget: int = 1, block: int = 1 << 16) -> Components:
    """Links fingerprints (sorted, distinct) of range A with those of range B; both are subtrees at `depth`, or A = B."""
    parts = Components(len(fps))
    one = np.uint64(1)
    stack = [(depth, *[np.array([x]) for x in ranges])]
    while stack:
        d, a0, a1, b0, b1 = stack.pop()
        if len(a0) > block:
            for at in range(0, len(a0), block):
                stack.append((d, a0[at : at + block], a1[at : at + block], b0[at : at + block], b1[at : at + block]))
            continue
        apart = ~parts.joined(a0, a1, b0, b1)
        a0, a1, b0, b1 = a0[apart], a1[apart], b0[apart], b1[apart]
        if not len(a0):
            continue
        n = (a1 - a0) * (b1 - b0)
        small = (n <= 16) | (d >= BITS)
        if small.any():
            _leaves(fps, parts, a0[small], b0[small], (b1 - b0)[small], n[small], budget)
            big = ~small
            a0, a1, b0, b1 = a0[big], a1[big], b0[big], b1[big]
            if not len(a0):
                continue
        bit = np.uint64(BITS - 1 - d)
        low_a, low_b = fps[a0], fps[b0]
        am = np.searchsorted(fps, (low_a >> bit | one) << bit)
        bm = np.searchsorted(fps, (low_b >> bit | one) << bit)
        am, bm = np.clip(am, a0, a1), np.clip(bm, b0, b1)
        same = (a0 == b0) & (a1 == b1)
        children = []
        for x0, x1, y0, y1, ok in ((a0, am, b0, bm, None), (am, a1, bm, b1, None), (a0, am, bm, b1, None), (am, a1, b0, bm, ~same)):
            keep = (x0 < x1) & (y0 < y1)
            if ok is not None:
                keep &= ok
            children.append((x0[keep], x1[keep], y0[keep], y1[keep]))
        a0, a1, b0, b1 = (np.concatenate(x) for x in zip(*children))
        if not len(a0):
            continue
        d += 1
        diff = (fps[a0] ^ fps[b0]) >> np.uint64(BITS - d)
        ok = np.bitwise_count(diff) <= budget
        top = diff if d <= head else diff >> np.uint64(d - head)
        ok &= np.bitwise_count(top) <= head_budget
        stack.append((d, a0[ok], a1[ok], b0[ok], b1[ok]))
    return parts


def _leaves(fps, parts, a0, b0, width, n, budget, most: int = 1 << 20) -> None:
    """Compares the leaves of small node pairs."""
    ends = np.cumsum(n)
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most)))
        size = n[at:to]
        pair = np.repeat(np.arange(at, to), size)
        k = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        a, b = a0[pair] + k // width[pair], b0[pair] + k % width[pair]
        near = (np.bitwise_count(fps[a] ^ fps[b]) <= budget) & (a != b)
        if near.any():
            parts.add(a[near], b[near])
        at = to


# ---- the jobs


def _cells(spark, points: DataFrame, total: int) -> dict[int, list[tuple[int, int]]]:
    """trie -> sorted (prefix left-aligned, depth): subtrees that hold every fingerprint; counts of prefixes are all that reaches the driver."""
    most = max(CELL_MAX, total // CELLS_MOST)
    depth = 0
    while (total >> depth) * 1.0 > most * 0.75 and depth < BITS:
        depth += STEP
    done: dict[int, list[tuple[int, int]]] = {k: [] for k in range(len(BLOCKS))}
    rows = points
    while True:
        prefix = F.shiftrightunsigned("rot", BITS - depth) if depth else F.lit(0).cast("long")
        counted = rows.groupBy("trie", prefix.alias("prefix")).count().collect()
        heavy = []
        for trie, value, n in counted:
            if n > most and depth < BITS:
                heavy.append((trie, value))
            else:
                done[trie].append(((value << (BITS - depth)) % (1 << BITS) if depth else 0, depth))
        if not heavy:
            break
        wanted = spark.createDataFrame(heavy, "trie int, prefix long")
        rows = rows.withColumn("prefix", prefix).join(F.broadcast(wanted), ["trie", "prefix"], "left_semi").drop("prefix")
        depth += STEP
    return {k: sorted(v) for k, v in done.items()}


def _cell_pairs(cells: dict[int, list[tuple[int, int]]], budget: int) -> list[tuple[int, int, int]]:
    """(trie, cell, cell) of all pairs of cells within the budget, each with itself too."""
    out = []
    for trie, own in cells.items():
        head = BLOCKS[trie][1]
        start = np.array([x for x, _ in own], np.uint64)
        depth = np.array([d for _, d in own], np.uint64)
        for i in range(len(own)):
            common = np.minimum(depth[i:], depth[i])
            cut = np.uint64(BITS) - common
            diff = np.where(common == 0, np.uint64(0), (start[i:] ^ start[i]) >> np.minimum(cut, np.uint64(BITS - 1)))
            top = np.where(common > head, diff >> np.where(common > head, common - np.uint64(head), np.uint64(0)), diff)
            near = (np.bitwise_count(diff) <= budget) & (np.bitwise_count(top) <= 1)
            out += [(trie, i, i + int(j)) for j in np.flatnonzero(near)]
    return out


def trie_links(fps: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(a, b), a > b: links that join exactly the distinct fingerprints (column fp) whose distances, step by step, are within the budget."""
    spark = fps.sparkSession
    total = fps.count()
    # Rotation in Spark: the trie's block comes first.
    turned = [F.struct(F.lit(k).alias("trie"), (F.col("fp") if not by else F.shiftleft("fp", by).bitwiseOR(F.shiftrightunsigned("fp", BITS - by))).alias("rot")) for k, (by, _) in enumerate(BLOCKS)]
    points = fps.select(F.explode(F.array(*turned)).alias("p")).select("p.trie", "p.rot")
    cells = _cells(spark, points, total)
    pairs = _cell_pairs(cells, budget)
    tasks: dict[int, list[list[tuple[int, int]]]] = {k: [[] for _ in own] for k, own in cells.items()}
    meta = []
    for no, (trie, i, j) in enumerate(pairs):
        tasks[trie][i].append((no, 0))
        if i != j:
            tasks[trie][j].append((no, 1))
        meta.append((trie, cells[trie][i][1], cells[trie][j][1]))
    starts = {k: np.array([x for x, _ in own], np.uint64) for k, own in cells.items()}
    # Bounded by the number of cells (about 4,096 a trie) times the prefixes within the budget.
    flat = {k: np.array([x for mine in own for x in mine], np.int64).reshape(-1, 2) for k, own in tasks.items()}
    size = {k: np.array([len(mine) for mine in own], np.int64) for k, own in tasks.items()}
    plan = spark.sparkContext.broadcast((starts, flat, size, {k: np.cumsum(n) - n for k, n in size.items()}))

    def deal(batches):
        starts, flat, size, first = plan.value
        for pdf in batches:
            fp = pdf["fp"].to_numpy().view(np.uint64)
            for trie, (by, _) in enumerate(BLOCKS):
                rot = rotated(fp, by)
                cell = np.searchsorted(starts[trie], rot, side="right") - 1
                n = size[trie][cell]
                row = np.repeat(np.arange(len(rot)), n)
                at = first[trie][cell][row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                yield pd.DataFrame({"task": flat[trie][at, 0], "side": flat[trie][at, 1], "rot": rot.view(np.int64)[row]})

    shape = spark.sparkContext.broadcast(meta)

    def link(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        trie, depth_a, depth_b = shape.value[int(key[0])]
        by, head = BLOCKS[trie]
        rot, side = pdf["rot"].to_numpy().view(np.uint64), pdf["side"].to_numpy()
        two = (side == 1).any()
        a, b = np.sort(rot[side == 0]), np.sort(rot[side == 1])
        if two and not len(a):
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        every = np.concatenate([a, b])
        if two and len(b) and b[0] < a[0]:
            a, b = b, a
            every = np.concatenate([a, b])
        ranges = (0, len(a), len(a), len(every)) if two else (0, len(a), 0, len(a))
        parts = walk(every, ranges, min(depth_a, depth_b), head, budget)
        away = np.flatnonzero(parts.label != np.arange(len(every)))
        x, y = (rotated(every[i], BITS - by).view(np.int64) for i in (away, parts.label[away]))
        return pd.DataFrame({"a": np.maximum(x, y), "b": np.minimum(x, y)})

    dealt = fps.select("fp").mapInPandas(deal, "task int, side int, rot long")
    return dealt.groupBy("task").applyInPandas(link, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in links (a, b) but the roots themselves: root is the smallest node reachable. Alternates large and small stars until nothing moves."""
    links = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = ways.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        links = stored(small, "links")
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return links.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
        before = now


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id, mark, uid, keep_uid) of every row; mark is a hash of the text, keep_uid is the uid of the row that stands for its group (that of the smallest doc_id)."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("uid"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"), F.col(text_col).alias("_t"))
    rows = stored(fingerprints(named, ["doc_id", "uid", "mark"], "_t"), "fingerprints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("least")
    classes = stored(rows.groupBy("fp").agg(least), "classes")
    roots = stored(components(trie_links(classes.select("fp"))), "roots")
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least_of = rooted.groupBy("root").agg(F.min("least").alias("least"))
    found = rooted.select("fp", "root").join(least_of, "root").select("fp", F.col("least.doc_id").alias("component_id"), F.col("least.uid").alias("keep_uid"))
    return rows.join(found, "fp").select("doc_id", "fp", "component_id", "mark", "uid", "keep_uid")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stand for their group, with all their columns."""
    groups = stored(near_groups(docs, id_col, text_col), "near-groups")
    own_id, own_mark, repeats = (fresh_name(docs.columns, c) for c in ("_keep_id", "_keep_mark", "_repeats"))
    stay = groups.groupBy("doc_id", "mark").agg(F.max(F.col("uid") == F.col("keep_uid")).alias("stays"), F.count("*").alias(repeats)).filter("stays")
    stay = stored(stay.select(F.col("doc_id").alias(own_id), F.col("mark").alias(own_mark), repeats), "near-stay")
    columns = [f"`{c}`" for c in docs.columns]
    found = docs.join(stay, F.col(f"`{id_col}`").eqNullSafe(F.col(own_id)) & (F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))) == F.col(own_mark)))
    lone = F.col(repeats) == 1
    if stay.filter(~lone).isEmpty():
        return found.select(*columns)
    # Rows that repeat both id and text count once.
    more = found.filter(~lone).groupBy(own_id, own_mark).agg(F.first(F.struct(*columns)).alias("row"))
    return found.filter(lone).select(*columns).unionByName(more.select(*[F.col(f"row.`{c}`") for c in docs.columns]))
