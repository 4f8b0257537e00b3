"""Exact deduplication: static binary-fuse filters per immutable snapshot, exact buckets, byte checks.

Each batch is first grouped by the SHA-256 of its normalised texts (A-Z lower-cased, UTF-8), so a text that a third of the
rows share is one row from here on. A snapshot is stored with its groups and one binary-fuse filter per digest bucket;
a later batch's groups meet the filters bucket by bucket, negatives are new texts, and only positives join the snapshot's
groups, where the bytes of both representatives are compared: only texts that a Bloom filter of fixed size lets through are moved
for that. Filters have no false negatives, so no copy is lost.

Edge cases: a null text counts as empty, so nulls and empty texts are copies of each other; of equal texts the row with the
largest doc_id stays (null is the smallest); of repeated rows with that doc_id exactly one stays; empty tables (either
side) give empty or unchanged results; rows without an id are told apart by a hash of their text; further columns are kept by exact_dedup, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bloom_filter, bounded_batches, fresh_name, in_bloom, join_hot, stored

#: Digests in one filter, on average at most; the number of buckets grows with the snapshot.
BUCKET_KEYS = 65_536


# ---- binary fuse filter: three slots in consecutive segments, one byte a slot


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys + np.uint64((seed * 0x9E3779B97F4A7C15 + 1) & (2**64 - 1))
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(33))


def _slots(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    h = _mix(keys, seed)
    first = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    slots = np.stack([(first + np.uint64(i)) * np.uint64(segment) + (_mix(h, i + 1) & mask) for i in range(3)])
    return slots.astype(np.int64), (h & np.uint64(255)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, segments, slots) of a set of 64-bit keys; slots are peeled round by round until every key has one of its own."""
    keys = np.unique(keys.astype(np.uint64))
    n = max(len(keys), 1)
    segment = 1 << max(2, int(np.log(n) / np.log(3.33) + 2.25))
    room = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    segments = max(1, int(np.ceil(n * room / segment)) - 2) + 1
    for seed in range(1, 1000):
        if seed % 20 == 0:
            segments += segments // 4 + 1
        size = (segments + 2) * segment
        slots, marks = _slots(keys, seed, segment, segments)
        degree = np.bincount(slots.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)
        for row in slots:
            np.bitwise_xor.at(owner, row, np.arange(len(keys)))
        rounds, left, single = [], len(keys), np.flatnonzero(degree == 1)
        while len(single):
            peeled, at = np.unique(owner[single], return_index=True)
            at = single[at]
            rounds.append((peeled, at))
            left -= len(peeled)
            touched = slots[:, peeled].ravel()
            np.subtract.at(degree, touched, 1)
            np.bitwise_xor.at(owner, touched, np.tile(peeled, 3))
            touched = np.unique(touched)
            single = touched[degree[touched] == 1]
        if left == 0:
            table = np.zeros(size, np.uint8)
            for peeled, at in reversed(rounds):
                three = slots[:, peeled]
                table[at] = 0
                table[at] = marks[peeled] ^ table[three[0]] ^ table[three[1]] ^ table[three[2]]
            return seed, segment, segments, table.tobytes()
    raise RuntimeError("no seed lets the filter be built")


def in_filter(keys: np.ndarray, seed: int, segment: int, segments: int, table: bytes) -> np.ndarray:
    slots, marks = _slots(keys.astype(np.uint64), seed, segment, segments)
    cells = np.frombuffer(table, np.uint8)
    return (cells[slots[0]] ^ cells[slots[1]] ^ cells[slots[2]]) == marks


# ---- the jobs


def normal(text: str | None) -> bytes:
    return (text or "").encode().lower()


def with_digest(df: DataFrame, text_col: str, name: str, keep: list[str]) -> DataFrame:
    """The columns in keep and the digest (32 bytes) of the normalised text."""
    bounded_batches(df.sparkSession)
    inner = fresh_name(keep, "_text")
    schema = T.StructType([*df.select(*[f"`{c}`" for c in keep]).schema.fields, T.StructField(name, T.BinaryType())])

    def run(batches):
        for batch in batches:
            digests = [hashlib.sha256(normal(x.as_py())).digest() for x in batch.column(inner)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(digests, pa.binary())], names=[*keep, name])

    return df.selectExpr(*[f"`{c}`" for c in keep], f"`{text_col}` AS `{inner}`").mapInArrow(run, schema)


def _key_of(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(d[8:16] for d in digests), ">u8").astype(np.uint64)


def groups_of(rows: DataFrame) -> DataFrame:
    """(digest, n, top) of rows (id, uid, mark, digest): top is the (id, uid, mark) that stays."""
    return rows.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("id", "uid", "mark")).alias("top"))


def snapshot_filters(groups: DataFrame, buckets: int) -> DataFrame:
    """(bucket, seed, segment, segments, slots), one filter per bucket of the snapshot's digests."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        made = build_filter(_key_of(pdf["digest"]))
        return pd.DataFrame([(int(pdf["bucket"].iloc[0]), *made)], columns=["bucket", "seed", "segment", "segments", "slots"])

    return groups.select("digest", bucket_of(buckets)).groupBy("bucket").applyInPandas(build, "bucket int, seed int, segment int, segments int, slots binary")


def bucket_of(buckets: int):
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int").alias("bucket")


def screened(groups: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The groups that the snapshot may hold: bucket by bucket, against that bucket's filter."""

    def screen(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(theirs):
            return mine.iloc[:0][["digest"]]
        f = theirs.iloc[0]
        hit = in_filter(_key_of(mine["digest"]), int(f["seed"]), int(f["segment"]), int(f["segments"]), f["slots"])
        return mine[hit][["digest"]]

    return groups.select("digest", bucket_of(buckets)).groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(screen, "digest binary")


def mark_of(text_col: str):
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


def among(df: DataFrame, marks: DataFrame, mark: str) -> DataFrame:
    """The rows of df whose column mark may be among marks (one column of 64-bit hashes), by a filter of fixed size."""
    words = df.sparkSession.sparkContext.broadcast(bloom_filter(marks))

    @F.pandas_udf("boolean")
    def may(hashes: pd.Series) -> pd.Series:
        return pd.Series(in_bloom(words.value, hashes.to_numpy()))

    return df.filter(may(mark))


def checked_copies(positives: DataFrame, old: DataFrame, new: DataFrame, texts: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Digests of positives in both old and new whose representatives agree byte by byte."""
    both = positives.join(old.select("digest", F.col("top").alias("old_top")), "digest").join(new.select("digest", F.col("top").alias("new_top")), "digest")
    wanted = stored(both.select("digest", F.posexplode(F.array("old_top", "new_top")).alias("_side", "_top")), "exact-wanted")
    told = texts.select(F.col(f"`{id_col}`").alias("_doc"), mark_of(text_col).alias("_mark"), F.col(f"`{text_col}`").alias("_text"))
    found = wanted.join(among(told, wanted.select("_top.mark"), "_mark"), F.col("_top.id").eqNullSafe(F.col("_doc")) & (F.col("_top.mark") == F.col("_mark")))
    found = with_digest(found.select("digest", "_side", "_text"), "_text", "_own", ["digest", "_side", "_text"]).filter("digest = _own")
    body = F.translate(F.coalesce("_text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    side = found.groupBy("digest", "_side").agg(F.min(body).alias("body"))
    return side.groupBy("digest").agg(F.min("body").alias("low"), F.max("body").alias("high"), F.count("*").alias("sides")).filter("sides = 2 AND low = high").select("digest")


def known_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 2) -> tuple[DataFrame, DataFrame]:
    """Rows (id, uid, mark, digest, batch) and groups (digest, n, top) of docs, taken in as `batches` immutable snapshots one after the other.

    The batch of a row is a hash of its id: all rows belong to some batch. uid tells repeated rows apart.
    """
    named = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("uid"), mark_of(text_col).alias("mark"), F.col(text_col).alias("_t"))
    rows = with_digest(named, "_t", "digest", ["id", "uid", "mark"]).withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int"))
    rows = stored(rows, "exact-rows")
    known = None
    for batch in range(batches):
        new = stored(groups_of(rows.filter(F.col("batch") == batch)), "exact-batch")
        if known is None:
            known = new
            continue
        buckets = max(1, -(-known.count() // BUCKET_KEYS))
        filters = stored(snapshot_filters(known, buckets), "exact-filters")
        positives = screened(new, filters, buckets)
        copies = stored(checked_copies(positives, known, new, docs, text_col, id_col), "exact-copies")
        grown = known.join(new.join(copies, "digest", "left_semi").select("digest", F.col("n").alias("more"), F.col("top").alias("newer")), "digest", "left")
        grown = grown.select("digest", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.greatest("top", "newer").alias("top"))
        known = stored(grown.unionByName(new.join(copies, "digest", "left_anti")), "exact-known")
    return rows, known


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 2) -> DataFrame:
    """(id, uid, digest, keep_id, keep_uid, group_size) of every row of docs."""
    rows, known = known_groups(docs, id_col, text_col, batches)
    return join_hot(rows, known, "digest").select("id", "uid", "digest", F.col("top.id").alias("keep_id"), F.col("top.uid").alias("keep_uid"), F.col("n").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each group of equal texts."""
    rows, known = known_groups(docs, id_col, text_col)
    own_id, own_mark, repeats = (fresh_name(docs.columns, c) for c in ("_keep_id", "_keep_mark", "_repeats"))
    # The groups say which (id, mark) stays; how often it stands there is counted by both, so that no group meets in one task.
    stay = known.select(F.col("top.id").alias(own_id), F.col("top.mark").alias(own_mark))
    again = rows.groupBy("id", "mark").agg(F.count("*").alias(repeats)).filter(F.col(repeats) > 1)
    stay = stay.join(again, F.col(own_id).eqNullSafe(F.col("id")) & (F.col(own_mark) == F.col("mark")), "left")
    stay = stored(stay.select(own_id, own_mark, F.coalesce(repeats, F.lit(1)).alias(repeats)), "exact-stay")
    found = docs.join(stay, F.col(f"`{id_col}`").eqNullSafe(F.col(own_id)) & (mark_of(text_col) == F.col(own_mark)))
    columns = [f"`{c}`" for c in docs.columns]
    once = found.filter(F.col(repeats) == 1).select(*columns)
    if stay.filter(F.col(repeats) > 1).isEmpty():
        return once
    # Repeated rows: the same id and the same text, so any of them is the one that stays.
    more = found.filter(F.col(repeats) > 1).groupBy(own_id, own_mark).agg(F.first(F.struct(*columns)).alias("row"))
    return once.unionByName(more.select(*[F.col(f"row.`{c}`") for c in docs.columns]))
