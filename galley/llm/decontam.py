"""Benchmark decontamination with a distributed positional inverted index.

The index: one pass over the documents stores, per document, the positions of its words (runs of benchmark words only where a
vocabulary is given), and from these the postings (term, document, position). A search takes the rarest term of every window of a
benchmark item as its anchor, shifts the anchor's postings by its offset in the item so that equal starts mean one candidate
(document, item, start), and intersects these candidates with the positions of all other terms in the document: exact windows give
phrase matches, positions within a slop give proximity matches. All starts of a document are tested against one copy of its positions.
The postings of a term are dealt out over SALTS tasks, and items that very many documents may hold are joined by a broadcast.

A vocabulary is broadcast as a Bloom filter of fixed size, whatever its own size; a word that it wrongly lets through costs a position,
no match. A word can be part of a match only inside a run of benchmark words as long as the shortest window, so other positions need
not be stored.

Edge cases: nulls have no words (0 words, not contaminated); an item without words has no window; an item of fewer words than a window
is one window; repeated items count once by item_id, each repeated document has its own row; a null item_id is listed as an empty
string; empty tables (either one) give no hits; other columns are not returned by match_items.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bloom_filter, bounded_batches, fresh_name, in_bloom, join_hot, stored

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")  # of lower-cased UTF-8: code points outside ASCII and its letters and digits
WINDOW = 10
#: Starts times words of an item that are tested at once.
CELLS = 1 << 24
#: Tasks over which the postings of one term are dealt.
SALTS = 32
#: Words of which a worker remembers whether the filter holds them.
REMEMBERED = 500_000


def words(text: str | None) -> list[bytes]:
    return WORDS.findall((text or "").encode().lower())


def item_words(items: DataFrame, text_col: str = "text") -> DataFrame:
    """(item, item_id, terms): item numbers the rows."""

    def run(batches):
        for batch in batches:
            terms = [[w.decode() for w in words(x.as_py())] for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("item_id"), pa.array(terms, pa.list_(pa.string()))], names=["item", "item_id", "terms"])

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col(text_col).alias("text"))
    return stored(rows.mapInArrow(run, "item long, item_id string, terms array<string>").filter("size(terms) > 0"), "items")


class _Held(dict):
    """word -> whether the filter holds it."""

    def __init__(self, filter_words: np.ndarray):
        super().__init__()
        self.filter_words = filter_words

    def learn(self, found: list[bytes]) -> None:
        if len(self) > REMEMBERED:
            self.clear()
        new = [w for w in set(found) if w not in self]
        hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in new], np.uint64).view(np.int64)  # as xxhash64 of Spark
        self.update(zip(new, in_bloom(self.filter_words, hashes).tolist()))


def positional_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: DataFrame | None = None, least_run: int = 1) -> DataFrame:
    """(uid, doc_id, mark, n_words, positions, terms) per document, stored; mark is a hash of the text. With a vocabulary (column term) only runs of at least least_run of its words."""
    spark = docs.sparkSession
    bounded_batches(spark)
    known = None
    if vocabulary is not None:
        known = spark.sparkContext.broadcast(bloom_filter(vocabulary.distinct().select(F.xxhash64("term"))))

    def run(batches):
        held = None if known is None else _Held(known.value)
        for batch in batches:
            numbers, positions, terms = [], [], []
            for value in batch.column("text"):
                found = words(value.as_py())
                numbers.append(len(found))
                if known is None:
                    at = np.arange(len(found))
                else:
                    held.learn(found)
                    own = np.fromiter(map(held.__getitem__, found), np.int8, len(found))
                    edge = np.flatnonzero(np.diff(own, prepend=0, append=0))
                    runs = edge.reshape(-1, 2)
                    runs = runs[runs[:, 1] - runs[:, 0] >= least_run]
                    at = np.concatenate([np.arange(s, e) for s, e in runs]) if len(runs) else np.empty(0, np.int64)
                positions.append(at.astype(np.int32))
                terms.append([found[i].decode() for i in at])
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid"), batch.column("doc_id"), batch.column("mark"), pa.array(numbers, pa.int64()), pa.array(positions, pa.list_(pa.int32())), pa.array(terms, pa.list_(pa.string()))],
                names=["uid", "doc_id", "mark", "n_words", "positions", "terms"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    return stored(rows.mapInArrow(run, f"uid long, doc_id {kind}, mark long, n_words long, positions array<int>, terms array<string>"), "index")


def postings(index: DataFrame) -> DataFrame:
    """(term, uid, position)."""
    return index.select("uid", F.explode(F.arrays_zip("terms", "positions")).alias("p")).select(F.col("p.terms").alias("term"), "uid", F.col("p.positions").alias("position"))


def anchors(items: DataFrame, frequency: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, offset, term): the rarest term of each window of each item; windows with a term that no document has are left out."""
    spots = items.select("item", F.size("terms").alias("n"), F.posexplode("terms").alias("offset", "term")).join(frequency, "term", "left").withColumn("f", F.coalesce("f", F.lit(0)))
    width = F.least(F.col("n"), F.lit(window))
    starts = spots.select("item", "n", "offset", "term", "f", F.explode(F.sequence(F.greatest(F.lit(0), F.col("offset") - width + 1), F.least(F.col("offset"), F.col("n") - width))).alias("start"))
    rarest = starts.groupBy("item", "start").agg(F.min(F.struct("f", "offset", "term")).alias("m")).filter("m.f > 0")
    return rarest.select("item", F.col("m.offset").alias("offset"), F.col("m.term").alias("term")).distinct()


def match_items(index: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """(uid, item, start, from_offset, to_offset): each stretch of an item that a document holds, all of its windows found one after the other.

    With slop 0 word o of the item stands at start + o; else within slop of it (proximity).
    """
    stored_postings = stored(postings(index), "postings")
    vocabulary = items.select(F.explode("terms").alias("term")).distinct()
    frequency = stored(stored_postings.join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count("*").alias("f")), "frequency")
    anchor = stored(anchors(items, frequency, window), "anchors")
    salted = anchor.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = stored_postings.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int")).join(salted, ["term", "salt"])
    starts = stored(found.groupBy("uid", "item").agg(F.array_sort(F.collect_set(F.col("position") - F.col("offset"))).alias("starts")), "starts")
    wanted = join_hot(starts, items.select("item", F.col("terms").alias("wanted")), "item")
    asked = wanted.groupBy("uid").agg(F.collect_list(F.struct("item", "wanted", "starts")).alias("asked"))
    return asked.join(index.select("uid", "positions", "terms"), "uid").mapInArrow(_intersect(window, slop), "uid long, item long, start int, from_offset int, to_offset int")


def _intersect(window: int, slop: int):
    def stretches(where: dict[str, np.ndarray], wanted: list[str], starts: np.ndarray):
        """(start, from_offset, to_offset) of an item's words in a document whose terms stand at `where`."""
        hit = np.zeros((len(starts), len(wanted) + 2), np.int8)
        for o, term in enumerate(wanted):
            places = where.get(term)
            if places is not None:
                at = starts + o
                near = np.searchsorted(places, at - slop)  # the first place that isn't too far left
                hit[:, o + 1] = (near < len(places)) & (places[np.minimum(near, len(places) - 1)] <= at + slop)
        edge = np.diff(hit, axis=1)
        row, low = np.nonzero(edge == 1)
        high = np.nonzero(edge == -1)[1]
        long = high - low >= min(window, len(wanted))
        return starts[row[long]], low[long], high[long]

    def run(batches):
        for batch in batches:
            for uid, asked, positions, terms in zip(*[batch.column(c) for c in ("uid", "asked", "positions", "terms")], strict=True):
                coded = terms.values.dictionary_encode()
                code = coded.indices.to_numpy()
                order = np.argsort(code, kind="stable")  # positions ascend
                places = np.split(positions.values.to_numpy()[order], np.cumsum(np.bincount(code))[:-1])
                where = dict(zip(coded.dictionary.to_pylist(), places, strict=True))
                for one in asked.as_py():
                    starts, step = np.array(one["starts"], np.int64), max(1, CELLS // len(one["wanted"]))
                    for at in range(0, len(starts), step):
                        start, low, high = stretches(where, one["wanted"], starts[at : at + step])
                        columns = [pa.array([x] * len(start), pa.int64()) for x in (uid.as_py(), one["item"])] + [pa.array(c.astype(np.int32)) for c in (start, low, high)]
                        yield pa.RecordBatch.from_arrays(columns, names=["uid", "item", "start", "from_offset", "to_offset"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(uid, doc_id, mark, n_words, n_hit, n_items, items_sha256, contaminated) of every row of docs."""
    items = item_words(benchmark)
    least = items.agg(F.min(F.least(F.size("terms"), F.lit(window)))).first()[0] or window
    index = positional_index(docs, id_col, text_col, items.select(F.explode("terms").alias("term")), least)
    matches = match_items(index, items, window).join(items.select("item", "item_id"), "item")
    spans = matches.select("uid", "item_id", (F.col("start") + F.col("from_offset")).alias("low"), (F.col("start") + F.col("to_offset")).alias("high"))
    per = spans.groupBy("uid").agg(F.array_sort(F.collect_set(F.struct("low", "high"))).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"))
    # The length of the union of the sorted spans.
    union = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(-1).alias("to")), lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["high"] - F.greatest(x["low"], s["to"]))).alias("n"), F.greatest(s["to"], x["high"]).alias("to")), lambda s: s["n"])
    per = per.select("uid", union.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("listed"))
    rows = index.select("uid", "doc_id", "mark", "n_words").join(per, "uid", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.select(
        "uid", "doc_id", "mark", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("listed", F.lit("")).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )



def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no window of the benchmark, with all their columns."""
    own_id, own_mark = (fresh_name(docs.columns, c) for c in ("_hit_id", "_hit_mark"))
    hit = contamination(docs, benchmark, id_col, text_col).filter("contaminated").select(F.col("doc_id").alias(own_id), F.col("mark").alias(own_mark)).distinct()
    return docs.join(hit, F.col(f"`{id_col}`").eqNullSafe(F.col(own_id)) & (F.xxhash64(F.col(text_col)) == F.col(own_mark)), "left_anti")
