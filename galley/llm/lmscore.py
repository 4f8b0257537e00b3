"""Language-model scores by cross-entropy difference.

A target model (bigrams of the documents chosen as target) and a background model (bigrams of all documents) are matched: same
tokens, one shared vocabulary (every token of the documents), same order, same smoothing. A document's score is the mean over its
predictions (its tokens and its end) of the background loss minus the target loss, so that higher means more like the target.

Smoothing: p(w | v) = (c(v, w) + K p(w)) / (c(v) + K) with p(w) = (c(w) + 1) / (N + V + 1). Its logarithm is the sum of

    -log(N + V + 1),  log(c(w) + 1),  -log(1 + c(v) / K)  and  log(1 + c(v, w) / (K p(w))),

whose last three are 0 for what was never counted. Every token and every bigram counts, however rare.

The jobs, each one pass over the texts:

1. Counts of all tokens, and bigrams that are frequent in some stretch of `BUFFER` tokens.
2. Bigrams. The `SHARED` most frequent ones, which would be hot keys, are counted before they are moved. All others are moved once to
   the part of their key with the documents that they stand in; a part counts its bigrams in both models and at once replies to each
   stretch of documents with what they add beyond what a bigram that stands nowhere else would add. A bigram that is not shared stands at most so often: `HEAVY` times
   in any `BUFFER` tokens, or less often than `SHARED` others. Rare tokens (not among the `NUMBERED` ones) go the same way.
3. Scores: the shared bigrams and numbered tokens by broadcast tables of fixed size, others as if they stood nowhere else, and the replies.

Which documents are chosen is told by a Bloom filter of fixed size and the list of the documents it wrongly lets through; where that
list is longer than `WRONG_MOST`, by a join that moves the texts. Either way the marks are exact.

Tokens and bigrams are known by 64-bit hashes, made for all characters of many texts at once. Documents are known by the hashes of id and text, so equal rows are one key.

Edge cases: a null text counts as empty; no tokens: losses null, score 0; a null id is never chosen; a corpus without chosen documents
gives the target model its uniform prior; equal rows score alike; an empty table gives an empty one; clashing names don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLOOM_BITS, bloom_filter, bounded_batches, in_bloom, stored

TOKENS = re.compile(r"\w+|[^\w\s]")
STRENGTH = 8.0
NUMBERED, SHARED, HEAVY = 1 << 17, 1 << 19, 32
#: Tokens and documents held at once, characters hashed at once, tokens of the corpus for each part, and parts at least.
BUFFER, BUFFER_DOCS, CHARS, PART_TOKENS, PARTS_LEAST = 2_000_000, 30_000, 500_000, 4_000_000, 16
#: Ids that the filter wrongly lets through and that are listed, at most.
WRONG_MOST = 1 << 20
#: The start and the end of a document, as context and as what is predicted.
EDGE = np.uint64(0x5851F42D4C957F2D)
SLICE = 1 << 16
#: A number of a document in its stretch has this bit where the document is chosen.
CHOSEN = 1 << 15
DOCS, HOT, TOKEN, PAIR, RARE, REPLY = range(6)


def tokens(text: str | None) -> list[str]:
    return TOKENS.findall((text or "").lower())


SPACE, WORD, MARK = range(3)
_NOT_WORD = re.compile(r"\W")
_FACTOR = 0x9E3779B97F4A7C15
_MADE: dict = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point its class and a random number; made once in a process."""
    if not _MADE:
        every = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype("<u4")
        text, kinds = every.tobytes().decode("utf-32-le"), np.full(0x110000, SPACE, np.uint8)
        for pattern, kind in ((r"\w", WORD), (r"[^\w\s]", MARK)):
            kinds[every[[m.start() for m in re.finditer(pattern, text)]]] = kind
        _MADE["tables"] = kinds, np.random.default_rng(1).integers(0, 1 << 64, 0x110000, np.uint64)
    return _MADE["tables"]


def _powers(n: int, factor: int) -> np.ndarray:
    if len(_MADE.get(factor, ())) < n:
        _MADE[factor] = np.cumprod(np.concatenate(([np.uint64(1)], np.full(max(n, CHARS), np.uint64(factor)))), dtype=np.uint64)
    return _MADE[factor][:n]


def _hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens of the texts, and how many tokens each text has.

    A token's hash is the sum of its characters' numbers times powers of a factor, from differences of one running sum.
    """
    kinds, numbers = _tables()
    lengths = np.array([len(x) + 1 for x in texts])
    chars = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "replace"), np.uint32)
    kind = kinds[chars]
    word = kind == WORD
    before = np.concatenate(([False], word[:-1]))
    first = np.flatnonzero((kind == MARK) | word & ~before)
    # A word ends before the next character that is none; a mark is one character. White space ends every text.
    stops = np.flatnonzero(~word)
    last = np.where(kind[first] == MARK, first + 1, stops[np.minimum(np.searchsorted(stops, first), len(stops) - 1)])
    sums = np.concatenate(([np.uint64(0)], np.cumsum(numbers[chars] * _powers(len(chars), _FACTOR), dtype=np.uint64)))
    found = (sums[last] - sums[first]) * _powers(len(chars), pow(_FACTOR, -1, 1 << 64))[first]
    found = (found ^ (found >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    ends = np.cumsum(lengths)
    return found ^ (found >> np.uint64(32)), np.diff(np.searchsorted(first, ends), prepend=0)


def coded(texts: list[str | None]) -> list[np.ndarray]:
    """The hashes of each text's tokens; a long text is cut where a token can't reach over the cut."""
    pieces, owner = [], []
    for i, text in enumerate(texts):
        text, at = (text or "").lower(), 0
        while len(text) - at > CHARS and (cut := _NOT_WORD.search(text, at + CHARS)):
            pieces.append(text[at : cut.start()])
            owner.append(i)
            at = cut.start()
        pieces.append(text[at:])
        owner.append(i)
    out: list[list[np.ndarray]] = [[] for _ in texts]
    at = 0
    while at < len(pieces):
        to, held = at + 1, len(pieces[at])
        while to < len(pieces) and held + len(pieces[to]) <= CHARS:
            held += len(pieces[to])
            to += 1
        found, sizes = _hashed(pieces[at:to])
        for i, part in zip(owner[at:to], np.split(found, np.cumsum(sizes)[:-1])):
            out[i].append(part)
        at = to
    return [np.concatenate(x) if len(x) > 1 else x[0] for x in out]


def _pairs(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(v, w, number of the document) of all bigrams of documents that have tokens."""
    sizes = np.array([len(p) + 1 for p in parts])
    ends, flat = np.cumsum(sizes), np.concatenate(parts)
    inner = np.ones(ends[-1], bool)
    v, w = np.full(len(inner), EDGE), np.full(len(inner), EDGE)
    inner[ends - 1] = False
    w[inner] = flat
    inner[ends - 1], inner[ends - sizes] = True, False
    v[inner] = flat
    return v, w, np.repeat(np.arange(len(parts)), sizes)


def _keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = v * np.uint64(0x9E3779B97F4A7C15) + w
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Lookup:
    """Finds keys in a sorted table: the top bits say where to look."""

    def __init__(self, table: np.ndarray):
        self.table, self.shift = table, np.uint64(64 - max(1, len(table)).bit_length() - 1)
        self.starts = np.searchsorted(table >> self.shift, np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64))

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where keys stand in the table, and whether they do."""
        at, found = np.zeros(len(keys), np.int32), np.zeros(len(keys), bool)
        bucket = (keys >> self.shift).astype(np.int64)
        low, high = self.starts[bucket], self.starts[bucket + 1]
        left = np.flatnonzero(low < high)
        while len(left):
            spot = low[left]
            here = self.table[spot] == keys[left]
            at[left[here]], found[left[here]] = spot[here], True
            left = left[~here]
            low[left] += 1
            left = left[low[left] < high[left]]
        return at, found


def _planes(values: np.ndarray, kind: type) -> bytes:
    """The bytes of values, the lowest ones first, then the next ones: high bytes are mostly zero and compress to nothing."""
    return np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(len(values), -1).T).tobytes()


def _whole(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


# ---- which documents are chosen


class Chosen(NamedTuple):
    docs: DataFrame  # with the columns kept, mark, mate (hashes of id and text; mark 0: no id), text and, after a join, target
    flags: Callable[[pa.RecordBatch], np.ndarray]


def _let_through(words, wrong, marks: np.ndarray) -> np.ndarray:
    return (marks != 0) & in_bloom(words, marks) & ~wrong(marks.view(np.uint64))[1]


def with_marks(docs: DataFrame, chosen: DataFrame, keep: list[str], id_col: str, text_col: str) -> Chosen:
    spark = docs.sparkSession
    key, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    mark = F.when(key.isNull(), 0).otherwise(F.xxhash64(key))
    kind = docs.select(key).schema[0].dataType
    ids = chosen.select(F.col(f"`{id_col}`").cast(kind).alias("chosen")).filter("chosen IS NOT NULL").distinct()
    words = bloom_filter(ids.select(F.xxhash64("chosen")), BLOOM_BITS)
    sent = spark.sparkContext.broadcast(words)

    def suspects(batches):
        for batch in batches:
            yield batch.filter(pa.array(_let_through(sent.value, Lookup(np.empty(0, np.uint64)), batch.column("mark").to_numpy())))

    told = docs.select(key.alias("chosen"), mark.alias("mark"))
    wrong = told.mapInArrow(suspects, told.schema).join(ids, "chosen", "left_anti").select("mark").distinct().limit(WRONG_MOST + 1).toPandas()["mark"].to_numpy()
    base = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), mark.alias("mark"), F.xxhash64(text).alias("mate"), text.alias("text")]
    if len(wrong) > WRONG_MOST:
        joined = docs.select(key.alias("chosen"), *base).join(ids.withColumn("target", F.lit(True)).hint("merge"), "chosen", "left").drop("chosen")
        joined = joined.sortWithinPartitions("mark", "mate")  # rows arrive from a shuffle in any order: a task that runs again must deal the same stretches
        return Chosen(joined, lambda batch: batch.column("target").fill_null(False).to_numpy(zero_copy_only=False))
    listed = spark.sparkContext.broadcast(Lookup(np.sort(wrong.astype(np.int64).view(np.uint64))))
    return Chosen(docs.select(*base), lambda batch: _let_through(sent.value, listed.value, batch.column("mark").to_numpy()))


class Stretch(NamedTuple):
    """Documents with tokens, as many as are held at once."""

    parts: list[np.ndarray]
    chosen: np.ndarray
    marks: np.ndarray
    mates: np.ndarray


def _stretches(batches, flags, limits: tuple[int, int]) -> Iterator[Stretch]:
    parts, rows, held = [], [], 0
    made = lambda: Stretch(parts, *(np.array(x) for x in zip(*rows)))
    for batch in batches:
        marks, mates = (batch.column(c).to_numpy() for c in ("mark", "mate"))
        for part, *row in zip(coded(batch.column("text").to_pylist()), flags(batch), marks, mates):
            if not len(part):
                continue
            parts.append(part)
            rows.append(row)
            held += len(part)
            if held > limits[0] or len(parts) == limits[1]:
                yield made()
                parts, rows, held = [], [], 0
    if parts:
        yield made()


# ---- 1: tokens and frequent bigrams


def token_counts(marked: Chosen) -> DataFrame:
    """(pair, key, background, target): all tokens (pair false), and bigrams (pair true, target 0) with the occurrences of those stretches where they are frequent."""
    flags, limits = marked.flags, (BUFFER, BUFFER_DOCS)

    def run(batches):
        for held in _stretches(batches, flags, limits):
            v, w, doc = _pairs(held.parts)
            key, n = np.unique(w, return_counts=True)
            mine, hits = np.unique(w[held.chosen[doc]], return_counts=True)
            hit = np.zeros(len(key), np.int64)
            hit[np.searchsorted(key, mine)] = hits
            pair, m = np.unique(_keys(v, w), return_counts=True)
            pair, m = pair[m >= HEAVY], m[m >= HEAVY]
            columns = (np.repeat([False, True], [len(key), len(pair)]), np.concatenate((key, pair)).view(np.int64), np.concatenate((n, m)), np.concatenate((hit, 0 * m)))
            for low in range(0, len(columns[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[low : low + 100_000]) for c in columns], names=["pair", "key", "background", "target"])

    part = marked.docs.drop("kept").mapInArrow(run, "pair boolean, key long, background long, target long")
    return part.groupBy("pair", "key").agg(F.sum("background").alias("background"), F.sum("target").alias("target"))


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """Rows with at least such a background count as `most` rows at most have, by a histogram of sixteen steps a doubling."""
    step = F.floor(F.log2("background") * 16)
    above, least = 0, 1
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("rows"), F.max("background").alias("most")).collect(), key=lambda r: -r["step"]):
        above += r["rows"]
        if above > most:
            least = r["most"] + 1
            break
    return counts.filter(F.col("background") >= least)


class Model(NamedTuple):
    """What every task gets, of a size that NUMBERED and SHARED fix."""

    known: Lookup  # hashes of the numbered tokens
    counts: np.ndarray  # 2 x known: their counts in background and target
    shared: Lookup  # keys of the shared bigrams
    totals: tuple[int, int]  # N + V + 1 of background and target
    strength: float

    def priors(self, i: int, count: np.ndarray) -> np.ndarray:
        return (count + 1) / self.totals[i]

    def token_weight(self, count: np.ndarray) -> np.ndarray:
        """What a token adds, as what is predicted and as context."""
        return np.log1p(count) - np.log1p(count / self.strength)

    def pair_weight(self, count: np.ndarray | int, prior: np.ndarray) -> np.ndarray:
        return np.log1p(count / (self.strength * prior))


def fit_tokens(marked: Chosen, strength: float) -> tuple[Model, int]:
    """The model without the counts of shared bigrams, and the number of parts for the others."""
    counted = stored(token_counts(marked), "lm-tokens")
    words = counted.filter("NOT pair")
    size, *sums = words.agg(F.count("*"), F.coalesce(F.sum("background"), F.lit(0)), F.coalesce(F.sum("target"), F.lit(0))).first()
    edge = F.col("key") == F.lit(int(EDGE.view(np.int64)))
    numbered = most_frequent(words.filter(~edge), NUMBERED).unionByName(words.filter(edge)).toPandas()
    shared = most_frequent(counted.filter("pair"), SHARED).select("key").toPandas()
    hashes = numbered["key"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    counts = numbered[["background", "target"]].to_numpy().astype(np.int64).T[:, order]
    model = Model(Lookup(hashes[order]), counts, Lookup(np.sort(shared["key"].to_numpy().astype(np.int64).view(np.uint64))), tuple(n + size + 1 for n in sums), strength)
    return model, max(PARTS_LEAST, sums[0] // PART_TOKENS)


# ---- 2: bigrams, counted and replied to


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    """Parts are ranges of keys."""
    return (((key >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _moved(kind: int, parts: int, part, key, doc, prior, prior_kind):
    """(part, kind, keys, seen, prior, docs) of each part: its distinct keys, how often each stands there and in which documents."""
    if not len(key):
        return
    order = np.argsort(key) if part is None else np.lexsort((key, part))
    part = _part(key, parts) if part is None else part
    part, key, doc, prior = (x[order] for x in (part, key, doc, prior))
    first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (part[1:] != part[:-1]))))
    ends = np.append(first[1:], len(key))
    cuts = np.searchsorted(part[first], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cuts)):
        own = slice(cuts[p], cuts[p + 1])
        at = first[own]
        yield int(p), kind, _planes(np.diff(key[at], prepend=np.uint64(0)), np.uint64), _planes(ends[own] - at, np.uint32), _planes(prior[at], prior_kind), _planes(doc[at[0] : ends[own][-1]], np.uint16)


def moved_grams(marked: Chosen, model, parts: int) -> DataFrame:
    flags, limits, names = marked.flags, (BUFFER, BUFFER_DOCS), ["part", "kind", "keys", "seen", "prior", "docs"]

    def rows_of(held: Stretch):
        m: Model = model.value
        v, w, doc = _pairs(held.parts)
        chosen, key = held.chosen[doc], _keys(v, w)
        number, known = m.known(w)
        at, hot = m.shared(key)
        hot &= known
        seen, hit = (np.bincount(at[x], minlength=len(m.shared.table)) for x in (hot, hot & chosen))
        for low in range(0, len(seen), SLICE):
            here = np.flatnonzero(seen[low : low + SLICE])
            if len(here):
                yield -1 - low // SLICE, HOT, _planes(here, np.uint16), _planes(seen[low + here], np.uint32), _planes(hit[low + here], np.uint32), b""
        doc = (doc | chosen * CHOSEN).astype(np.uint16)
        del v, at, chosen
        own = ~hot & known
        yield from _moved(PAIR, parts, None, key[own], doc[own], number[own], np.uint32)
        # Bigrams that end in a rare token go where its own counts are.
        key, w, doc = key[~known], w[~known], doc[~known]
        yield from _moved(RARE, parts, _part(w, parts), key, doc, w, np.uint64)
        yield from _moved(TOKEN, parts, None, w, doc, w, np.uint64)
        yield int(held.mates.view(np.uint64)[0] % np.uint64(parts)), DOCS, held.marks.astype(np.int64).tobytes(), held.mates.astype(np.int64).tobytes(), b"", b""

    def run(batches):
        partition, no = None, 0

        def watched():
            nonlocal partition
            for batch in batches:
                if partition is None and len(batch):
                    partition = batch.column("partition")[0].as_py()
                yield batch

        for held in _stretches(watched(), flags, limits):
            columns = list(zip(*rows_of(held)))
            no += 1
            kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 4
            yield pa.RecordBatch.from_arrays([pa.array([(partition << 32) + no] * len(columns[0]), pa.int64()), *map(pa.array, columns, kinds)], names=["stretch", *names])

    told = marked.docs.drop("kept").withColumn("partition", F.spark_partition_id().cast("long"))
    return told.mapInArrow(run, "stretch long, part int, kind int, keys binary, seen binary, prior binary, docs binary")


def _counted_part(model, most_docs: int):
    """One part: counts of its bigrams and tokens in both models, and what they add to the documents of each stretch."""
    names = ["stretch", "kind", "docs", "background", "target"]

    def out(rows) -> pa.Table:
        columns = list(zip(*rows)) or [[]] * 5
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=names)

    def run(table: pa.Table) -> pa.Table:
        m: Model = model.value
        part, rows = table.column("part")[0].as_py(), table.drop_columns(["part"]).to_pydict()
        rows = list(zip(*(rows[c] for c in ("stretch", "kind", "keys", "seen", "prior", "docs"))))
        if part < 0:
            sums = np.zeros((2, SLICE), np.int64)
            for _, _, keys, *counts, _ in rows:
                for i in (0, 1):
                    sums[i, _whole(keys, np.uint16)] += _whole(counts[i], np.uint32)
            return out([(-1 - part, HOT, b"", sums[0].tobytes(), sums[1].tobytes())])
        done = [(stretch, DOCS, keys, seen, b"") for stretch, kind, keys, seen, _, _ in rows if kind == DOCS]
        replies: dict[int, np.ndarray] = {}
        words = np.empty(0, np.uint64), np.empty((2, 0))
        for kind in (TOKEN, PAIR, RARE):
            own = [r for r in rows if r[1] == kind]
            if not own:
                continue
            # Sums of 64-bit deltas give the keys back, in each row from its own start.
            keys, at = np.unique(np.concatenate([np.cumsum(_whole(r[2], np.uint64), dtype=np.uint64) for r in own]), return_inverse=True)
            seen, docs = [_whole(r[3], np.uint32) for r in own], [_whole(r[5], np.uint16) for r in own]
            hit = [np.add.reduceat(d // CHOSEN, np.cumsum(n, dtype=np.int64) - n, dtype=np.int64) for d, n in zip(docs, seen)]
            sums = np.stack([np.bincount(at, np.concatenate(x), len(keys)) for x in (seen, hit)])
            lone = [np.zeros(len(keys))] * 2  # what pass 3 adds by itself
            if kind == TOKEN:
                words, weights = (keys, sums), [m.token_weight(c) for c in sums]
            else:
                prior = np.zeros(len(keys), np.uint64)
                prior[at] = np.concatenate([_whole(r[4], np.uint32 if kind == PAIR else np.uint64) for r in own])
                counts = m.counts[:, prior.astype(np.int64)] if kind == PAIR else words[1][:, np.searchsorted(words[0], prior)]
                priors = [m.priors(i, counts[i]) for i in (0, 1)]
                weights = [m.pair_weight(c, p) for c, p in zip(sums, priors)]
                if kind == PAIR:
                    lone = [m.pair_weight(1, p) for p in priors]
            low = 0
            for r, n, d in zip(own, seen, docs):
                mine = np.repeat(at[low : low + len(n)], n)
                low += len(n)
                reply = replies.setdefault(r[0], np.zeros((2, most_docs)))
                for i, alone in ((0, 1), (1, d // CHOSEN)):
                    reply[i] += np.bincount(d % CHOSEN, weights[i][mine] - lone[i][mine] * alone, most_docs)
        for stretch, reply in replies.items():
            docs = np.flatnonzero(reply.any(axis=0))
            if len(docs):
                done.append((stretch, REPLY, _planes(docs, np.uint16), *(reply[i, docs].astype(np.float32).tobytes() for i in (0, 1))))
        return out(done)

    return run


def _summed_stretch(most_docs: int):
    def run(table: pa.Table) -> pa.Table:
        """(mark, mate, background, target) of the documents of one stretch."""
        rows, sums = table.to_pydict(), np.zeros((2, most_docs))
        marks = mates = np.empty(0, np.int64)
        for kind, docs, *added in zip(*(rows[c] for c in ("kind", "docs", "background", "target"))):
            if kind == DOCS:
                marks, mates = np.frombuffer(docs, np.int64), np.frombuffer(added[0], np.int64)
            else:
                for i in (0, 1):
                    sums[i, _whole(docs, np.uint16)] += np.frombuffer(added[i], np.float32)
        return pa.table([marks, mates, *(s[: len(marks)] for s in sums)], names=["mark", "mate", "background", "target"])

    return run


# ---- 3: scores


def lm_scores(docs: DataFrame, chosen: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", strength: float = STRENGTH) -> DataFrame:
    """The columns in keep, n_tokens, target_loss and background_loss (nats a prediction) and score of every document, by models of all documents and of those whose id is in chosen."""
    spark = docs.sparkSession
    bounded_batches(spark)
    marked = with_marks(docs, chosen, keep, id_col, text_col)
    fitted, parts = fit_tokens(marked, strength)
    model = spark.sparkContext.broadcast(fitted)
    # As many tasks as parts: a task never sorts many of them.
    counted = moved_grams(marked, model, parts).repartition(parts, "part").groupBy("part").applyInArrow(_counted_part(model, BUFFER_DOCS), "stretch long, kind int, docs binary, background binary, target binary")
    counted = stored(counted, "lm-counted")
    hot = np.zeros((2, -(-len(fitted.shared.table) // SLICE) * SLICE), np.int64)
    for r in counted.filter(F.col("kind") == HOT).collect():  # SHARED / SLICE rows at most
        at = slice(r["stretch"] * SLICE, (r["stretch"] + 1) * SLICE)
        hot[:, at] = [np.frombuffer(r[c], np.int64) for c in ("background", "target")]
    shared = spark.sparkContext.broadcast(hot)
    sums = counted.filter(F.col("kind") != HOT).groupBy("stretch").applyInArrow(_summed_stretch(BUFFER_DOCS), "mark long, mate long, background double, target double")
    # Equal rows share a key: each of them is owed its share of the sum.
    sums = sums.groupBy("mark", "mate").agg(F.count("*").alias("rows"), *[F.sum(c).alias(f"rare_{c}") for c in ("background", "target")])
    flags, schema = marked.flags, T.StructType([marked.docs.schema["kept"], *[T.StructField(c, T.LongType()) for c in ("mark", "mate", "n_tokens")], *[T.StructField(c, T.DoubleType()) for c in ("background", "target")]])

    def run(batches):
        m, counts = model.value, shared.value
        singles = [m.token_weight(c) for c in m.counts]
        priors = [m.priors(i, m.counts[i]) for i in (0, 1)]
        for batch in batches:
            parts = coded(batch.column("text").to_pylist())
            some, marks = [i for i, p in enumerate(parts) if len(p)], flags(batch)
            added = np.zeros((2, len(parts)))
            for low in range(0, len(some), 256):
                rows = np.array(some[low : low + 256])
                v, w, doc = _pairs([parts[i] for i in rows])
                number, known = m.known(w)
                at, found = m.shared(_keys(v, w))
                found &= known
                number, doc = number[known], doc[known]
                at, found = at[known], found[known]
                for i, alone in ((0, 1), (1, marks[rows][doc])):
                    # What isn't shared counts as if it stood nowhere else; the replies hold what is missing then.
                    count = np.where(found, counts[i, at], alone) if len(m.shared.table) else np.broadcast_to(alone, len(doc))
                    added[i, rows] = np.bincount(doc, singles[i][number] + m.pair_weight(count, priors[i][number]), len(rows))
            columns = [*(batch.column(c) for c in ("kept", "mark", "mate")), pa.array([len(p) for p in parts], pa.int64()), *map(pa.array, added)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    renamed = sums.withColumnsRenamed({"mark": "sum_mark", "mate": "sum_mate"})
    both = marked.docs.mapInArrow(run, schema).join(renamed, (F.col("mark") == F.col("sum_mark")) & (F.col("mate") == F.col("sum_mate")), "left")
    losses = {}
    for c, total in zip(("background", "target"), fitted.totals):
        logs = F.col(c) + F.coalesce(F.col(f"rare_{c}") / F.col("rows"), F.lit(0.0))
        losses[c] = F.when(F.col("n_tokens") > 0, F.lit(float(np.log(total))) - logs / (F.col("n_tokens") + 1))
    done = both.select("kept", "n_tokens", losses["target"].alias("target_loss"), losses["background"].alias("background_loss"))
    return done.select(*[F.col(f"kept.`{c}`").alias(c) for c in keep], "n_tokens", "target_loss", "background_loss", F.coalesce(F.col("background_loss") - F.col("target_loss"), F.lit(0.0)).alias("score"))
