"""Divergence of sources: how far apart the term shares of the sources of a language are, priced on hash-consed segment trees.

The kept terms of a language are dealt out by hash to blocks, of about BLOCK_TERMS of all languages together. In a block every source, and the whole language, is a segment tree over
the block's terms whose leaves are counts; at each height equal (left, right) pairs become one node, whichever source and place they are
of. Two trees are walked together from their roots, one step a height for all pairs of trees at once: equal node pairs under equal
denominators are one state and are priced once, and a pair of subtrees without counts is left out, since prices are kept relative to that
of two zero counts. Prices of blocks add up; what every term would cost at zero counts is added at the end, times the number of terms.

A task counts its documents' terms before anything is moved; blocks hold the sources of two chunks of about CHUNK_SOURCES each, so that no task
meets more than it can hold, whatever the number of terms and sources. All prices are integers; numerators beyond a long are Python integers.

Edge cases: null text, lang and source are empty strings, which are groups like any other; repeated rows are documents of their own; a
group without terms has only zero counts; a language without kept terms prices every pair 0 and lists no terms; a language of one source
has no pairs; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, stored

LEAST_DOCUMENTS, SMOOTHING, SCALE, TOP_TERMS = 30, 5, 1_000_000_000, 50
BLOCK_TERMS, CHUNK_SOURCES = 512, 32
#: Tasks over which the blocks of one language are dealt when their sources are listed.
SALTS = 32
#: Distinct terms that a task holds before it hands its counts on.
HELD_TERMS = 1_000_000

TERM = re.compile(rb"[a-z\x80-\xff]+")


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, documents) of what each task reads: occurrences, and documents that have the term."""
    one = 1 << 44  # a document, in the bits above the occurrences

    def handed_on(held):
        for (lang, source), counts in held.items():
            both, k = np.fromiter(counts.values(), np.int64, len(counts)), len(counts)
            terms = pa.array(counts.keys(), pa.binary()).cast(pa.string())
            for at in range(0, k, 50_000):
                part = slice(at, min(k, at + 50_000))
                n = part.stop - at
                columns = [pa.repeat(pa.scalar(lang, pa.string()), n), pa.repeat(pa.scalar(source, pa.string()), n), terms[part], pa.array(both[part] & (one - 1)), pa.array(both[part] >> 44)]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "documents"])

    def counted(batches):
        held, size = {}, 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                counts = held.setdefault((lang, source), {})
                size -= len(counts)
                get = counts.get
                for term, n in Counter(TERM.findall(text.encode().lower())).items():  # bytes: only A-Z are lower-cased, and no letter beyond ASCII is cut
                    counts[term] = get(term, 0) + n + one
                size += len(counts)
                if size > HELD_TERMS:
                    yield from handed_on(held)
                    held, size = {}, 0
        yield from handed_on(held)

    return docs.select("lang", "source", "text").mapInArrow(counted, "lang string, source string, term string, n long, documents long")


class Trees:
    """Segment trees over the rows of counts (tree x term), equal subtrees of a height being one node."""

    def __init__(self, counts: np.ndarray):
        height = max(0, int(counts.shape[1] - 1).bit_length())
        full = np.zeros((len(counts), 1 << height), counts.dtype)
        full[:, : counts.shape[1]] = counts
        self.leaves, ids = np.unique(full, return_inverse=True)
        ids = ids.reshape(full.shape)
        self.zero = [int(np.searchsorted(self.leaves, 0)) if (self.leaves == 0).any() else -1]  # the node of no counts at each height
        self.nodes = []  # (left, right) of each node of each height from 1 up
        for _ in range(height):
            span = int(ids.max()) + 1
            made, ids = np.unique(ids[:, 0::2] * span + ids[:, 1::2], return_inverse=True)
            ids = ids.reshape(len(counts), -1)
            left, right = made // span, made % span
            bare = np.flatnonzero((left == self.zero[-1]) & (right == self.zero[-1]))
            self.nodes.append((left, right))
            self.zero.append(int(bare[0]) if len(bare) else -1)
        self.roots = ids[:, 0]

    def priced(self, a: np.ndarray, b: np.ndarray, kind: np.ndarray, price) -> np.ndarray:
        """The price of each pair of trees (a, b): the sum over terms of price(kind, count a, count b). Pairs of a kind share prices; two zero counts cost nothing."""
        states, back = _distinct(kind, self.roots[a], self.roots[b])
        walked = [(states, back)]
        for h in range(len(self.nodes), 0, -1):
            k, x, y = (s[~self._bare(states, h)] for s in states)
            left, right = self.nodes[h - 1]
            states, back = _distinct(np.concatenate([k, k]), np.concatenate([left[x], right[x]]), np.concatenate([left[y], right[y]]))
            walked.append((states, back))
        value = np.zeros(len(states[0]), np.int64)
        some = ~self._bare(states, 0)
        value[some] = price(states[0][some], self.leaves[states[1][some]], self.leaves[states[2][some]])
        for h in range(1, len(walked)):
            above, below = walked[-h - 1][0], walked[-h][1]
            halves = value[below].reshape(2, -1)
            value = np.zeros(len(above[0]), np.int64)
            value[~self._bare(above, h)] = halves.sum(axis=0)
        return value[walked[0][1]]

    def _bare(self, states, h: int) -> np.ndarray:
        return (states[1] == self.zero[h]) & (states[2] == self.zero[h])

    def met(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(pair, term, count a, count b) wherever tree a has a count: subtrees without any are left out whole."""
        pair, place, x, y = np.arange(len(a)), np.zeros(len(a), np.int64), self.roots[a], self.roots[b]
        for h in range(len(self.nodes), -1, -1):
            some = x != self.zero[h]
            pair, place, x, y = pair[some], place[some], x[some], y[some]
            if h:
                left, right = self.nodes[h - 1]
                pair, place = np.concatenate([pair, pair]), np.concatenate([2 * place, 2 * place + 1])
                x, y = np.concatenate([left[x], right[x]]), np.concatenate([left[y], right[y]])
        return pair, place, self.leaves[x], self.leaves[y]


def _distinct(kind: np.ndarray, x: np.ndarray, y: np.ndarray):
    """The distinct (kind, x, y), and which of them each is."""
    wide, high = int(x.max(initial=0)) + 1, int(y.max(initial=0)) + 1
    made, back = np.unique((kind * wide + x) * high + y, return_inverse=True)
    return (made // (wide * high), made // high % wide, made % high), back


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + SMOOTHING) / total), exact; 0 where the total is."""
    if len(count) and int(count.max()) > 2**63 // SCALE - SMOOTHING - 1:
        return np.array([1 + SCALE * (int(c) + SMOOTHING) // int(t) if t else 0 for c, t in zip(count, total, strict=True)], np.int64)
    return np.where(total > 0, 1 + SCALE * (count + SMOOTHING) // np.maximum(total, 1), 0)


PRICED = "lang string, source string, part string, item string, value long, at_zero long, n_terms long"


def price_block(rows: pd.DataFrame) -> pd.DataFrame:
    """The pairs and best terms of one block: rows with a term are counts, the others list the sources of both chunks with their totals."""
    roster = rows[rows["term"].isna()].sort_values("source")
    counts = rows[rows["term"].notna()]
    names, terms = roster["source"].tolist(), sorted(set(counts["term"]))
    lang, n_terms = rows["lang"].iloc[0], int(roster["n_terms"].iloc[0])
    total = roster["total"].to_numpy(np.int64)
    chunk = roster["chunk"].to_numpy()
    grid = np.zeros((len(names) + 1, max(1, len(terms))), np.int64)  # the last row is the language's
    at_name, at_term = {s: i for i, s in enumerate(names)}, {t: i for i, t in enumerate(terms)}
    column = counts["term"].map(at_term).to_numpy(np.int64) if len(counts) else np.zeros(0, np.int64)
    grid[counts["source"].map(at_name).to_numpy(np.int64) if len(counts) else column, column] = counts["n"].to_numpy(np.int64)
    grid[-1, column] = counts["lang_n"].to_numpy(np.int64)
    trees = Trees(grid)
    first, second = int(rows["first"].iloc[0]), int(rows["second"].iloc[0])
    a, b = np.triu_indices(len(names), 1)
    mine = np.minimum(chunk[a], chunk[b]) == first
    mine &= np.maximum(chunk[a], chunk[b]) == second
    a, b = a[mine], b[mine]
    found = []
    if len(a):
        (kinds, back) = np.unique(np.stack([total[a], total[b]], axis=1), axis=0, return_inverse=True)
        zero = np.zeros(len(kinds), np.int64)
        at_zero = np.abs(shares(zero, kinds[:, 0]) - shares(zero, kinds[:, 1]))
        price = lambda kind, x, y: np.abs(shares(x, kinds[kind, 0]) - shares(y, kinds[kind, 1])) - at_zero[kind]
        value = trees.priced(a, b, back.reshape(-1), price)
        for one, other in ((a, b), (b, a)):
            found.append(pd.DataFrame({"source": [names[i] for i in one], "part": "pair", "item": [names[i] for i in other], "value": value, "at_zero": at_zero[back.reshape(-1)]}))
    if first == second and terms:
        pair, place, n, lang_n = trees.met(np.arange(len(names)), np.full(len(names), len(names)))
        value = shares(n, total[pair]) - shares(lang_n, np.full(len(n), int(roster["lang_total"].iloc[0])))
        best = pd.DataFrame({"pair": pair, "place": place, "value": value})
        best = best[best["value"] > 0].sort_values(["pair", "value", "place"], ascending=[True, False, True]).groupby("pair").head(TOP_TERMS)
        found.append(pd.DataFrame({"source": [names[i] for i in best["pair"]], "part": "term", "item": [terms[i] for i in best["place"]], "value": best["value"].to_numpy(), "at_zero": 0}))
    if not found:
        return pd.DataFrame(columns=["lang", "source", "part", "item", "value", "at_zero", "n_terms"])
    out = pd.concat(found).assign(lang=lang, n_terms=n_terms)[["lang", "source", "part", "item", "value", "at_zero", "n_terms"]]
    return out.astype({c: object for c in ("lang", "source", "part", "item")})


def divergence(df: DataFrame, least_documents: int = LEAST_DOCUMENTS, block_terms: int = BLOCK_TERMS, chunk_sources: int = CHUNK_SOURCES) -> DataFrame:
    """(lang, source, part, item, value, rank) of the groups of df (text, lang, source)."""
    bounded_batches(df.sparkSession)
    docs = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    # One exchange: rows that meet by (lang, term) also meet by (lang, source, term).
    counts = term_counts(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    of_term = Window.partitionBy("lang", "term")
    kept = counts.withColumns({"lang_n": F.sum("n").over(of_term), "_d": F.sum("documents").over(of_term), "first_of_term": F.row_number().over(of_term.orderBy("source")) == 1})
    kept = stored(kept.filter(F.col("_d") >= least_documents).select("lang", "source", "term", "n", "lang_n", "first_of_term"), "kept-terms")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count_if("first_of_term").alias("n_terms"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left")
    added = lambda n: F.coalesce(F.col(n), F.lit(0)) + SMOOTHING * F.coalesce("n_terms", F.lit(0))
    groups = stored(groups.select("lang", "source", added("n").alias("total"), added("lang_n").alias("lang_total"), F.coalesce("n_terms", F.lit(0)).alias("n_terms")), "groups")

    n_terms = kept.agg(F.count_if("first_of_term")).first()[0]
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    blocks, chunks = max(1, -(-n_terms // block_terms)), max(1, -(-most // chunk_sources))
    block, chunk = F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block"), F.pmod(F.xxhash64("source"), F.lit(chunks)).cast("int").alias("chunk")
    kept, groups = kept.select("*", block, chunk), groups.select("*", chunk)
    # Every language has block 0 at least, and in each of its blocks every source is listed.
    used = kept.select("lang", "block").unionByName(groups.select("lang", F.lit(0).cast("long").alias("block"))).distinct()
    used = used.withColumn("salt", F.col("block") % SALTS)
    listed = groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))).join(used, ["lang", "salt"])
    none = lambda kind: F.lit(None).cast(kind)
    rows = kept.select("lang", "block", "chunk", "source", "term", "n", "lang_n", none("long").alias("total"), none("long").alias("lang_total"), none("long").alias("n_terms"))
    rows = rows.unionByName(listed.select("lang", "block", "chunk", "source", none("string").alias("term"), none("long").alias("n"), none("long").alias("lang_n"), "total", "lang_total", "n_terms"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    rows = rows.select("*", F.least("chunk", "_other").alias("first"), F.greatest("chunk", "_other").alias("second")).drop("_other")
    priced = rows.groupBy("lang", "block", "first", "second").applyInPandas(price_block, PRICED)

    whole = stored(priced.groupBy("lang", "source", "part", "item").agg((F.sum("value") + F.max("at_zero") * F.max("n_terms")).alias("value")), "prices")  # read twice below
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = lambda part: whole.filter(F.col("part") == part).withColumn("rank", rank)
    return ranked("pair").unionByName(ranked("term").filter(F.col("rank") <= TOP_TERMS)).select("lang", "source", "part", "item", "value", "rank")
