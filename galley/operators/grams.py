"""Containment joins over an inverted index of character n-grams: which texts hold which needles, without comparing all pairs.

A needle's rarest gram is looked up in the index, and only the texts that have it are compared with the needle. Grams have GRAM characters;
of needles that are shorter the needle itself is the gram, so the index holds the shorter ones too. An empty needle is in no text.
The postings of a gram are dealt out over SALTS tasks, since a common one may be in most texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions.scalars import fold_text
from galley.sources.versions import Change, Tables

from .filters import search_all

GRAM, SALTS = 3, 16


def pieces(c: Column, *sizes: int) -> Column:
    """All substrings of so many characters. The text is cut once, and no piece looks for its place from the start."""
    at = lambda chars, n: F.when(F.size(chars) >= n, F.sequence(F.lit(0), F.size(chars) - n)).otherwise(F.array().cast("array<int>"))
    cut = lambda chars, n: F.transform(at(chars, n), lambda i: F.array_join(F.slice(chars, i + 1, n), ""))
    every = lambda chars: F.concat(*[cut(chars, n) for n in sizes])
    return F.get(F.transform(F.array(F.filter(F.split(c, ""), lambda x: x != "")), every), F.lit(0))


def gram_index(texts: DataFrame, key: str, text: Column) -> DataFrame:
    """(gram, key): the grams of up to GRAM characters of each text, each once."""
    grams = F.array_distinct(pieces(text, *range(1, GRAM + 1)))
    return texts.select(F.explode(grams).alias("gram"), key)


def needle_grams(needles: DataFrame, id_col: str, needle: str) -> DataFrame:
    """(id, gram): the grams that a text with the needle must have."""
    c = F.col(needle)
    own = F.when(F.length(c) < GRAM, F.filter(F.array(c), lambda x: x != "")).otherwise(F.array_distinct(pieces(c, GRAM)))
    return needles.select(id_col, F.explode(own).alias("gram"))


def containing(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """(needle_id, text_id) of all texts (text_id, text) that hold a needle (needle_id, needle)."""
    index = gram_index(texts, "text_id", F.col("text"))
    sizes = index.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = needle_grams(needles, "needle_id", "needle").join(sizes, "gram", "left")
    rarest = rarest.groupBy("needle_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("m")).filter("m.n > 0").select("needle_id", F.col("m.gram").alias("gram"))
    salted = rarest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = index.withColumn("salt", F.pmod(F.xxhash64("text_id"), F.lit(SALTS)).cast("int")).join(salted, ["gram", "salt"]).select("needle_id", "text_id")
    both = found.join(needles, "needle_id").join(texts, "text_id")
    return both.filter(F.contains("text", F.col("needle"))).select("needle_id", "text_id")


def build_search_index(tables: Tables, article: DataFrame, author: DataFrame, writer: str = "index") -> None:
    """The grams of titles, author strings and author names by article id, kept in parts by gram."""
    texts = [article.select("id", F.col(c).alias("text")) for c in ("title", "authors")]
    texts.append(author.select(F.col("article_id").alias("id"), F.col("full_name").alias("text")))
    every = texts[0].unionByName(texts[1]).unionByName(texts[2]).filter("text IS NOT NULL")
    # Texts are moved to their article, and its grams are told apart there: grams are fifteen times as many bytes to move (239 and 16 MB at sf0.1).
    held = every.groupBy("id").agg(F.collect_set(fold_text(F.col("text"))).alias("texts"))
    grams = F.array_distinct(F.flatten(F.transform("texts", lambda t: pieces(t, *range(1, GRAM + 1)))))
    base = tables.current()
    tables.commit({"grams": Change(held.select(F.explode(grams).alias("gram"), "id"), key="gram")}, base.number if base else -1, writer)


def indexed_search(tables: Tables, article: DataFrame, author: DataFrame, journal: DataFrame, needle: str, limit: int = 50) -> DataFrame:
    """What search_all finds, looked for only in articles that have every gram of the needle, or whose journal's name has it; of the index
    only the parts of these grams are read."""
    wanted = needle.lower().replace("ё", "е").strip()
    own = sorted({wanted[i : i + GRAM] for i in range(len(wanted) - GRAM + 1)}) or ([wanted] if wanted else [])
    named = article.join(journal.filter(F.contains(fold_text(F.col("name")), F.lit(wanted))).select(F.col("id").alias("journal_id")), "journal_id", "left_semi").select("id")
    keys = tables.spark.createDataFrame([(g,) for g in own], "gram string")
    postings = tables.read("grams", parts=tables.parts_of("grams", keys)).filter(F.col("gram").isin(own))
    ids = postings.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(own)).select("id").union(named).distinct()
    return search_all(article.join(ids, "id", "left_semi"), author.join(ids.withColumnRenamed("id", "article_id"), "article_id", "left_semi"), journal, needle, limit)
