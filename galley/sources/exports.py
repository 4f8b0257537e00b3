"""Sinks: report tables, CSV, and XML frames whose nesting Spark's XML writer turns into elements and attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galley.operators.filters import STATUSES
from galley.operators.grams import containing
from galley.operators.windows import numbered_rows, page_key

from .versions import Change, Tables

dash = lambda c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("-"))


def articles_csv_frame(article: DataFrame, words: bool = False) -> DataFrame:
    """Numbered report rows: blanks as '-', statuses as marks or as words. article: id, title, authors, journal and the statuses."""
    yes, no = ("Да", "Нет") if words else ("✓", "✗")
    mark = lambda c: F.when(F.coalesce(F.col(c), F.lit(False)), yes).otherwise(no).alias(c)
    rows = numbered_rows(article.select("id", "title", "authors", "journal", *STATUSES.values()))
    return rows.select("n", dash("title").alias("title"), dash("authors").alias("authors"), dash("journal").alias("journal"), *[mark(c) for c in STATUSES.values()])


def articles_csv(article: DataFrame, path: str, words: bool = False) -> None:
    """The report as one CSV file: a reader opens it as a whole, so it is one partition; its first header cell carries the byte order mark."""
    frame = articles_csv_frame(article, words).orderBy("n")
    frame = frame.withColumnRenamed("n", "﻿№")
    frame.coalesce(1).write.mode("errorifexists").option("header", True).csv(path)


def articles_sheet(article: DataFrame) -> DataFrame:
    """Report rows and a last one with 'done/total' per status; place orders them. article: id, title and the statuses."""
    yes = lambda c: F.when(F.coalesce(F.col(c), F.lit(False)), "+").otherwise("").alias(c)
    rows = numbered_rows(article.select("id", "title", *STATUSES.values())).select(F.col("n").cast("long").alias("place"), "title", *[yes(c) for c in STATUSES.values()])
    n = F.count("*").cast("string")
    total = article.agg((F.count("*") + 1).alias("place"), F.lit("total").alias("title"), *[F.concat(F.count_if(F.coalesce(F.col(c), F.lit(False))).cast("string"), F.lit("/"), n).alias(c) for c in STATUSES.values()])
    return rows.unionByName(total)


def ordered(child: DataFrame, key: str, order: str, fields: list[str], name: str) -> DataFrame:
    """(key, name): a parent's children as an array of structs in their order."""
    items = F.array_sort(F.collect_list(F.struct(order, *[f for f in fields if f != order])))
    return child.groupBy(key).agg(F.transform(items, lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(name))


def side(lang: str, **fields: Column) -> Column:
    return F.struct(F.lit(lang).alias("_lang"), *[c.alias(k) for k, c in fields.items()])


def export_index_frame(article: DataFrame, author: DataFrame, refs: DataFrame) -> DataFrame:
    """One row per article in page order, nested as the index wants it: the section only at its first article, an English author
    only with a surname, the text falling back from full text to abstract to title, Russian references only.

    article: id, issue_id, section, pages, doi, title_ru, title_en, abstract, fulltext; author: article_id, ord, surname_ru, surname_en; refs: article_id, pos, ru.
    """
    people = ordered(author, "article_id", "ord", ["ord", "surname_ru", "surname_en"], "people")
    listed = ordered(refs, "article_id", "pos", ["ru"], "listed")
    w = Window.partitionBy("issue_id", "section").orderBy(*page_key())
    rows = article.withColumn("_first", F.row_number().over(w) == 1).withColumn("place", F.row_number().over(Window.partitionBy("issue_id").orderBy(*page_key())))
    rows = rows.join(people, F.col("id") == people["article_id"], "left").drop("article_id").join(listed, F.col("id") == listed["article_id"], "left").drop("article_id")
    one = lambda a: F.struct(a["ord"].alias("_num"), F.filter(F.array(side("RUS", surname=a["surname_ru"]), F.when(F.coalesce(a["surname_en"], F.lit("")) != "", side("ENG", surname=a["surname_en"]))), lambda x: x.isNotNull()).alias("individInfo"))
    value = lambda lang, c: F.struct(F.lit(lang).alias("_lang"), F.col(c).alias("_VALUE"))
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return rows.select(
        "issue_id", "place", F.when(F.col("_first"), F.col("section")).alias("section"), "pages", F.lit("RAR").alias("artType"), F.struct(F.col("doi").alias("doi")).alias("codes"),
        F.struct(F.array(value("RUS", "title_ru"), value("ENG", "title_en")).alias("artTitle")).alias("artTitles"), F.struct(F.transform("people", one).alias("author")).alias("authors"),
        F.coalesce(blank("fulltext"), blank("abstract"), F.col("title_ru")).alias("text"),
        F.struct(F.transform("listed", lambda r: F.struct(F.array(F.struct(F.lit("RUS").alias("_lang"), r["ru"].alias("text"))).alias("refInfo"))).alias("reference")).alias("references"),
    )


def export_registry_frame(article: DataFrame, author: DataFrame, aligned: DataFrame) -> DataFrame:
    """The index frame with a volume and references in pairs of both languages. aligned: article_id, ru_pos, en_pos, ru, en; article has volume too."""
    both = lambda r: F.struct(F.filter(F.array(F.when(r["ru"].isNotNull(), F.struct(F.lit("RUS").alias("_lang"), r["ru"].alias("text"))), F.when(r["en"].isNotNull(), F.struct(F.lit("ENG").alias("_lang"), r["en"].alias("text")))), lambda x: x.isNotNull()).alias("refInfo"))
    pairs = aligned.withColumn("pos", F.coalesce(F.col("ru_pos") * 2, F.col("en_pos") * 2 + 1))
    listed = ordered(pairs, "article_id", "pos", ["ru", "en"], "pairs").withColumnRenamed("article_id", "_article")
    base = export_index_frame(article, author, aligned.filter("ru IS NOT NULL").select("article_id", F.col("ru_pos").alias("pos"), "ru"))
    keys = article.select(F.col("doi").alias("_doi"), F.col("id").alias("_id"), "volume")
    out = base.join(keys, base["codes.doi"].eqNullSafe(F.col("_doi"))).join(listed, F.col("_id") == F.col("_article"), "left")
    return out.select(*[c for c in base.columns if c != "references"], F.col("volume"), F.struct(F.transform("pairs", both).alias("reference")).alias("references"))


def export_deposit_frame(article: DataFrame, author: DataFrame, refs: DataFrame, url: str) -> DataFrame:
    """One row per article with a DOI for deposit: English title first, contributors, pages, the address of pushed rows, numbered citations."""
    people = ordered(author, "article_id", "ord", ["ord", "surname_en", "initials", "orcid"], "people")
    listed = ordered(refs, "article_id", "pos", ["pos", "ru"], "listed")
    rows = article.filter("doi IS NOT NULL").join(people, F.col("id") == people["article_id"], "left").drop("article_id").join(listed, F.col("id") == listed["article_id"], "left").drop("article_id")
    contributor = lambda a, i: F.struct(F.lit("author").alias("_contributor_role"), F.when(i == 0, "first").otherwise("additional").alias("_sequence"), a["initials"].alias("given_name"), a["surname_en"].alias("surname"), F.when(a["orcid"] != "", F.concat(F.lit("https://orcid.org/"), a["orcid"])).alias("ORCID"))
    pages = F.split("pages", "-")
    return rows.select(
        F.struct(F.filter(F.array(F.nullif("title_en", F.lit("")), F.col("title_ru")), lambda x: x.isNotNull()).alias("title")).alias("titles"), F.struct(F.transform("people", contributor).alias("person_name")).alias("contributors"),
        F.struct(pages[0].alias("first_page"), F.get(pages, F.lit(1)).alias("last_page")).alias("pages"), F.struct(F.col("doi").alias("doi"), F.when(F.col("site_art_id").isNotNull(), F.concat(F.lit(url), F.url_encode(F.col("site_art_id").cast("string")))).alias("resource")).alias("doi_data"),
        F.struct(F.transform("listed", lambda r: F.struct(F.concat(F.lit("ref"), r["pos"].cast("string")).alias("_key"), r["ru"].alias("unstructured_citation"))).alias("citation")).alias("citation_list"),
    )


def write_xml(frame: DataFrame, path: str, row: str = "article", root: str = "articles", compression: str = "none") -> None:
    """A frame as XML files; fields that begin with an underscore are attributes. XML repeats its tags and takes a tenth when compressed (gzip)."""
    frame.write.format("xml").option("rowTag", row).option("rootTag", root).option("compression", compression).mode("errorifexists").save(path)


def table_dump_frame(tables: dict[str, DataFrame]) -> DataFrame:
    """(_name, _rows, column): every table's schema and row count, as write_xml takes it."""
    out = None
    for name, df in tables.items():
        columns = F.array(*[F.struct(F.lit(c).alias("_name"), F.lit(t).alias("_type")) for c, t in df.dtypes])
        part = df.agg(F.count("*").alias("_rows")).select(F.lit(name).alias("_name"), "_rows", columns.alias("column"))
        out = part if out is None else out.unionByName(part)
    return out


def snapshot_commit(snapshot: DataFrame, path: str, version: int, writer: str = "snapshots") -> None:
    """A snapshot as version `version` of a folder: its files first, then the pointer; Conflict where another writer has made that version."""
    Tables(snapshot.sparkSession, path).commit({"snapshot": Change(snapshot)}, version - 1, writer)


def latest_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest committed snapshot, or that of one version; only its own files are opened."""
    tables = Tables(spark, path)
    return tables.read("snapshot", None if version is None else tables.version(version))


def snapshot_retention(versions: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """versions (name, ts) with keep: not older than the given days."""
    return versions.withColumn("keep", F.col("ts") >= now - F.expr(f"INTERVAL {days} DAYS"))


def export_names(issue: DataFrame, by_issn: DataFrame, by_name: DataFrame, suffix: str) -> DataFrame:
    """(id, file): '{abbr}_{number}_{year}_{suffix}.xml'; the abbreviation by ISSN, else by part of the name (longest), else the name's first six letters and digits.

    issue: id, issn, name, number, year; by_issn: issn, abbr; by_name: part, abbr.
    """
    rows = issue.join(by_issn.select("issn", F.col("abbr").alias("_a")), "issn", "left")
    names = rows.filter("_a IS NULL").select("name").distinct()
    parts = by_name.groupBy("part").agg(F.min("abbr").alias("abbr"))
    pairs = containing(names.select(F.col("name").alias("text_id"), F.lower("name").alias("text")), parts.select(F.col("part").alias("needle_id"), F.lower("part").alias("needle")))
    named = pairs.join(parts, F.col("needle_id") == F.col("part")).groupBy(F.col("text_id").alias("name")).agg(F.max_by("abbr", F.struct(F.length("part"), F.col("part"))).alias("_b"))
    rows = rows.join(named, "name", "left").withColumn("_b", F.when(F.col("_a").isNull(), F.col("_b")))
    first = F.left(F.regexp_replace("name", "[^0-9A-Za-zА-Яа-яЁё]", ""), F.lit(6))
    return rows.select("id", F.format_string("%s_%s_%s_%s.xml", F.coalesce("_a", "_b", first), F.col("number").cast("string"), F.col("year").cast("string"), F.lit(suffix)).alias("file"))
