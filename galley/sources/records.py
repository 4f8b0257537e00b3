"""Record sources: journal XML, registry JSON, change history, binary uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

JOURNAL_SCHEMA = """pages string, artType string, codes struct<doi:string, udk:string>,
artTitles struct<artTitle:array<struct<_lang:string, _VALUE:string>>>, abstracts struct<abstract:array<struct<_lang:string, _VALUE:string>>>,
authors struct<author:array<struct<_num:int, individInfo:array<struct<_lang:string, surname:string, initials:string, orgName:string, email:string>>>>>,
references struct<reference:array<struct<refInfo:array<struct<_lang:string, text:string>>>>>"""


def in_language(items, lang: str, field: str):
    """The field of the first item in a language."""
    return F.get(F.filter(items, lambda x: x["_lang"] == lang), F.lit(0))[field]


def journal_xml_read(spark: SparkSession, path: str) -> DataFrame:
    """One record per article of journal XML files: flat fields, nested authors and references, pages split into first and last."""
    raw = spark.read.schema(JOURNAL_SCHEMA).format("xml").option("rowTag", "article").load(path)
    pages = F.split("pages", "-")
    return raw.select(
        F.get(pages, F.lit(0)).alias("first_page"), F.coalesce(F.get(pages, F.lit(1)), F.get(pages, F.lit(0))).alias("last_page"), F.col("codes.doi").alias("doi"), F.col("codes.udk").alias("udk"),
        in_language(F.col("artTitles.artTitle"), "RUS", "_VALUE").alias("title_ru"), in_language(F.col("artTitles.artTitle"), "ENG", "_VALUE").alias("title_en"),
        F.transform("authors.author", lambda a: F.struct(a["_num"].alias("num"), in_language(a["individInfo"], "RUS", "surname").alias("surname_ru"), in_language(a["individInfo"], "ENG", "surname").alias("surname_en"), in_language(a["individInfo"], "RUS", "email").alias("email"))).alias("authors"),
        F.transform("references.reference", lambda r: F.struct(in_language(r["refInfo"], "RUS", "text").alias("ru"), in_language(r["refInfo"], "ENG", "text").alias("en"))).alias("references"),
    )


REGISTRY_SIDE = "struct<title:string, pages:string, authors:array<struct<surname:string, initials:string, org:string>>, keywords:array<string>>"
REGISTRY_SCHEMA = f"struct<doi:string, RUS:{REGISTRY_SIDE}, ENG:{REGISTRY_SIDE}>"


def registry_json_read(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(doi, title_ru, title_en, pages, authors) of registry payloads; English authors joined to Russian ones by place."""
    p = payloads.select(F.from_json(column, REGISTRY_SCHEMA).alias("p")).select("p.*")
    authors = F.zip_with("RUS.authors", "ENG.authors", lambda r, e: F.struct(r["surname"].alias("surname_ru"), e["surname"].alias("surname_en"), F.coalesce(r["initials"], e["initials"]).alias("initials"), r["org"].alias("org_ru"), e["org"].alias("org_en")))
    return p.select("doi", F.col("RUS.title").alias("title_ru"), F.col("ENG.title").alias("title_en"), F.col("RUS.pages").alias("pages"), authors.alias("authors"))


def history_read(events: DataFrame, newest: int = 50) -> DataFrame:
    """(article_id, field, old, new, at) of the newest events of each article; changes is a JSON list."""
    r = F.row_number().over(Window.partitionBy("article_id").orderBy(F.desc("created_at"), F.desc("id")))
    kept = events.withColumn("_r", r).filter(F.col("_r") <= newest)
    changes = F.from_json("changes", "array<struct<field:string, old:string, new:string>>")
    return kept.select("article_id", F.col("created_at").alias("at"), F.explode(changes).alias("c")).select("article_id", "c.field", "c.old", "c.new", "at")


def upload_audit_scan(spark: SparkSession, path: str, sample: int = 8192) -> DataFrame:
    """(name, len, sample) of the files in a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("len"), F.substring("content", 1, sample).alias("sample"))
