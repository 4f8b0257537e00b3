"""Pushing issues to the site: all rows are made and checked first, then issues, sections, articles and the record change in one commit.

The site's tables (galley.sources.versions.Tables): site_issue (num_id, journal_id, year, number), site_section (razd_id, num_id, title, sort),
site_article (art_id, razd_id, doi, title, pages, authors_html, orgs_html, abstract_html, draft_id) and push_record, which says what a
push has made: issue_id and draft_id, num_id, razd_id, art_id, doi, and whether the issue and the section were made by it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galley.functions.scalars import issue_segment, two_digits
from galley.sources.versions import Change, Tables, changed_parts

from .joins import find_or_create
from .maintenance import abstract_html, author_html, drop_empty_parents, rollback_push
from .numbering import sum_before
from .windows import next_sort, page_key

#: The key that deals each table out to its parts.
KEYS = {"site_issue": "num_id", "site_section": "num_id", "site_article": "razd_id", "push_record": "issue_id"}
NO_SECTION = "Без раздела"


def doi_of(issn: Column, year: Column, number: Column, place: Column, prefix: str = "10.18127") -> Column:
    """prefix/j{issn}-{year}{issue}-{place}: issue and place have two digits at least."""
    return F.concat(F.lit(f"{prefix}/j"), F.replace(issn, F.lit("-"), F.lit("")), F.lit("-"), year.cast("string"), issue_segment(number), F.lit("-"), two_digits(place.cast("string")))


def refusals(draft: DataFrame, author: DataFrame, blocked: DataFrame, limits: dict[str, int]) -> DataFrame:
    """(issue_id, reason) of every issue that may not be pushed: findings, articles without authors, fields longer than the site's."""
    known = author.select(F.col("article_id").alias("id"), F.lit(True).alias("has_authors")).distinct()
    return refused(draft.join(known, "id", "left"), blocked, limits)


def refused(draft: DataFrame, blocked: DataFrame, limits: dict[str, int]) -> DataFrame:
    """The refusals of drafts that tell by themselves whether they have authors (has_authors, null: none)."""
    reasons = {"no authors": F.col("has_authors").isNull()} | {f"{name} too long": F.length(name) > most for name, most in limits.items()}
    told = draft.select("issue_id", F.explode(F.array_compact(F.array(*[F.when(holds, reason) for reason, holds in reasons.items()]))).alias("reason"))
    return blocked.select("issue_id", F.lit("findings").alias("reason")).unionByName(told).distinct()


def push_rows(draft: DataFrame, author: DataFrame, site_issue: DataFrame, site_section: DataFrame, site_article: DataFrame, blocked: DataFrame, limits: dict[str, int] | None = None, stage=lambda df: df) -> DataFrame:
    """One row per article of issues that nothing stands against, with the ids, DOI and HTML that it gets on the site.

    draft: id, issue_id, journal_id, issn, year, number, section, title, pages, doi, abstract; author: article_id, ord, name, organization,
    email; blocked: issue_id. An article without a section goes to the one for such. A missing DOI counts on from the articles that the
    site has of the issue, in page order. What is used several times goes through `stage`, which may write it and read it back.

    Ids of issues and sections are found on the sections' counts; the articles themselves are moved twice, to their authors and to their issue.
    """
    draft = stage(draft)
    people = author_html(author.join(draft.select(F.col("id").alias("article_id")), "article_id", "left_semi"))
    todo = draft.withColumns({"section": F.coalesce(F.nullif(F.trim("section"), F.lit("")), F.lit(NO_SECTION)), "abstract_html": abstract_html(F.col("abstract"))})
    todo = stage(todo.join(people.withColumnRenamed("article_id", "id").withColumn("has_authors", F.lit(True)), "id", "left"))
    todo = todo.join(stage(refused(todo, blocked, limits or {}).select("issue_id").distinct()), "issue_id", "left_anti")
    issue_key = ["journal_id", "year", "number"]
    groups = stage(todo.groupBy(*issue_key, "section").agg(F.count("*").alias("_n")))
    issues = find_or_create(groups, site_issue, issue_key, "num_id").withColumnRenamed("created", "num_created")
    groups = stage(groups.join(issues, issue_key))
    sections = stage(find_or_create(groups.select("num_id", F.col("section").alias("title")), site_section, ["num_id", "title"], "razd_id").withColumnRenamed("created", "razd_created"))
    sorts = next_sort(sections.filter("razd_created").select("num_id", "title"), site_section, "num_id", ["title"])
    sections = sections.join(sorts, ["num_id", "title"], "left").withColumnRenamed("title", "section")
    of_section = site_article.groupBy("razd_id").agg(F.count("*").alias("_n"))
    have = of_section.join(site_section.select("razd_id", "num_id"), "razd_id").groupBy("num_id").agg(F.sum("_n").alias("_have"))
    before = sum_before(stage(groups.groupBy("num_id").agg(F.sum("_n").alias("_n"))), "num_id", "_n", "_before").drop("_n")
    top = site_article.agg(F.coalesce(F.max("art_id"), F.lit(0)).alias("_top"))
    targets = stage(groups.drop("_n").join(sections, ["num_id", "section"]).join(have, "num_id", "left").join(before, "num_id").crossJoin(F.broadcast(top)))
    rows = todo.join(targets, [*issue_key, "section"]).withColumn("place", F.row_number().over(Window.partitionBy("num_id").orderBy(*page_key())))
    made = doi_of(F.col("issn"), F.col("year"), F.col("number"), F.coalesce("_have", F.lit(0)) + F.col("place"))
    rows = rows.withColumns({"doi": F.coalesce("doi", made), "art_id": F.col("_top") + F.col("_before") + F.col("place")})
    return rows.withColumnRenamed("id", "draft_id").drop("_top", "_before", "_have", "abstract", "has_authors")


def staged(tables: Tables, df: DataFrame) -> DataFrame:
    """df written beside the tables, where no pointer names it, and read back."""
    path = f"{tables.path}/staged/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return tables.spark.read.schema(df.schema).parquet(path)


def push(tables: Tables, draft: DataFrame, author: DataFrame, blocked: DataFrame, limits: dict[str, int] | None = None, writer: str = "push") -> None:
    """Pushes all issues of draft that nothing stands against: every table of the site changes, or none does."""
    base = tables.current()
    site = {name: tables.read(name, base) for name in ("site_issue", "site_section", "site_article")}
    # Written once, so that all tables get the same ids.
    stage = lambda df: staged(tables, df)
    rows = stage(push_rows(draft, author, *site.values(), blocked, limits, stage))
    new = {
        "site_issue": rows.filter("num_created").select("num_id", "journal_id", "year", "number").distinct(),
        "site_section": rows.filter("razd_created").select("razd_id", "num_id", F.col("section").alias("title"), "sort").distinct(),
        "site_article": rows.select(site["site_article"].columns),
        "push_record": rows.select("issue_id", "draft_id", "num_id", "razd_id", "art_id", "doi", "num_created", "razd_created"),
    }
    tables.commit({name: Change(df, append=True) for name, df in new.items()}, base.number, writer)


def roll_back(tables: Tables, issues: DataFrame, writer: str = "rollback") -> DataFrame:
    """Undoes the pushes of issues (issue_id): articles that still hold their DOI go, then sections and issues made by the push if nothing
    is left in them. Only the parts that hold them are written anew. Returns (art_id, doi) of articles that were left alone."""
    base, ids = tables.current(), staged(tables, issues.select("issue_id").distinct())
    record = staged(tables, tables.read("push_record", base, tables.parts_of("push_record", ids, base)).join(ids, "issue_id", "left_semi"))
    sections_of, issues_of = record.select("razd_id").distinct(), record.select("num_id").distinct()
    parts = {name: tables.parts_of(name, keys, base) for name, keys in (("site_article", sections_of), ("site_section", issues_of), ("site_issue", issues_of))}
    site = {name: tables.read(name, base, touched) for name, touched in parts.items()}
    kept, skipped = (staged(tables, df) for df in rollback_push(record, site["site_article"]))
    section, issue = site["site_section"], site["site_issue"]
    made = lambda key: record.filter(f"{key}_created").select(F.col(f"{key}_id").alias("id")).distinct()
    # Articles of sections that nothing of the push is in stay out: only sections made by it are asked for.
    sections, parents = drop_empty_parents(section.select(F.col("razd_id").alias("id"), F.col("num_id").alias("issue_id"), "title", "sort"), issue.withColumnRenamed("num_id", "id"), kept.select(F.col("razd_id").alias("section_id")), made("razd"), made("num"))
    after = {
        "site_article": kept,
        "site_section": sections.select(F.col("id").alias("razd_id"), F.col("issue_id").alias("num_id"), "title", "sort"),
        "site_issue": parents.withColumnRenamed("id", "num_id"),
    }
    changes = {name: Change(df.select(site[name].columns), touched=parts[name]) for name, df in after.items()}
    changes["push_record"] = changed_parts(tables, "push_record", ids, lambda t: t.join(ids, "issue_id", "left_anti").select(t.columns), base)
    tables.commit(changes, base.number, writer)
    return skipped
