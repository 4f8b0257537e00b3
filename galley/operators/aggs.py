"""Aggregations over the editorial tables: hash aggregates with map-side partial sums throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .filters import STATUSES, clean_author_names, visible
from .joins import journal_outer, snapshot_diff, star_articles


def dashboard_totals(journal: DataFrame, issue: DataFrame, article: DataFrame) -> DataFrame:
    """One row: journals, visible issues and articles, and per status how many articles are known to lack it and how many others there are."""
    backlog = [F.count_if(~F.col(c)).alias(s) for s, c in STATUSES.items()] + [F.count_if(F.coalesce(F.col(c), F.lit(True))).alias(f"not_{s}") for s, c in STATUSES.items()]
    articles = visible(article).agg(F.count("*").alias("articles"), *backlog)
    return journal.agg(F.count("*").alias("journals")).crossJoin(visible(issue).agg(F.count("*").alias("issues"))).crossJoin(articles)


def articles_per_journal(journal: DataFrame, issue: DataFrame, article: DataFrame) -> DataFrame:
    """(name, count), largest first; journals without articles are left out."""
    return star_articles(article, issue, journal).groupBy(F.col("journal").alias("name")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "name")


def journal_counts(journal: DataFrame, issue: DataFrame, article: DataFrame) -> DataFrame:
    """(name, issues, articles) of all journals."""
    return journal_outer(journal, issue, article).groupBy("journal_id", "name").agg(F.count_distinct("issue_id").alias("issues"), F.count("article_id").alias("articles"))


def issues_per_year(issue: DataFrame, journal_id: int) -> DataFrame:
    return visible(issue).filter((F.col("journal_id") == journal_id) & (F.col("year") > 0)).groupBy("year").agg(F.count("*").alias("n"))


def distinct_authors(author: DataFrame, name: str = "full_name", approximate: bool = False) -> DataFrame:
    """(n): distinct names, exact or by HyperLogLog."""
    return author.agg((F.approx_count_distinct(name) if approximate else F.count_distinct(name)).alias("n"))


def author_directory(author: DataFrame, search: str = "", sort: str = "name") -> DataFrame:
    """(name, email, organization, articles) by lower-cased name; where rows differ, the smallest value."""
    rows = clean_author_names(author)
    if search:
        rows = rows.filter(F.lower("full_name").contains(search.lower()))
    grouped = rows.groupBy(F.lower("full_name").alias("_key")).agg(F.min("full_name").alias("name"), F.min("email").alias("email"), F.min("organization").alias("organization"), F.count_distinct("article_id").alias("articles"))
    return sorted_directory(grouped.drop("_key"), sort)


def sorted_directory(directory: DataFrame, sort: str) -> DataFrame:
    orders = {"name": [F.asc("name")], "-name": [F.desc("name")], "articles": [F.asc("articles"), F.asc("name")], "-articles": [F.desc("articles"), F.asc("name")], "email": [F.asc_nulls_last("email"), F.asc("name")]}
    return directory.orderBy(*orders[sort])


def author_entities(author: DataFrame, key) -> DataFrame:
    """(entity, name, variants, organizations, articles): rows grouped by e-mail, else by a name key.

    The longest name (then the smallest) is the main one; the two longest organisations; distinct articles, newest first.
    """
    entity = F.coalesce(F.nullif(F.lower("email"), F.lit("")), key)
    longest = lambda c: F.array_sort(F.array_distinct(F.collect_set(c)), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    g = author.groupBy(entity.alias("entity")).agg(longest("full_name").alias("names"), longest("organization").alias("orgs"), F.sort_array(F.collect_set("article_id"), asc=False).alias("articles"))
    return g.select("entity", F.get("names", F.lit(0)).alias("name"), F.slice("names", 2, 1 << 20).alias("variants"), F.slice("orgs", 1, 2).alias("organizations"), "articles")


def author_profile(author: DataFrame, fields: list[str], key: str = "full_name", order: tuple[str, ...] = ("article_id", "ord")) -> DataFrame:
    """(key, fields): the first value of each field that is not blank, in the given order."""
    filled = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    first = lambda c: F.min_by(filled(c), F.when(filled(c).isNotNull(), F.struct(*order)))
    return author.groupBy(F.lower(key).alias("key")).agg(*[first(c).alias(c) for c in fields])


def detect_issue(parsed: DataFrame) -> DataFrame:
    """(batch, issn, year, number, journal, volume, odd): per batch the issue most DOIs name, the journal and volume most citations name, and how many files name another issue.

    parsed: batch, file, issn, year, number, journal, volume. Ties go to the smallest.
    """

    def most(columns: list[str]) -> DataFrame:
        n = parsed.filter(F.col(columns[0]).isNotNull()).groupBy("batch", *columns).agg(F.count("*").alias("n"))
        return n.groupBy("batch").agg(F.min_by(F.struct(*columns), F.struct(-F.col("n"), *columns)).alias("m")).select("batch", *[F.col(f"m.{c}").alias(c) for c in columns])

    key = ["issn", "year", "number"]
    issue = most(key)
    odd = parsed.join(issue.select("batch", *[F.col(c).alias(f"m_{c}") for c in key]), "batch").groupBy("batch").agg(F.count_if(F.col("issn").isNotNull() & ~(F.struct(*key) == F.struct(*[F.col(f"m_{c}").alias(c) for c in key]))).alias("odd"))
    return issue.join(most(["journal"]), "batch", "left").join(most(["volume"]), "batch", "left").join(odd, "batch")


def kinds_summary(paths: DataFrame, group: str = "journal") -> DataFrame:
    """(group, kinds): 'doc 3, pdf 2', doc, docx and rtf as one, most frequent first."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(ext.isin("doc", "docx", "rtf"), "doc").when(ext == "", "other").otherwise(ext)
    n = paths.groupBy(group, kind.alias("kind")).agg(F.count("*").alias("n"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "kind")))
    return n.groupBy(group).agg(F.array_join(F.transform(listed, lambda x: F.concat(x["kind"], F.lit(" "), (-x["order"]).cast("string"))), ", ").alias("kinds"))


def mark_counts(marks: DataFrame) -> DataFrame:
    """(journal, pushed, loaded, missing, nojournal), zeros filled in."""
    states = ["pushed", "loaded", "missing", "nojournal"]
    return marks.groupBy("journal").pivot("state", states).count().fillna(0, states)


def top_authors(author: DataFrame, k: int = 10, name: str = "full_name") -> DataFrame:
    return author.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(k)


def import_stats(chain: DataFrame) -> DataFrame:
    """(reason, n) of a legacy chain; 'created' where nothing stands against it."""
    return chain.groupBy(F.coalesce("reason", F.lit("created")).alias("reason")).agg(F.count("*").alias("n"))


def publish_overview(journal: DataFrame, issue: DataFrame, article: DataFrame) -> DataFrame:
    """(issn, name, issues, articles): listed journals and ISSNs that drafts name, hidden ones only if drafted; those with drafts first.

    issue: id, issn; article: issue_id.
    """
    counts = article.groupBy("issue_id").agg(F.count("*").alias("n"))
    drafted = issue.join(counts, F.col("id") == F.col("issue_id"), "left").groupBy("issn").agg(F.count("*").alias("issues"), F.sum(F.coalesce("n", F.lit(0))).alias("articles"))
    both = journal.select("issn", "name", "is_hidden").join(drafted, "issn", "full_outer")
    kept = both.filter(F.col("issues").isNotNull() | ~F.coalesce("is_hidden", F.lit(False)))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return kept.select("issn", F.coalesce("name", "issn").alias("name"), zero("issues"), zero("articles")).orderBy(F.desc("issues"), "name")


def sheet_totals(article: DataFrame) -> DataFrame:
    """One row of 'done/total' per status over visible articles."""
    n = F.count("*").cast("string")
    return visible(article).agg(*[F.concat(F.count_if(F.coalesce(F.col(c), F.lit(False))).cast("string"), F.lit("/"), n).alias(c) for c in STATUSES.values()])


def author_string(author: DataFrame) -> DataFrame:
    """(article_id, names): the author names in their order, joined by ', '."""
    return author.groupBy("article_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "full_name"))), lambda x: x["full_name"]), ", ").alias("names"))


def duplicate_orcid(author: DataFrame) -> DataFrame:
    """(article_id, ord, orcid, warning): a code that several authors of an article have is blanked for all of them."""
    n = F.count("orcid").over(Window.partitionBy("article_id", "orcid"))
    twice = F.col("orcid").isNotNull() & (n > 1)
    return author.select("article_id", "ord", F.when(~twice, F.col("orcid")).alias("orcid"), F.when(twice, F.concat(F.lit("same code: "), F.col("orcid"))).alias("warning"))


def folder_rollup(paths: DataFrame) -> DataFrame:
    """(folder, n): files beneath every folder, at any depth."""
    part = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(part) - 1), lambda i: F.array_join(F.slice(part, 1, i), "/"))
    return paths.filter(F.size(part) > 1).select(F.explode(folders).alias("folder")).groupBy("folder").agg(F.count("*").alias("n"))


def journal_issue_counts(issue: DataFrame, article: DataFrame, journal_id: int, year: int, with_deleted: bool = True) -> DataFrame:
    """(id, number, n) of the visible issues of a journal and year; deleted articles count only where asked for."""
    rows = article if with_deleted else visible(article)
    counts = rows.groupBy("issue_id").agg(F.count("*").alias("n"))
    own = visible(issue).filter((F.col("journal_id") == journal_id) & (F.col("year") == year))
    return own.join(counts, F.col("id") == F.col("issue_id"), "left").select("id", "number", F.coalesce("n", F.lit(0)).alias("n"), "position").orderBy("position", F.desc("id")).drop("position")


def journal_article_counts(issue: DataFrame, article: DataFrame) -> DataFrame:
    """(journal_id, n), deleted rows too."""
    return article.join(issue.select(F.col("id").alias("issue_id"), "journal_id"), "issue_id").groupBy("journal_id").agg(F.count("*").alias("n"))


def digest_groups(old: DataFrame, new: DataFrame) -> DataFrame:
    """(journal, issue, added, changed, removed) of two snapshots."""
    kinds = ["added", "changed", "removed"]
    part = F.split("path", "/")
    diff = snapshot_diff(old, new).select(part[0].alias("journal"), part[2].alias("issue"), "kind")
    return diff.groupBy("journal", "issue").pivot("kind", kinds).count().fillna(0, kinds)


def issue_stage(issue: DataFrame, article: DataFrame, state: DataFrame, misordered: DataFrame) -> DataFrame:
    """(issue_id, articles, pushed, pending, misordered, with_pdf, signed, failed) counters per issue.

    article: id, issue_id, site_art_id; state: article_id, has_pdf, signed_at, errors (array); misordered: issue_id, n.
    """
    joined = article.join(state, F.col("id") == F.col("article_id"), "left")
    per = joined.groupBy("issue_id").agg(
        F.count("*").alias("articles"), F.count("site_art_id").alias("pushed"), F.count_if(F.col("site_art_id").isNull()).alias("pending"),
        F.count_if(F.coalesce("has_pdf", F.lit(False))).alias("with_pdf"), F.count("signed_at").alias("signed"), F.count_if(F.coalesce(F.size("errors"), F.lit(0)) > 0).alias("failed"),
    )
    out = issue.select(F.col("id").alias("issue_id")).join(per, "issue_id", "left").join(misordered.select("issue_id", F.col("n").alias("misordered")), "issue_id", "left")
    return out.fillna(0)
