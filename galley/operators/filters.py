"""Filters and projections over the editorial tables. All of them are predicates that reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions.scalars import fold_text

STATUSES = {"unpaid": "payment_received", "no_review": "has_review", "not_edited": "edited", "no_expertise": "has_expertise_act"}


def visible(t: DataFrame) -> DataFrame:
    """Rows that are not soft-deleted."""
    return t.filter(F.col("deleted_at").isNull())


def trash(t: DataFrame) -> DataFrame:
    """Soft-deleted rows, newest first."""
    return t.filter(F.col("deleted_at").isNotNull()).orderBy(F.desc("deleted_at"), F.desc("id"))


def listed_journals(journal: DataFrame) -> DataFrame:
    """Journals that are not hidden; an unknown flag counts as not hidden."""
    return journal.filter(~F.coalesce("is_hidden", F.lit(False)))


def status_filter(article: DataFrame, status: str) -> DataFrame:
    """Articles whose status is known to be false; a null status matches nothing."""
    return article.filter(F.col(STATUSES[status]) == F.lit(False))


def like_pattern(needle: str) -> str:
    """A contains pattern in which the needle's own wildcards are literal."""
    return "%" + needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"


def search_title_author(article: DataFrame, needle: str, status: str | None = None, journal_id: int | None = None) -> DataFrame:
    """Visible articles (with columns title, authors, journal_id) that have the needle in title or author string."""
    found = visible(article)
    if needle:
        pattern = like_pattern(needle)
        found = found.filter(F.col("title").ilike(pattern) | F.col("authors").ilike(pattern))
    if status:
        found = status_filter(found, status)
    if journal_id is not None:
        found = found.filter(F.col("journal_id") == journal_id)
    return found


def search_all(article: DataFrame, author: DataFrame, journal: DataFrame, needle: str, limit: int = 50) -> DataFrame:
    """Articles with the folded needle in title, author string, journal name or any author row; total before the limit.

    article has title, authors and journal_id. A needle under two characters finds nothing; the limit is 200 at most.
    """
    needle = needle.lower().replace("ё", "е").strip()
    contains = lambda c: fold_text(F.col(c)).contains(needle)
    by_author = author.filter(contains("full_name")).select(F.col("article_id").alias("id")).distinct().withColumn("by_author", F.lit(True))
    names = journal.select(F.col("id").alias("journal_id"), F.col("name").alias("journal"))
    found = visible(article).join(names, "journal_id").join(by_author, "id", "left")
    hit = contains("title") | F.coalesce(contains("authors"), F.lit(False)) | contains("journal") | F.coalesce("by_author", F.lit(False))
    found = found.filter(hit & F.lit(len(needle) >= 2)).select("id", "title", "journal")
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy(F.desc("id")).limit(min(limit, 200)).crossJoin(F.broadcast(total))


def issue_search(article: DataFrame, author: DataFrame, issue_id: int, needle: str) -> DataFrame:
    """Articles of one issue with the folded needle in title, author string or any author's name."""
    needle = needle.lower().replace("ё", "е")
    names = author.groupBy("article_id").agg(F.collect_list(fold_text(F.col("full_name"))).alias("names"))
    own = visible(article).filter(F.col("issue_id") == issue_id).join(names, F.col("id") == F.col("article_id"), "left")
    hit = fold_text(F.col("title")).contains(needle) | F.coalesce(fold_text(F.col("authors")).contains(needle), F.lit(False)) | F.coalesce(F.exists("names", lambda x: x.contains(needle)), F.lit(False))
    return own.filter(hit).select("id", "title")


def unnumbered_articles(article: DataFrame, issue: DataFrame) -> DataFrame:
    """Visible articles of issues without a number (number 0, year 0) that no author submitted."""
    none = issue.filter("number = 0 AND year = 0").select(F.col("id").alias("issue_id"))
    return visible(article).filter(F.col("submitted_by_user_id").isNull()).join(none, "issue_id", "left_semi")


def submission_queue(article: DataFrame, issue: DataFrame) -> DataFrame:
    """Visible articles of the authors' queue (number -1, year 0), newest first."""
    queue = issue.filter("number = -1 AND year = 0").select(F.col("id").alias("issue_id"))
    return visible(article).join(queue, "issue_id", "left_semi").orderBy(F.desc("submitted_at"), F.desc("id"))


def ids_of(spark, text: str) -> DataFrame:
    """(id) of a comma-separated list; what is no number is left out."""
    listed = spark.range(1).select(F.explode(F.split(F.lit(text), ",")).alias("x"))
    return listed.select(F.expr("try_cast(trim(x) AS bigint)").alias("id")).filter("id IS NOT NULL").distinct()


def selected_articles(article: DataFrame, ids: str) -> DataFrame:
    """Visible articles whose ids are listed."""
    return visible(article).join(ids_of(article.sparkSession, ids), "id", "left_semi")


def own_submissions(article: DataFrame, issue: DataFrame, user: int) -> DataFrame:
    """A user's own visible articles with their issues."""
    issues = issue.select(F.col("id").alias("issue_id"), "number", "year")
    return visible(article).filter(F.col("submitted_by_user_id") == user).join(issues, "issue_id")


def clean_author_names(author: DataFrame, name: str = "full_name") -> DataFrame:
    """Author rows whose name can be one: longer than two characters, no markup, no opening sign."""
    c = F.col(name)
    return author.filter(c.isNotNull() & (F.length(c) > 2) & ~c.startswith("(") & ~c.startswith("-") & ~c.contains("<"))


def author_display(article: DataFrame, names: DataFrame) -> DataFrame:
    """Per article the joined author rows (article_id, names), else the stored string, else a dash."""
    shown = F.coalesce(F.expr("nullif(names, '')"), F.expr("nullif(authors, '')"), F.lit("-"))
    return article.join(names, F.col("id") == F.col("article_id"), "left").select("id", shown.alias("authors"))


# Fixed values.
ARTICLE_TYPES = (("обзор", "REV"), ("краткое сообщение", "SCO"), ("от редакции", "EDI"), ("рецензия", "BRV"), ("научная статья", "RAR"))
TYPE_IDS = {"RAR": 1, "REV": 2, "SCO": 3, "EDI": 4, "BRV": 5}


def article_type(lines: DataFrame) -> DataFrame:
    """(doc_id, code, type_id): the first of a document's first five lines that names a type; RAR where none does."""
    code: Column = F.lit(None).cast("string")
    for words, value in reversed(ARTICLE_TYPES):
        code = F.when(F.lower("line").contains(words), value).otherwise(code)
    first = lines.filter("line_no <= 5").withColumn("code", code).groupBy("doc_id").agg(F.min_by("code", F.when(F.col("code").isNotNull(), F.col("line_no"))).alias("code"))
    ids = F.create_map(*[F.lit(x) for pair in TYPE_IDS.items() for x in pair])
    return first.select("doc_id", F.coalesce("code", F.lit("RAR")).alias("code"), ids[F.coalesce("code", F.lit("RAR"))].alias("type_id"))


def latest_year_folders(folders: DataFrame, current_year: int) -> DataFrame:
    """(journal, year): each journal's newest folder named by a year, not older than last year; others are no journals."""
    years = folders.filter(F.col("folder").rlike("^[0-9]{4}$")).groupBy("journal").agg(F.max(F.col("folder").cast("int")).alias("year"))
    return years.filter(F.col("year") >= current_year - 1)


def watch_prune(paths: DataFrame, least_year: int) -> DataFrame:
    """Paths worth watching: journal/year/... with a journal that is no number, a year from least_year on, no junk names."""
    part = F.split("path", "/")
    name = F.element_at(part, -1)
    year = F.expr("try_cast(split(path, '/')[1] AS int)")
    junk = name.startswith("~") | name.startswith(".") | F.lower(name).isin("thumbs.db", "desktop.ini")
    kept = (F.size(part) > 2) & ~part[0].rlike("^[0-9]+$") & part[1].rlike("^[0-9]{4}$") & (year >= least_year) & ~junk
    return paths.filter(F.coalesce(kept, F.lit(False)))
