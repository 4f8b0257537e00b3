"""Window functions, sorts and top-k over the editorial tables.

Windows are partitioned by article, issue or journal. Where the whole result has to be numbered (numbered_rows), row numbers come from
counts per range partition, not from one unpartitioned window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galley.functions.scalars import issue_segment, two_digits

from .joins import first_page


def numbered_rows(df: DataFrame, order: str = "id", parts: int = 32) -> DataFrame:
    """df with n, the 1-based place by the number `order` descending: ranks inside ranges of it plus the sizes of those before.

    The ranges are cut at approximate quantiles, so they depend on values alone and are the same in every pass.
    """
    cuts = df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.005)  # parts - 1 numbers
    part = sum((F.when(F.col(order) < c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    ranged = df.withColumn("_part", part)
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # at most `parts` rows
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_part").orderBy(F.desc(order))))
    return ranked.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn("n", F.col("_r") + F.col("_before")).drop("_part", "_r", "_before")


def latest_issue_per_journal(paths: DataFrame) -> DataFrame:
    """(journal, issue, mtime): the issue folder with the greatest year and number of each journal, and its newest time."""
    part = F.split("path", "/")
    rows = paths.select(part[0].alias("journal"), part[1].try_cast("int").alias("year"), part[2].alias("issue"), "mtime")
    rows = rows.withColumn("nums", F.transform(F.regexp_extract_all(F.regexp_replace("issue", "(19|20)[0-9]{2}", ""), F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("int")))
    per = rows.groupBy("journal", "year", "nums", "issue").agg(F.max("mtime").alias("mtime"))
    return per.groupBy("journal").agg(F.max(F.struct("year", "nums", "issue", "mtime")).alias("m")).select("journal", "m.issue", "m.mtime")


def page_key() -> list[Column]:
    """The order of an issue: first page, then id; articles without pages come first, as number 0."""
    return [F.coalesce(first_page(F.col("pages")), F.lit(0)), F.col("id")]


def page_order(article: DataFrame) -> DataFrame:
    """article with place: its order in the issue."""
    return article.withColumn("place", F.row_number().over(Window.partitionBy("issue_id").orderBy(*page_key())))


def reorder_plan(article: DataFrame) -> DataFrame:
    """(id, old, new): the site ids that an issue owns dealt anew in page order; only rows whose id changes."""
    own = article.filter(F.col("site_art_id").isNotNull())
    by_page = own.select("id", "issue_id", F.col("site_art_id").alias("old"), F.row_number().over(Window.partitionBy("issue_id").orderBy(*page_key())).alias("k"))
    by_id = own.select("issue_id", F.col("site_art_id").alias("new"), F.row_number().over(Window.partitionBy("issue_id").orderBy("site_art_id")).alias("k"))
    return by_page.join(by_id, ["issue_id", "k"]).filter("old <> new").select("id", "old", "new")


def assign_doi(article: DataFrame, issue: DataFrame, prefix: str = "10.18127") -> DataFrame:
    """(id, doi) of articles without a DOI: they count on from the issue's DOIs, in page order.

    issue: issue_id, issn, year, number ('1', '1(1)' or a number). No number is cut: the 100th article ends in -100.
    """
    have = article.groupBy("issue_id").agg(F.count("doi").alias("have"))
    new = article.filter(F.col("doi").isNull()).withColumn("k", F.row_number().over(Window.partitionBy("issue_id").orderBy(*page_key())))
    out = new.join(have, "issue_id").join(issue, "issue_id")
    seq = two_digits((F.col("have") + F.col("k")).cast("string"))
    doi = F.concat(F.lit(f"{prefix}/j"), F.replace("issn", F.lit("-"), F.lit("")), F.lit("-"), F.col("year").cast("string"), issue_segment(F.col("number")), F.lit("-"), seq)
    return out.select("id", doi.alias("doi"))


def next_sort(new: DataFrame, existing: DataFrame, group: str, order: list[str], sort: str = "sort") -> DataFrame:
    """new with sort values that go on from the group's largest."""
    top = existing.groupBy(group).agg(F.max(sort).alias("_top"))
    k = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return new.join(top, group, "left").withColumn(sort, F.coalesce("_top", F.lit(0)) + k).drop("_top")


def recent_issues(issue: DataFrame, k: int = 4) -> DataFrame:
    """The k newest issues of each journal: year, then the number's leading digits, then id, all descending."""
    number = F.coalesce(first_page(F.col("number").cast("string")), F.lit(0))
    r = F.row_number().over(Window.partitionBy("journal_id").orderBy(F.desc("year"), number.desc(), F.desc("id")))
    return issue.withColumn("_r", r).filter(F.col("_r") <= k).drop("_r")


def first_in_section(article: DataFrame) -> DataFrame:
    """article (issue_id, section, pages, id) with first: whether its section has its first article in the issue here."""
    return article.withColumn("first", F.row_number().over(Window.partitionBy("issue_id", "section").orderBy(*page_key())) == 1)


def segment_sections(lines: DataFrame) -> DataFrame:
    """lines (doc_id, line_no, line, heading) with section: the last heading above or at the line."""
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last("heading", ignorenulls=True).over(w))


def glue_runs(lines: DataFrame, start: Column, by: list[str], order: str = "line_no", sep: str = " ") -> DataFrame:
    """(by, run, text): lines joined from one start of a run to the next."""
    w = Window.partitionBy(*by).orderBy(order)
    marked = lines.withColumn("_start", F.coalesce(start, F.lit(False))).withColumn("run", F.sum(F.col("_start").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    listed = F.array_sort(F.collect_list(F.struct(order, "line")))
    return marked.groupBy(*by, "run").agg(F.array_join(F.transform(listed, lambda x: x["line"]), sep).alias("text"))


def numbered_list_size(c: Column) -> Column:
    """How many lines of a text are numbered 1, 2, 3 ... in sequence. Numbers out of sequence do not count; an item that starts with _ is the
    tail of the one before: it takes its number but does not count."""
    found = F.regexp_extract_all(c, F.lit(r"(?m)^\s*([0-9]{1,3}\.\s(?:\s*_)?)"), F.lit(1))
    start = F.struct(F.lit(0).alias("number"), F.lit(0).alias("items"))

    def step(s: Column, x: Column) -> Column:
        follows = F.substring_index(x, ".", 1).cast("int") == s["number"] + 1
        return F.when(follows, F.struct((s["number"] + 1).alias("number"), (s["items"] + F.when(x.endswith("_"), 0).otherwise(1)).alias("items"))).otherwise(s)

    return F.aggregate(found, start, step, lambda s: s["items"])


def page_of(t: DataFrame, page: int, per_page: int = 50, order: str = "id") -> DataFrame:
    """The rows of a page with total and pages; at most 200 rows a page."""
    per_page = min(per_page, 200)
    total = t.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / per_page))
    return t.orderBy(F.desc(order)).offset((page - 1) * per_page).limit(per_page).crossJoin(F.broadcast(total))


def toc_pages(lines: DataFrame) -> DataFrame:
    """(doc_id, page, section): lines that end with a page number, under the last heading in capitals above them."""
    heading = F.when(F.col("line").rlike("[A-ZА-ЯЁ]{3}") & ~F.col("line").rlike("[a-zа-яё]") & ~F.col("line").rlike("[0-9]+$"), F.trim("line"))
    page = F.regexp_extract("line", r"([0-9]+)\s*$", 1)
    return segment_sections(lines.withColumn("heading", heading)).filter((page != "") & F.col("heading").isNull()).select("doc_id", page.cast("int").alias("page"), "section")


def latest_per_key(t: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """The row of each key with the greatest values of order."""
    return t.groupBy(key).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("m")).select(key, *[F.col(f"m.{c}").alias(c) for c in keep])


# ---- sorts and top-k


def recent_articles(star: DataFrame, k: int = 10) -> DataFrame:
    return star.orderBy(F.desc("submitted_at"), F.desc("id")).limit(k)


def recent_activity(log: DataFrame, k: int = 15) -> DataFrame:
    return log.orderBy(F.desc("created_at"), F.desc("id")).limit(k)


def natural_key(c: Column) -> Column:
    """Lower case with the number of digits before every number, leading zeros dropped: 'Rt_9' sorts before 'Rt_10', however long numbers are."""
    parts = F.regexp_extract_all(F.lower(c), F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    number = lambda x: F.regexp_replace(x, "^0+", "")
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), F.concat(F.lpad(F.length(number(x)).cast("string"), 10, "0"), number(x))).otherwise(x)), "")


def natural_sort(df: DataFrame, name: str) -> DataFrame:
    return df.orderBy(natural_key(F.col(name)), name)


def folder_order(entries: DataFrame) -> DataFrame:
    """Folders first, then natural order of the names."""
    return entries.orderBy(F.desc("is_dir"), natural_key(F.col("name")), "name")


def issues_order(issue: DataFrame, public: bool = False) -> DataFrame:
    """Year and number descending; for readers by position, newest id first."""
    return issue.orderBy(F.asc("position"), F.desc("id")) if public else issue.orderBy(F.desc("year"), F.coalesce(first_page(F.col("number").cast("string")), F.lit(0)).desc(), F.desc("id"))


# ---- sets


def years_of_journal(issue: DataFrame, journal_id: int) -> DataFrame:
    return issue.filter((F.col("journal_id") == journal_id) & (F.col("year") > 0) & F.col("deleted_at").isNull()).select("year").distinct().orderBy(F.desc("year"))


def codes_only_in_print(recorded: DataFrame, printed: DataFrame) -> DataFrame:
    """(article_id, code) of prints that no record has."""
    return printed.select("article_id", "code").subtract(recorded.select("article_id", "code"))


def emails_lost(recorded: DataFrame, printed: DataFrame) -> DataFrame:
    """(article_id, email) of printed e-mails that hold none of the article's recorded ones."""
    r = recorded.filter("email IS NOT NULL").select(F.col("article_id").alias("r_id"), F.lower("email").alias("r_email"))
    return printed.join(r, (F.col("article_id") == F.col("r_id")) & F.contains(F.lower("email"), F.col("r_email")), "left_anti").select("article_id", "email").distinct()


def known_union_drafted(known: DataFrame, drafted: DataFrame) -> DataFrame:
    """(issn, name): known journals, and drafted ones with other ISSNs."""
    both = known.select("issn", "name", F.lit(0).alias("p")).unionByName(drafted.select("issn", "name", F.lit(1).alias("p")))
    return both.groupBy("issn").agg(F.min_by("name", F.struct("p", "name")).alias("name"))


def accepted_split(findings: DataFrame, accepted: DataFrame) -> DataFrame:
    """findings (article_id, severity, message) where errors accepted word for word are notes."""
    a = accepted.select("article_id", "message").distinct().withColumn("_ok", F.lit(True))
    out = findings.join(a, ["article_id", "message"], "left")
    return out.withColumn("severity", F.when((F.col("severity") == "error") & F.coalesce("_ok", F.lit(False)), "note").otherwise(F.col("severity"))).drop("_ok")


def same_snapshot(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: whether two snapshots hold the same rows."""
    columns = ["path", "size", "mtime"]
    o, n = old.select(*columns), new.select(*columns)
    differs = o.exceptAll(n).unionByName(n.exceptAll(o))
    return differs.agg((F.count("*") == 0).alias("same"))

