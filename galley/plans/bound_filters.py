"""Sinkless selections: SURVEY 2.B bound to the views."""

from pyspark.sql import functions as F

from galley.operators import filters

from .registry import bind

FOLD = "replace(lower({}), 'ё', 'е')"

bind("visible", lambda v: filters.visible(v.article).select("id", "title", "issue_id"), "SELECT id, title, issue_id FROM v_article WHERE deleted_at IS NULL")
bind("listed_journals", lambda v: filters.listed_journals(v.journal).select("id", "name", "issn"), "SELECT id, name, issn FROM v_journal WHERE is_hidden = false OR is_hidden IS NULL")
for status, column in filters.STATUSES.items():
    bind(f"status_filter_{status}", lambda v, s=status: filters.status_filter(v.article, s).select("id", "title"), f"SELECT id, title FROM v_article WHERE {column} = false")
bind(
    "search_title_author",
    lambda v: filters.search_title_author(v.article_full, "orB", "not_edited", 7).select("id", "title", "authors"),
    "SELECT id, title, authors FROM v_article_full WHERE deleted_at IS NULL AND (title ILIKE '%orb%' OR authors ILIKE '%orb%') AND edited = false AND journal_id = 7",
)
bind(
    "search_all",
    lambda v: filters.search_all(v.article_full, v.article_author, v.journal, "TION_1", 120),
    f"""WITH hit AS (SELECT a.id, a.title, j.name AS journal FROM v_article_full a JOIN v_journal j ON a.journal_id = j.id WHERE a.deleted_at IS NULL AND (
      contains({FOLD.format('a.title')}, 'tion_1') OR contains({FOLD.format('a.authors')}, 'tion_1') OR contains({FOLD.format('j.name')}, 'tion_1')
      OR a.id IN (SELECT article_id FROM v_article_author WHERE contains({FOLD.format('full_name')}, 'tion_1'))))
    SELECT *, (SELECT count(*) FROM hit) AS total FROM hit ORDER BY id DESC LIMIT 120""",
)
ISSUE = "(SELECT min(id) FROM v_issue WHERE journal_id = 3 AND year = 1995)"
bind(
    "issue_search",
    lambda v: filters.issue_search(v.article_full, v.article_author, v.issue.filter("journal_id = 3 AND year = 1995").agg(F.min("id")).first()[0] or 0, "STUDY 1"),
    f"""SELECT id, title FROM v_article_full a WHERE deleted_at IS NULL AND issue_id = {ISSUE} AND (contains({FOLD.format('title')}, 'study 1')
      OR contains({FOLD.format('authors')}, 'study 1') OR id IN (SELECT article_id FROM v_article_author WHERE contains({FOLD.format('full_name')}, 'study 1')))""",
)
bind(
    "unnumbered_articles",
    lambda v: filters.unnumbered_articles(v.article, v.issue).select("id", "title"),
    "SELECT a.id, a.title FROM v_article a JOIN v_issue i ON a.issue_id = i.id WHERE i.number = 0 AND i.year = 0 AND a.deleted_at IS NULL AND a.submitted_by_user_id IS NULL",
)
bind(
    "submission_queue",
    lambda v: filters.submission_queue(v.article, v.issue).select("id", "title", "submitted_by_user_id"),
    "SELECT a.id, a.title, a.submitted_by_user_id FROM v_article a JOIN v_issue i ON a.issue_id = i.id WHERE i.number = -1 AND i.year = 0 AND a.deleted_at IS NULL",
)
bind("selected_articles", lambda v: filters.selected_articles(v.article, "5, 17,x,41, 120,17").select("id", "title"), "SELECT id, title FROM v_article WHERE deleted_at IS NULL AND id IN (5, 17, 41, 120)")
bind(
    "own_submissions",
    lambda v: filters.own_submissions(v.article, v.issue, 77).select("id", "title", "number", "year"),
    "SELECT a.id, a.title, i.number, i.year FROM v_article a JOIN v_issue i ON a.issue_id = i.id WHERE a.deleted_at IS NULL AND a.submitted_by_user_id = 77",
)
bind(
    "clean_author_names",
    lambda v: filters.clean_author_names(v.article_author.withColumn("full_name", F.when(F.col("ord") == 3, F.concat(F.lit("(ed.) "), "full_name")).otherwise(F.col("full_name")))).select("article_id", "ord", "full_name"),
    "SELECT article_id, ord, full_name FROM v_article_author WHERE ord <> 3 AND full_name IS NOT NULL AND length(full_name) > 2 AND NOT contains(full_name, '<')",
)
bind(
    "author_display",
    lambda v: filters.author_display(v.article_full.withColumn("authors", F.when(F.col("id") % 2 == 0, F.col("authors"))), v.author_string.filter("article_id % 3 = 0").withColumnRenamed("authors", "names")),
    """SELECT a.id, coalesce(nullif(n.authors, ''), CASE WHEN a.id % 2 = 0 THEN nullif(a.authors, '') END, '-') AS authors
      FROM v_article_full a LEFT JOIN (SELECT * FROM v_author_string WHERE article_id % 3 = 0) n ON a.id = n.article_id""",
)
bind(
    "trash",
    lambda v: filters.trash(v.article).select("id", "title"),
    "SELECT id, title FROM v_article WHERE deleted_at IS NOT NULL",
)
bind(
    "article_type",
    lambda v: filters.article_type(v.sql("SELECT id AS doc_id, 1 AS line_no, CASE id % 4 WHEN 0 THEN 'Научная статья' WHEN 1 THEN 'ОБЗОР' WHEN 2 THEN 'Рецензия на книгу' ELSE title END AS line FROM v_article UNION ALL SELECT id, 2, CASE WHEN id % 8 = 3 THEN 'Краткое сообщение' ELSE title END FROM v_article")),
    """SELECT id AS doc_id, CASE id % 4 WHEN 0 THEN 'RAR' WHEN 1 THEN 'REV' WHEN 2 THEN 'BRV' ELSE CASE WHEN id % 8 = 3 THEN 'SCO' ELSE 'RAR' END END AS code,
      CASE id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 5 ELSE CASE WHEN id % 8 = 3 THEN 3 ELSE 1 END END AS type_id FROM v_article""",
)
bind(
    "latest_year_folders",
    lambda v: filters.latest_year_folders(v.folder, 1996),
    "SELECT journal, max(CAST(folder AS int)) AS year FROM v_folder WHERE regexp_full_match(folder, '[0-9]{4}') GROUP BY journal HAVING max(CAST(folder AS int)) >= 1995",
)
bind(
    "watch_prune",
    lambda v: filters.watch_prune(v.snap_new.select("path"), 1996).select("path"),
    "SELECT path FROM v_snap_new WHERE CAST(split_part(path, '/', 2) AS int) >= 1996",
)
