"""SURVEY 2.E, 2.F and 2.G bound to the views."""

from pyspark.sql import functions as F

from galley.operators import joins, windows
from galley.sources.text import manuscript_lines

from .registry import bind

bind("numbered_rows", lambda v: windows.numbered_rows(v.article.select("id", "title")), "SELECT id, title, row_number() OVER (ORDER BY id DESC) AS n FROM v_article")
bind(
    "latest_issue_per_journal",
    lambda v: windows.latest_issue_per_journal(v.snap_new),
    """WITH p AS (SELECT split_part(path, '/', 1) AS journal, CAST(split_part(path, '/', 2) AS int) AS year, split_part(path, '/', 3) AS issue, CAST(substr(split_part(path, '/', 3), 5, 2) AS int) AS num, mtime FROM v_snap_new),
    r AS (SELECT *, rank() OVER (PARTITION BY journal ORDER BY year DESC, num DESC) AS r FROM p) SELECT journal, issue, max(mtime) AS mtime FROM r WHERE r = 1 GROUP BY journal, issue""",
)
PAGE = "CAST(split_part(pages, '-', 1) AS int)"
bind("page_order", lambda v: windows.page_order(v.pub_article).select("id", "place"), f"SELECT id, row_number() OVER (PARTITION BY issue_id ORDER BY {PAGE}, id) AS place FROM v_pub_article")
PLAN = f"""a AS (SELECT id, issue_id, site_art_id, row_number() OVER (PARTITION BY issue_id ORDER BY {PAGE}, id) AS k, row_number() OVER (PARTITION BY issue_id ORDER BY site_art_id) AS m FROM v_pub_article WHERE site_art_id IS NOT NULL),
plan AS (SELECT a.id, a.site_art_id AS old, b.site_art_id AS new FROM a JOIN a b ON a.issue_id = b.issue_id AND a.k = b.m WHERE a.site_art_id <> b.site_art_id)"""
bind("reorder_plan", lambda v: windows.reorder_plan(v.pub_article), f"WITH {PLAN} SELECT * FROM plan")
ISSUES = "SELECT i.id AS issue_id, j.issn, i.year, i.number FROM v_issue i JOIN v_journal j ON i.journal_id = j.id"
DOIS = f"""n AS (SELECT id, issue_id, row_number() OVER (PARTITION BY issue_id ORDER BY {PAGE}, id) AS k FROM v_pub_article WHERE doi IS NULL), h AS (SELECT issue_id, count(doi) AS have FROM v_pub_article GROUP BY issue_id),
dois AS (SELECT n.id, '10.18127/j' || replace(x.issn, '-', '') || '-' || CAST(x.year AS varchar) || CASE WHEN x.number BETWEEN 0 AND 9 THEN '0' ELSE '' END || CAST(x.number AS varchar) || '-' || CASE WHEN have + k < 10 THEN '0' ELSE '' END || CAST(have + k AS varchar) AS doi FROM n JOIN h ON n.issue_id = h.issue_id JOIN ({ISSUES}) x ON x.issue_id = n.issue_id)"""
#: All articles of a journal in one issue: far more than 99 of them.
BIG = "SELECT p.id, cast(floor(p.issue_id / 1000000) AS bigint) AS issue_id, p.pages, CASE WHEN p.id % 2 = 0 THEN p.doi END AS doi FROM v_pub_article p"
BIG_ISSUES = "SELECT id AS issue_id, issn, 1999 AS year, CASE WHEN id % 3 = 0 THEN concat(cast(id AS string), '(1)') WHEN id % 3 = 1 THEN concat(cast(100 + id AS string), '(12)') ELSE ' 7' END AS number FROM v_journal"
bind(
    "assign_doi_large",
    lambda v: windows.assign_doi(v.sql(BIG), v.sql(BIG_ISSUES)),
    f"""WITH b AS ({BIG}), n AS (SELECT id, issue_id, row_number() OVER (PARTITION BY issue_id ORDER BY {PAGE}, id) AS k FROM b WHERE doi IS NULL), h AS (SELECT issue_id, count(doi) AS have FROM b GROUP BY issue_id)
    SELECT n.id, '10.18127/j' || replace(j.issn, '-', '') || '-1999' || CASE j.id % 3 WHEN 0 THEN CASE WHEN j.id < 10 THEN '0' ELSE '' END || CAST(j.id AS varchar) || '(01)' WHEN 1 THEN CAST(100 + j.id AS varchar) || '(12)' ELSE '07' END
      || '-' || CASE WHEN have + k < 10 THEN '0' ELSE '' END || CAST(have + k AS varchar) AS doi FROM n JOIN h ON n.issue_id = h.issue_id JOIN v_journal j ON j.id = n.issue_id""",
)
bind("assign_doi", lambda v: windows.assign_doi(v.pub_article, v.sql(ISSUES)), f"WITH {DOIS} SELECT * FROM dois")
bind(
    "next_sort",
    lambda v: windows.next_sort(v.issue.filter("year = 1997").select("id", "journal_id"), v.issue.filter("year < 1997").select("journal_id", F.col("position").alias("sort")), "journal_id", ["id"]),
    "SELECT n.id, n.journal_id, coalesce((SELECT max(position) FROM v_issue e WHERE e.year < 1997 AND e.journal_id = n.journal_id), 0) + row_number() OVER (PARTITION BY n.journal_id ORDER BY n.id) AS sort FROM v_issue n WHERE n.year = 1997",
)
bind(
    "recent_issues",
    lambda v: windows.recent_issues(v.issue).select("id", "journal_id", "year", "number"),
    "SELECT id, journal_id, year, number FROM (SELECT *, row_number() OVER (PARTITION BY journal_id ORDER BY year DESC, greatest(number, 0) DESC, id DESC) AS r FROM v_issue) WHERE r <= 4",
)
bind(
    "first_in_section",
    lambda v: windows.first_in_section(v.pub_article.withColumn("section", F.col("id") % 3)).select("id", "first"),
    f"SELECT id, row_number() OVER (PARTITION BY issue_id, id % 3 ORDER BY {PAGE}, id) = 1 AS first FROM v_pub_article",
)


def _headed(v):
    return manuscript_lines(v.documents).withColumn("heading", F.when(F.length("line") < 40, F.col("line")))


LINES = "lines AS (SELECT doc_id, CAST(i AS int) AS line_no, trim(translate(parts[i], '⁰¹²³⁴⁵⁶⁷⁸⁹', '0123456789'), ' ') AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)))"
bind(
    "segment_sections",
    lambda v: windows.segment_sections(_headed(v)).select("doc_id", "line_no", F.md5(F.coalesce("section", F.lit(""))).alias("section")),
    f"WITH {LINES} SELECT doc_id, line_no, md5(coalesce(last_value(CASE WHEN length(line) < 40 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '')) AS section FROM lines",
)
bind(
    "glue_runs",
    lambda v: windows.glue_runs(manuscript_lines(v.documents), F.length("line") < 40, ["doc_id"]).select("doc_id", F.col("run").cast("long").alias("run"), F.md5("text").alias("text")),
    f"""WITH {LINES}, r AS (SELECT *, sum(CASE WHEN length(line) < 40 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM lines)
    SELECT doc_id, CAST(run AS bigint) AS run, md5(string_agg(line, ' ' ORDER BY line_no)) AS text FROM r GROUP BY doc_id, run""",
)
bind(
    "numbered_list_size",
    lambda v: v.ref_lines.select("article_id", windows.numbered_list_size(F.concat(F.lit("7. x\n"), "ru_refs", F.lit("\n1. again\n"))).alias("n")),
    "SELECT article_id, CAST(max(pos) AS int) AS n FROM v_ref GROUP BY article_id",
)
bind(
    "page_of",
    lambda v: windows.page_of(v.article.select("id", "title"), 3, 40),
    "SELECT id, title, (SELECT count(*) FROM v_article) AS total, CAST(ceil((SELECT count(*) FROM v_article) / 40.0) AS bigint) AS pages FROM v_article ORDER BY id DESC LIMIT 40 OFFSET 80",
)
TOC_LINES = "SELECT issue_id AS doc_id, 2 * CAST(split_part(pages, '-', 1) AS int) AS line_no, concat('Paper of ', split_part(pages, '-', 1)) AS line FROM v_pub_article UNION ALL SELECT issue_id, 2 * CAST(split_part(pages, '-', 1) AS int) - 1, concat('SECTION ', chr(65 + CAST(id % 26 AS int))) FROM v_pub_article WHERE id % 3 = 0"
bind(
    "toc_pages",
    lambda v: windows.toc_pages(v.sql(TOC_LINES)),
    f"""SELECT issue_id AS doc_id, {PAGE} AS page, last_value(CASE WHEN id % 3 = 0 THEN 'SECTION ' || chr(65 + CAST(id % 26 AS int)) END IGNORE NULLS) OVER (PARTITION BY issue_id ORDER BY {PAGE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM v_pub_article""",
)
bind(
    "latest_per_key",
    lambda v: windows.latest_per_key(v.issue, "journal_id", ["year", "number", "id"], ["id", "year", "number"]),
    "SELECT journal_id, id, year, number FROM (SELECT *, row_number() OVER (PARTITION BY journal_id ORDER BY year DESC, number DESC, id DESC) AS r FROM v_issue) WHERE r = 1",
)
STAR = "SELECT a.id, a.title, j.name AS journal, i.number, i.year, a.submitted_at FROM v_article a JOIN v_issue i ON a.issue_id = i.id JOIN v_journal j ON i.journal_id = j.id WHERE a.deleted_at IS NULL AND i.deleted_at IS NULL"
bind(
    "recent_articles",
    lambda v: windows.recent_articles(joins.star_articles(v.article, v.issue, v.journal)).select("id", "title", "journal", "number", "year"),
    f"SELECT id, title, journal, number, year FROM ({STAR} ORDER BY submitted_at DESC, id DESC LIMIT 10)",
)
bind("recent_activity", lambda v: windows.recent_activity(v.history).select("id", "article_id", "action"), "SELECT id, article_id, action FROM v_history ORDER BY created_at DESC, id DESC LIMIT 15")
bind(
    "natural_sort",
    lambda v: windows.natural_sort(v.snap_new.select("path"), "path"),
    "SELECT path FROM v_snap_new ORDER BY lower(split_part(split_part(path, '/', 1), '_', 1)), CAST(split_part(split_part(path, '/', 1), '_', 2) AS int), path LIKE '%', CAST(split_part(path, '/', 2) AS int), CAST(substr(split_part(path, '/', 3), 5, 2) AS int), CAST(split_part(split_part(path, '/', 5), '.', 1) AS int), path",
)
bind(
    "folder_order",
    lambda v: windows.folder_order(v.sql("SELECT CASE WHEN id % 2 = 0 THEN concat('Rt_', CAST(id AS string)) ELSE concat('rt_', CAST(id AS string)) END AS name, id % 3 = 0 AS is_dir FROM v_article")),
    "SELECT CASE WHEN id % 2 = 0 THEN 'Rt_' ELSE 'rt_' END || CAST(id AS varchar) AS name, id % 3 = 0 AS is_dir FROM v_article ORDER BY is_dir DESC, id",
)
bind("issues_order", lambda v: windows.issues_order(v.issue).select("id", "year", "number"), "SELECT id, year, number FROM v_issue ORDER BY year DESC, greatest(number, 0) DESC, id DESC")
bind("issues_order_public", lambda v: windows.issues_order(v.issue, True).select("id", "year", "number"), "SELECT id, year, number FROM v_issue ORDER BY position, id DESC")
bind("years_of_journal", lambda v: windows.years_of_journal(v.issue, 9), "SELECT DISTINCT year FROM v_issue WHERE journal_id = 9 AND year > 0 AND deleted_at IS NULL ORDER BY year DESC")
RECORDED = "SELECT article_id, concat('c', CAST(person AS string)) AS code FROM v_author WHERE ord % 3 <> 0"
PRINTED = "SELECT article_id, concat('c', CAST(person AS string)) AS code FROM v_author WHERE ord % 2 = 1"
bind("codes_only_in_print", lambda v: windows.codes_only_in_print(v.sql(RECORDED), v.sql(PRINTED)), f"{PRINTED} EXCEPT {RECORDED}")
bind(
    "emails_lost",
    lambda v: windows.emails_lost(v.article_author.filter("ord <> 2").select("article_id", "email"), v.article_author.filter("email IS NOT NULL").select("article_id", F.concat(F.lit("x."), F.upper("email")).alias("email"))),
    "SELECT DISTINCT article_id, 'x.' || upper(email) AS email FROM v_article_author p WHERE email IS NOT NULL AND NOT EXISTS (SELECT 1 FROM v_article_author r WHERE r.article_id = p.article_id AND r.ord <> 2 AND contains('x.' || lower(p.email), lower(r.email)))",
)
bind(
    "known_union_drafted",
    lambda v: windows.known_union_drafted(v.journal.filter("id % 2 = 0"), v.draft_issue),
    "SELECT DISTINCT issn, name FROM v_draft_issue UNION SELECT issn, name FROM v_journal WHERE id % 2 = 0",
)
FINDINGS = "SELECT id AS article_id, CASE WHEN id % 2 = 0 THEN 'error' ELSE 'note' END AS severity, concat('rule ', CAST(id % 5 AS string)) AS message FROM v_article"
bind(
    "accepted_split",
    lambda v: windows.accepted_split(v.sql(FINDINGS), v.sql("SELECT id AS article_id, concat('rule ', CAST(id % 4 AS string)) AS message FROM v_article")),
    "SELECT id AS article_id, CASE WHEN id % 2 = 0 AND id % 5 <> id % 4 THEN 'error' ELSE 'note' END AS severity, 'rule ' || CAST(id % 5 AS varchar) AS message FROM v_article",
)
bind("same_snapshot", lambda v: windows.same_snapshot(v.snap_old, v.snap_new), "SELECT NOT EXISTS (SELECT path, size, mtime FROM v_snap_old EXCEPT SELECT path, size, mtime FROM v_snap_new) AND NOT EXISTS (SELECT path, size, mtime FROM v_snap_new EXCEPT SELECT path, size, mtime FROM v_snap_old) AS same")
