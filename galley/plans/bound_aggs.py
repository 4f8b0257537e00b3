"""SURVEY 2.D bound to the views."""

from pyspark.sql import functions as F

from galley.functions.scalars import author_key
from galley.operators import aggs

from .bound_joins import DIFF, LEGACY, MARKS, OUTER, legacy, marked
from .registry import bind

bind(
    "dashboard_totals",
    lambda v: aggs.dashboard_totals(v.journal, v.issue, v.article),
    """SELECT (SELECT count(*) FROM v_journal) AS journals, (SELECT count(*) FROM v_issue WHERE deleted_at IS NULL) AS issues, count(*) AS articles,
      count_if(payment_received = false) AS unpaid, count_if(has_review = false) AS no_review, count_if(edited = false) AS not_edited, count_if(has_expertise_act = false) AS no_expertise,
      count_if(coalesce(payment_received, true)) AS not_unpaid, count_if(has_review) AS not_no_review, count_if(edited) AS not_not_edited, count_if(has_expertise_act) AS not_no_expertise
    FROM v_article WHERE deleted_at IS NULL""",
)
bind(
    "articles_per_journal",
    lambda v: aggs.articles_per_journal(v.journal, v.issue, v.article),
    "SELECT j.name, count(*) AS count FROM v_article a JOIN v_issue i ON a.issue_id = i.id JOIN v_journal j ON i.journal_id = j.id WHERE a.deleted_at IS NULL AND i.deleted_at IS NULL GROUP BY j.name ORDER BY count DESC, name",
)
bind("journal_counts", lambda v: aggs.journal_counts(v.journal, v.issue, v.article).drop("journal_id"), f"SELECT j.name, count(DISTINCT i.id) AS issues, count(a.id) AS articles {OUTER} GROUP BY j.id, j.name")
bind("issues_per_year", lambda v: aggs.issues_per_year(v.issue, 7), "SELECT year, count(*) AS n FROM v_issue WHERE deleted_at IS NULL AND journal_id = 7 AND year > 0 GROUP BY year")
bind("distinct_authors", lambda v: aggs.distinct_authors(v.article_author), "SELECT count(DISTINCT full_name) AS n FROM v_article_author")
bind("distinct_authors_approximate", lambda v: aggs.distinct_authors(v.article_author, approximate=True))
DIRECTORY = "SELECT min(full_name) AS name, min(email) AS email, min(organization) AS organization, count(DISTINCT article_id) AS articles FROM v_article_author GROUP BY lower(full_name)"
bind("author_directory", lambda v: aggs.author_directory(v.article_author), DIRECTORY)
bind("sorted_directory", lambda v: aggs.author_directory(v.article_author, sort="-articles"), f"SELECT * FROM ({DIRECTORY}) ORDER BY articles DESC, name")
bind(
    "author_entities",
    lambda v: aggs.author_entities(v.article_author, author_key(F.col("full_name"))).select("entity", "name", F.size("variants").cast("long").alias("variants"), F.array_join("organizations", "|").alias("organizations"), F.array_join(F.slice(F.col("articles"), 1, 3).cast("array<string>"), ",").alias("newest")),
    """WITH a AS (SELECT *, coalesce(lower(email), lower(split_part(full_name, ' ', 2)) || '_' || lower(left(full_name, 1)) || lower(left(full_name, 1))) AS entity FROM v_article_author)
    SELECT entity, (list_sort(list(DISTINCT {'l': -length(full_name), 'n': full_name}))[1]).n AS name, count(DISTINCT full_name) - 1 AS variants,
      array_to_string([x.n FOR x IN list_sort(list(DISTINCT {'l': -length(organization), 'n': organization}))[1:2]], '|') AS organizations,
      array_to_string(list_reverse_sort(list(DISTINCT article_id))[1:3], ',') AS newest FROM a GROUP BY entity""",
)
bind(
    "author_profile",
    lambda v: aggs.author_profile(v.article_author, ["full_name", "email", "organization"]).withColumnRenamed("full_name", "name"),
    """SELECT lower(full_name) AS key, min_by(full_name, article_id * 1000 + ord) AS name, min_by(email, article_id * 1000 + ord) FILTER (email IS NOT NULL) AS email, min_by(organization, article_id * 1000 + ord) AS organization
    FROM v_article_author GROUP BY lower(full_name)""",
)
PARSED = "SELECT p.issue_id AS batch, p.id AS file, CASE WHEN p.doi IS NOT NULL THEN j.issn END AS issn, i.year, CASE WHEN p.id % 4 = 0 THEN 99 ELSE i.number END AS number, CASE WHEN p.id % 6 = 0 THEN 'Other' ELSE j.name END AS journal, concat('', CAST(p.id % 2 AS string)) AS volume FROM v_pub_article p JOIN v_issue i ON p.issue_id = i.id JOIN v_journal j ON i.journal_id = j.id"
bind(
    "detect_issue",
    lambda v: aggs.detect_issue(v.sql(PARSED)),
    f"""WITH p AS ({PARSED}),
    k AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY n DESC, issn, year, number) AS r FROM (SELECT batch, issn, year, number, count(*) AS n FROM p WHERE issn IS NOT NULL GROUP BY ALL)),
    j AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY n DESC, journal) AS r FROM (SELECT batch, journal, count(*) AS n FROM p GROUP BY ALL)),
    w AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY n DESC, volume) AS r FROM (SELECT batch, volume, count(*) AS n FROM p GROUP BY ALL))
    SELECT k.batch, k.issn, k.year, k.number, j.journal, w.volume, (SELECT count(*) FROM p WHERE p.batch = k.batch AND p.issn IS NOT NULL AND (p.issn <> k.issn OR p.year <> k.year OR p.number <> k.number)) AS odd
    FROM k JOIN j ON j.batch = k.batch AND j.r = 1 JOIN w ON w.batch = k.batch AND w.r = 1 WHERE k.r = 1""",
)
bind(
    "kinds_summary",
    lambda v: aggs.kinds_summary(v.snap_new.select(F.split("path", "/")[0].alias("journal"), "path")),
    "SELECT journal, string_agg(kind || ' ' || CAST(n AS varchar), ', ' ORDER BY n DESC, kind) AS kinds FROM (SELECT split_part(path, '/', 1) AS journal, CASE WHEN suffix(path, '.pdf') THEN 'pdf' ELSE 'doc' END AS kind, count(*) AS n FROM v_snap_new GROUP BY 1, 2) GROUP BY journal",
)
bind(
    "mark_counts",
    lambda v: aggs.mark_counts(marked(v)),
    f"SELECT journal, count_if(state = 'pushed') AS pushed, count_if(state = 'loaded') AS loaded, count_if(state = 'missing') AS missing, count_if(state = 'nojournal') AS nojournal FROM ({MARKS}) GROUP BY journal",
)
bind("top_authors", lambda v: aggs.top_authors(v.article_author), "SELECT full_name AS name, count(*) AS n FROM v_article_author GROUP BY full_name ORDER BY n DESC, name LIMIT 10")
bind("import_stats", lambda v: aggs.import_stats(legacy(v)), f"SELECT coalesce(reason, 'created') AS reason, count(*) AS n FROM ({LEGACY}) GROUP BY 1")
bind(
    "publish_overview",
    lambda v: aggs.publish_overview(v.journal.filter("id <> 3"), v.draft_issue.filter("issn < '1020'"), v.pub_article),
    """WITH d AS (SELECT issn, count(*) AS issues, CAST(sum((SELECT count(*) FROM v_pub_article p WHERE p.issue_id = i.id)) AS bigint) AS articles FROM v_draft_issue i WHERE issn < '1020' GROUP BY issn)
    SELECT coalesce(j.issn, d.issn) AS issn, coalesce(j.name, j.issn, d.issn) AS name, coalesce(issues, 0) AS issues, coalesce(articles, 0) AS articles
    FROM (SELECT * FROM v_journal WHERE id <> 3) j FULL JOIN d ON j.issn = d.issn WHERE issues IS NOT NULL OR coalesce(is_hidden, false) = false""",
)
bind(
    "sheet_totals",
    lambda v: aggs.sheet_totals(v.article),
    "SELECT "
    + ", ".join(f"CAST(count_if(coalesce({c}, false)) AS varchar) || '/' || CAST(count(*) AS varchar) AS {c}" for c in ("payment_received", "has_review", "edited", "has_expertise_act"))
    + " FROM v_article WHERE deleted_at IS NULL",
)
bind("author_string", lambda v: aggs.author_string(v.article_author), "SELECT article_id, authors AS names FROM v_author_string")
CODES = "SELECT article_id, ord, CASE WHEN ord % 5 <> 4 THEN concat('0000-0001-', CAST(1000 + person % 7 AS string), '-0001') END AS orcid FROM v_author"
bind(
    "duplicate_orcid",
    lambda v: aggs.duplicate_orcid(v.sql(CODES)),
    f"""WITH c AS ({CODES}), n AS (SELECT *, count(orcid) OVER (PARTITION BY article_id, orcid) AS n FROM c)
    SELECT article_id, ord, CASE WHEN n = 1 THEN orcid END AS orcid, CASE WHEN n > 1 THEN 'same code: ' || orcid END AS warning FROM n""",
)
bind(
    "folder_rollup",
    lambda v: aggs.folder_rollup(v.snap_new),
    "SELECT folder, count(*) AS n FROM (SELECT unnest([split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2), split_part(path, '/', 1) || '/' || split_part(path, '/', 2) || '/' || split_part(path, '/', 3), split_part(path, '/', 1) || '/' || split_part(path, '/', 2) || '/' || split_part(path, '/', 3) || '/doc']) AS folder FROM v_snap_new) GROUP BY folder",
)
for flag in (True, False):
    bind(
        "journal_issue_counts" + ("" if flag else "_visible"),
        lambda v, flag=flag: aggs.journal_issue_counts(v.issue, v.article, 5, 1996, flag),
        f"SELECT i.id, i.number, (SELECT count(*) FROM v_article a WHERE a.issue_id = i.id {'' if flag else 'AND a.deleted_at IS NULL'}) AS n FROM v_issue i WHERE i.deleted_at IS NULL AND journal_id = 5 AND year = 1996",
    )
bind("journal_article_counts", lambda v: aggs.journal_article_counts(v.issue, v.article), "SELECT i.journal_id, count(*) AS n FROM v_article a JOIN v_issue i ON a.issue_id = i.id GROUP BY i.journal_id")
bind(
    "digest_groups",
    lambda v: aggs.digest_groups(v.snap_old, v.snap_new),
    f"SELECT split_part(path, '/', 1) AS journal, split_part(path, '/', 3) AS issue, count_if(kind = 'added') AS added, count_if(kind = 'changed') AS changed, count_if(kind = 'removed') AS removed FROM ({DIFF}) GROUP BY 1, 2",
)
bind(
    "issue_stage",
    lambda v: aggs.issue_stage(
        v.issue,
        v.pub_article,
        v.pub_article.filter("id % 3 <> 0").select(F.col("id").alias("article_id"), (F.col("id") % 2 == 0).alias("has_pdf"), F.when(F.col("id") % 5 == 0, "2001-01-01").alias("signed_at"), F.when(F.col("id") % 7 == 0, F.array(F.lit("e"))).otherwise(F.array().cast("array<string>")).alias("errors")),
        v.issue.filter("id % 2 = 0").select(F.col("id").alias("issue_id"), F.lit(1).cast("long").alias("n")),
    ),
    """SELECT i.id AS issue_id, count(p.id) AS articles, count(p.site_art_id) AS pushed, count(CASE WHEN p.id IS NOT NULL AND p.site_art_id IS NULL THEN 1 END) AS pending, count(CASE WHEN p.id % 3 <> 0 AND p.id % 2 = 0 THEN 1 END) AS with_pdf,
      count(CASE WHEN p.id % 3 <> 0 AND p.id % 5 = 0 THEN 1 END) AS signed, count(CASE WHEN p.id % 3 <> 0 AND p.id % 7 = 0 THEN 1 END) AS failed, CASE WHEN i.id % 2 = 0 THEN 1 ELSE 0 END AS misordered
    FROM v_issue i LEFT JOIN v_pub_article p ON p.issue_id = i.id GROUP BY i.id""",
)
