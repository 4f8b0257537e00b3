"""SURVEY 2.C bound to the views."""

from pyspark.sql import functions as F

from galley.operators import joins

from .bound_scalars import _sql_skeleton
from .registry import bind

bind(
    "star_articles",
    lambda v: joins.star_articles(v.article, v.issue, v.journal).select("id", "title", "journal", "number", "year"),
    "SELECT a.id, a.title, j.name AS journal, i.number, i.year FROM v_article a JOIN v_issue i ON a.issue_id = i.id JOIN v_journal j ON i.journal_id = j.id WHERE a.deleted_at IS NULL AND i.deleted_at IS NULL",
)
OUTER = "FROM v_journal j LEFT JOIN v_issue i ON i.journal_id = j.id AND i.deleted_at IS NULL LEFT JOIN v_article a ON a.issue_id = i.id AND a.deleted_at IS NULL"
bind("journal_outer_counts", lambda v: joins.journal_outer_counts(v.journal, v.issue, v.article), f"SELECT j.name, count(*) AS rows {OUTER} GROUP BY j.name")
bind(
    "article_card",
    lambda v: joins.article_card(v.article, v.article_author, v.image, v.comment).select("article_id", "title", F.array_join("authors", ", ").alias("authors"), F.array_join("images", ", ").alias("images"), "comments"),
    """SELECT a.id AS article_id, a.title, coalesce(x.authors, '') AS authors, coalesce((SELECT string_agg(filename, ', ' ORDER BY ord) FROM v_image m WHERE m.article_id = a.id), '') AS images,
      (SELECT count(*) FROM v_comment c WHERE c.article_id = a.id) AS comments FROM v_article a LEFT JOIN v_author_string x ON x.article_id = a.id WHERE a.deleted_at IS NULL""",
)
bind(
    "articles_by_author_match",
    lambda v: joins.articles_by_author_match(v.article, v.article_author, "AUTHORba").select("id", "title"),
    "SELECT id, title FROM v_article WHERE deleted_at IS NULL AND id IN (SELECT article_id FROM v_article_author WHERE contains(lower(full_name), 'authorba'))",
)
bind(
    "missing_articles",
    lambda v: joins.missing_articles(v.pub_article.filter("id % 4 <> 0"), v.pub_article.withColumn("doi", F.concat(F.lit(" "), F.upper("doi")))).select("id"),
    "SELECT id FROM v_pub_article p WHERE NOT EXISTS (SELECT 1 FROM v_pub_article d WHERE d.id % 4 <> 0 AND d.doi = p.doi)",
)


def _prints(v):
    """Printed copies; every 13th stands twice, every 7th has its DOI only behind the first page."""
    base = v.print.select(F.col("doc_id").alias("print_id"), F.when(F.col("doc_id") % 7 == 0, "cover").otherwise(F.left("all_text", F.lit(600))).alias("first_page"), "all_text")
    again = base.filter("print_id % 13 = 0").withColumn("print_id", F.col("print_id") + 10_000_000)
    return base.unionByName(again)


SQL_PRINTS = """hit AS (SELECT DISTINCT doc_id AS print_id, lower(unnest(regexp_extract_all(all_text, '10\\.[0-9]{4,9}/[A-Za-z0-9._()/-]*[A-Za-z0-9]'))) AS doi FROM v_print),
found AS (SELECT print_id, doi FROM hit UNION ALL SELECT print_id + 10000000, doi FROM hit WHERE print_id % 13 = 0)"""
bind(
    "orphan_prints",
    lambda v: joins.orphan_prints(_prints(v), v.pub_article.filter("id % 5 <> 0")),
    f"WITH {SQL_PRINTS} SELECT DISTINCT print_id FROM found WHERE print_id NOT IN (SELECT print_id FROM found JOIN v_pub_article p ON p.doi = found.doi WHERE p.id % 5 <> 0)",
)
bind(
    "match_print",
    lambda v: joins.match_print(v.pub_article, _prints(v)),
    f"""WITH {SQL_PRINTS}, n AS (SELECT p.id, count(print_id) AS n, min(print_id) AS print_id FROM v_pub_article p LEFT JOIN found ON p.doi = found.doi GROUP BY p.id)
    SELECT id, CASE WHEN n = 1 THEN print_id END AS print_id, CASE WHEN n = 0 THEN 'none' WHEN n = 1 THEN 'found' ELSE 'ambiguous' END AS state FROM n""",
)
bind(
    "match_journal",
    lambda v: joins.match_journal(v.sql("SELECT CASE WHEN id % 3 = 0 THEN lower(name) WHEN id % 3 = 1 THEN name || ' (arch)' ELSE 'other ' || name END AS folder FROM v_journal"), v.journal),
    "SELECT CASE WHEN id % 3 = 0 THEN lower(name) ELSE name || ' (arch)' END AS folder, id AS journal_id FROM v_journal WHERE id % 3 = 0 OR id % 3 = 1 AND id >= 10",
)
OLD = "SELECT n_nationkey + 100 AS id, CASE WHEN n_nationkey % 3 = 0 THEN n_name WHEN n_nationkey % 3 = 1 THEN 'Journal ' || n_name || ' old' ELSE 'unknown' END AS name FROM nation"
bind(
    "map_legacy_journals",
    lambda v: joins.map_legacy_journals(v.sql(OLD), v.journal),
    f"""WITH o AS ({OLD}), ex AS (SELECT o.id AS old_id, min(j.id) AS exact_id FROM o JOIN v_journal j ON lower(o.name) = lower(j.name) GROUP BY o.id),
    pa AS (SELECT o.id AS old_id, j.id AS part_id, row_number() OVER (PARTITION BY o.id ORDER BY least(length(o.name), length(j.name)) DESC, j.id) AS r
      FROM o JOIN v_journal j ON lower(o.name) <> lower(j.name) AND (contains(lower(o.name), lower(j.name)) OR contains(lower(j.name), lower(o.name))))
    SELECT o.id AS old_id, coalesce(exact_id, part_id) AS new_id, CASE WHEN exact_id IS NOT NULL THEN 'exact' WHEN part_id IS NOT NULL THEN 'part' ELSE 'new' END AS how
    FROM o LEFT JOIN ex ON o.id = ex.old_id LEFT JOIN pa ON o.id = pa.old_id AND r = 1""",
)
bind(
    "author_org_link",
    lambda v: joins.author_org_link(
        v.author.select("article_id", "ord", F.array((F.col("ord") % 3 + 1).cast("int"), F.lit(2)).alias("idx")),
        v.article.select(F.col("id").alias("article_id"), F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])).alias("org_no")).select("article_id", "org_no", F.concat(F.lit("Org "), F.col("org_no").cast("string")).alias("org"), F.concat(F.lit("Town "), F.col("org_no").cast("string")).alias("town"), F.when(F.col("article_id") % 5 == 0, F.array().cast("array<int>")).otherwise(F.array(F.col("org_no").cast("int"))).alias("nums")),
    ),
    """SELECT a.article_id, ord, CASE WHEN article_id % 5 = 0 THEN 'Org 1; Org 2; Org 3' WHEN ord % 3 = 0 THEN 'Org 1; Org 2' WHEN ord % 3 = 1 THEN 'Org 2' ELSE 'Org 2; Org 3' END AS org,
      CASE WHEN article_id % 5 = 0 OR ord % 3 = 0 THEN 'Town 1' ELSE 'Town 2' END AS town FROM v_author a""",
)
bind(
    "author_email_link",
    lambda v: joins.author_email_link(
        v.author.select("article_id", "ord", F.when(F.col("article_id") % 3 == 0, F.lit(1)).otherwise(F.col("ord")).alias("num")),
        v.author.select("article_id", F.col("ord").alias("email_no"), F.when(F.col("article_id") % 3 == 1, F.lit(None).cast("int")).otherwise(F.col("ord")).alias("num"), F.concat(F.lit("m"), F.col("ord").cast("string"), F.lit("@x.example")).alias("email")),
    ),
    "SELECT article_id, ord, 'm' || CAST(ord AS varchar) || '@x.example' AS email FROM v_author",
)
bind(
    "pair_bilingual_authors",
    lambda v: joins.pair_bilingual_authors(
        v.author.select("article_id", F.col("ord").alias("pos"), F.when(F.col("article_id") % 2 == 0, F.lit(1)).otherwise(F.col("ord") + 5).alias("num"), F.col("surname_ru").alias("name")),
        v.author.filter("ord <> 2").select("article_id", F.col("ord").alias("pos"), F.when(F.col("article_id") % 2 == 0, F.lit(1)).otherwise(F.col("ord") + 5).alias("num"), F.col("surname_en").alias("name")),
    ),
    """WITH r AS (SELECT article_id, surname_ru AS ru, CASE WHEN single THEN 1 WHEN article_id % 2 = 0 THEN ord ELSE ord + 5 END AS k FROM (SELECT *, article_id % 2 = 0 AND max(ord) OVER (PARTITION BY article_id) = 1 AS single FROM v_author)),
    e AS (SELECT article_id, surname_en AS en, CASE WHEN article_id % 2 = 0 THEN row_number() OVER (PARTITION BY article_id ORDER BY ord) ELSE ord + 5 END AS k FROM v_author WHERE ord <> 2)
    SELECT coalesce(r.article_id, e.article_id) AS article_id, CAST(coalesce(r.k, e.k) AS int) AS pair_key, ru, en FROM r FULL JOIN e ON r.article_id = e.article_id AND r.k = e.k""",
)
bind(
    "align_references",
    lambda v: joins.align_references(v.ref.select("article_id", "pos", F.col("ru").alias("text")), v.ref.filter("en IS NOT NULL").select("article_id", "pos", F.col("en").alias("text"))).select("article_id", "ru_pos", "en_pos", F.round("score", 6).alias("score")),
    f"""WITH RECURSIVE r AS (SELECT article_id, pos, left({_sql_skeleton('ru')}, 70) AS s FROM v_ref), e AS (SELECT article_id, pos, left({_sql_skeleton('en')}, 70) AS s FROM v_ref WHERE en IS NOT NULL),
    rg AS (SELECT article_id, pos, list_distinct([s[i:i+1] FOR i IN range(1, length(s))]) AS g FROM r), eg AS (SELECT article_id, pos, list_distinct([s[i:i+1] FOR i IN range(1, length(s))]) AS g FROM e),
    p AS (SELECT rg.article_id, rg.pos AS ru_pos, eg.pos AS en_pos, 2.0 * len(list_intersect(rg.g, eg.g)) / (len(rg.g) + len(eg.g)) AS score FROM rg JOIN eg ON rg.article_id = eg.article_id),
    c AS (SELECT article_id, list({{'ru': ru_pos, 'en': en_pos, 's': score}} ORDER BY ru_pos, en_pos) AS c FROM p WHERE score >= 0.5 GROUP BY article_id),
    t AS (SELECT article_id, c, CAST([] AS STRUCT(t bigint, p STRUCT(r bigint, e bigint, s double)[])[]) AS s FROM c UNION ALL
      SELECT article_id, c, list_append(s, {{'t': CAST(round(x.s * 1000000) AS bigint) + coalesce(m.t, 0), 'p': list_append(coalesce(m.p, []), {{'r': -x.ru, 'e': -x.en, 's': x.s}})}}) FROM
      (SELECT *, c[len(s) + 1] AS x, list_max([s[i] FOR i IN range(1, len(s) + 1) IF c[i].ru < c[len(s) + 1].ru AND c[i].en < c[len(s) + 1].en]) AS m FROM t WHERE len(s) < len(c))),
    b AS (SELECT article_id, unnest(list_max(s).p) AS p FROM t WHERE len(s) = len(c)),
    k AS (SELECT article_id, -p.r AS ru_pos, -p.e AS en_pos, p.s AS score FROM b),
    l AS (SELECT r.article_id, r.pos AS ru_pos, k.en_pos, k.score FROM r LEFT JOIN k ON r.article_id = k.article_id AND r.pos = k.ru_pos)
    SELECT coalesce(l.article_id, e.article_id) AS article_id, l.ru_pos, coalesce(l.en_pos, e.pos) AS en_pos, round(l.score, 6) AS score FROM l FULL JOIN e ON l.article_id = e.article_id AND l.en_pos = e.pos""",
)


def legacy(v):
    article = v.sql("SELECT id AS art_id, CASE WHEN id % 31 = 0 THEN ' ' ELSE title END AS art_name, CASE WHEN id % 23 = 0 THEN -5 ELSE issue_id END AS razd_id FROM v_article")
    section = v.sql("SELECT id AS razd_id, id AS number FROM v_issue")
    issue = v.sql("SELECT id AS num_id, journal_id AS jr_num, year AS num_year FROM v_issue WHERE id % 17 <> 0")
    return joins.legacy_chain(article, section, issue, v.sql("SELECT id AS journ_id FROM v_journal WHERE id < 24"))


LEGACY = """SELECT a.id AS art_id, j.id AS journal_id, CASE WHEN a.id % 31 = 0 THEN 'no title' WHEN a.id % 23 = 0 THEN 'no section' WHEN i.id IS NULL OR j.id IS NULL THEN 'no issue' WHEN i.year = 0 THEN 'no year' END AS reason
FROM v_article a LEFT JOIN v_issue i ON i.id = a.issue_id AND i.id % 17 <> 0 AND a.id % 23 <> 0 LEFT JOIN v_journal j ON j.id = i.journal_id AND j.id < 24"""
bind("legacy_chain", legacy, LEGACY)
TOC = "SELECT DISTINCT issue_id, CAST(split_part(pages, '-', 1) AS int) AS page, concat('S', CAST(CAST(split_part(pages, '-', 1) AS int) % 3 AS string)) AS section FROM v_pub_article WHERE id % 4 <> 0"
bind(
    "assign_sections",
    lambda v: joins.assign_sections(v.pub_article, v.sql(TOC)),
    "SELECT id, CASE WHEN id % 4 <> 0 THEN concat('S', CAST(CAST(split_part(pages, '-', 1) AS int) % 3 AS string)) END AS section FROM v_pub_article",
)
bind(
    "doi_conflicts",
    lambda v: joins.doi_conflicts(v.pub_article.filter("doi IS NOT NULL"), v.site_article).select("id", "doi"),
    "SELECT id, doi FROM v_pub_article p WHERE doi IS NOT NULL AND EXISTS (SELECT 1 FROM v_site_article s WHERE s.doi = 'https://doi.org/' || p.doi)",
)
bind(
    "find_or_create",
    lambda v: joins.find_or_create(v.issue.filter("year > 0").select("journal_id", "year"), v.sql("SELECT min(id) AS id, journal_id, year FROM v_issue WHERE year > 0 AND (journal_id + year) % 4 <> 0 GROUP BY journal_id, year"), ["journal_id", "year"]),
    """WITH d AS (SELECT min(id) AS id, journal_id, year FROM v_issue WHERE year > 0 AND (journal_id + year) % 4 <> 0 GROUP BY journal_id, year), k AS (SELECT DISTINCT journal_id, year FROM v_issue WHERE year > 0)
    SELECT journal_id, year, id, false AS created FROM d UNION ALL SELECT journal_id, year, (SELECT max(id) FROM d) + row_number() OVER (ORDER BY journal_id, year), true FROM k WHERE (journal_id + year) % 4 = 0""",
)
bind(
    "reconcile_stored",
    lambda v: joins.reconcile_stored(
        v.sql("SELECT p.id, p.doi, CASE WHEN p.id % 5 = 0 THEN concat(x.authors, '1 a') ELSE x.authors END AS authors FROM v_pub_article p JOIN v_author_string x ON x.article_id = p.id"),
        v.sql("SELECT p.id, CASE WHEN p.id % 7 = 0 THEN 'other' ELSE concat('https://doi.org/', p.doi) END AS doi, CASE WHEN p.id % 5 = 0 THEN concat(x.authors, '1a') WHEN p.id % 11 = 0 THEN 'x' ELSE x.authors END AS authors FROM v_pub_article p JOIN v_author_string x ON x.article_id = p.id"),
    ),
    "SELECT p.id, CASE WHEN p.id % 7 = 0 THEN 'skipped' WHEN p.id % 5 = 0 THEN 'changed' WHEN p.id % 11 = 0 THEN 'skipped' ELSE 'same' END AS state FROM v_pub_article p JOIN v_author_string x ON x.article_id = p.id",
)
DIFF = """SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS kind
FROM v_snap_old o FULL JOIN v_snap_new n ON o.path = n.path WHERE o.path IS NULL OR n.path IS NULL OR o.size <> n.size OR o.mtime <> n.mtime"""
bind("snapshot_diff", lambda v: joins.snapshot_diff(v.snap_old, v.snap_new), DIFF)
bind(
    "row_diff",
    lambda v: joins.row_diff(v.article, v.article.withColumn("edited", F.when(F.col("id") % 2 == 0, ~F.col("edited")).otherwise(F.col("edited"))).withColumn("title", F.when(F.col("id") % 3 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title"))), ["title", "edited"]),
    """SELECT id, 'title' AS field, left(title, 100) AS old, left(title || '!', 100) AS new FROM v_article WHERE id % 3 = 0
    UNION ALL SELECT id, 'edited', CASE WHEN edited THEN 'on' ELSE 'off' END, CASE WHEN edited THEN 'off' ELSE 'on' END FROM v_article WHERE id % 2 = 0""",
)


def marked(v):
    folder = v.sql("SELECT DISTINCT concat(j.name, CASE WHEN j.id % 6 = 5 THEN ' unknown journal' ELSE '' END) AS journal, i.year, concat('Iss_', CAST(i.number AS string)) AS folder, i.number FROM v_issue i JOIN v_journal j ON i.journal_id = j.id WHERE i.year > 0")
    folder = folder.withColumn("journal", F.when(F.col("journal").contains("unknown"), F.concat(F.lit("x"), "journal")).otherwise(F.col("journal"))).withColumn("nums", F.array("number"))
    issue = v.draft_issue.select("issn", "year", F.array(F.col("number").cast("int")).alias("nums"), "pushed_at")
    return joins.mark_folders(folder, issue, v.journal)


MARKS = """SELECT CASE WHEN j.id % 6 = 5 THEN 'x' || j.name || ' unknown journal' ELSE j.name END AS journal, i.year, 'Iss_' || CAST(i.number AS varchar) AS folder,
CASE WHEN j.id % 6 = 5 THEN 'nojournal' WHEN i.id % 5 = 0 THEN 'missing' WHEN i.id % 3 = 0 THEN 'pushed' ELSE 'loaded' END AS state FROM v_issue i JOIN v_journal j ON i.journal_id = j.id WHERE i.year > 0"""
bind("mark_folders", marked, MARKS)
bind(
    "registry_link",
    lambda v: joins.registry_link(v.pub_article.filter("doi IS NOT NULL"), v.sql("SELECT doi, concat('file-', CAST(issue_id AS string), CASE WHEN issue_id % 4 = 1 AND id % 2 = 0 THEN '-b' ELSE '' END) AS file_uid FROM v_pub_article WHERE doi IS NOT NULL AND NOT (issue_id % 4 = 2 AND id % 3 = 0)")),
    """WITH p AS (SELECT *, CASE WHEN NOT (issue_id % 4 = 2 AND id % 3 = 0) THEN 'file-' || CAST(issue_id AS varchar) || CASE WHEN issue_id % 4 = 1 AND id % 2 = 0 THEN '-b' ELSE '' END END AS f FROM v_pub_article WHERE doi IS NOT NULL),
    g AS (SELECT issue_id, count(*) AS n, count(f) AS k, count(DISTINCT f) AS files, min(f) AS f FROM p GROUP BY issue_id)
    SELECT issue_id, CASE WHEN k = n AND files = 1 THEN f END AS file_uid, CASE WHEN k < n THEN 'not all in the registry' WHEN files > 1 THEN 'in several files' END AS reason FROM g""",
)
