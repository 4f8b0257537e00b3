"""SURVEY 2.A and 2.L bound to the views."""

from __future__ import annotations


from pyspark.sql import functions as F

from galley.operators import aggs, grams, joins, maintenance, mining, publishing, sketches, windows
from galley.sources import exports, paging, records, text
from galley.sources.versions import Change, Tables, changed_parts
from galley.streaming import jobs

from . import bound_filters  # noqa: F401  (its SQL is used again)
from .bound_joins import DIFF
from .bound_maintenance import AUTHORS, IDS, now, state
from .registry import SQL, bind
from .views import BASE, scratch


bind("scan_tables", lambda v: text.table_profile({t: getattr(v, t) for t in BASE}).select("table", "n_rows"), " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n_rows FROM {t}" for t in BASE))
bind("table_profile", lambda v: text.table_profile({t: getattr(v, t) for t in ("article", "issue", "journal")}).select("table", "n_rows", F.size("sample").alias("shown")), " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n_rows, CAST(least(count(*), 3) AS int) AS shown FROM v_{t}" for t in ("article", "issue", "journal")))
bind(
    "sql_dump_ingest",
    lambda v: text.sql_dump_ingest(v.article.select(F.concat(F.lit("INSERT INTO `articles` VALUES ("), F.col("id").cast("string"), F.lit(",NULL,'"), F.replace("title", F.lit("study"), F.lit("st\\'udy")), F.lit("',1,2,3,4,5,6,7,8,'a, (b)'),("), F.col("id").cast("string"), F.lit(",2),(7,NULL,'x',1,2,3,4,5,6,7,8,9);")).alias("value"))).select("table", F.col("cols")[0].alias("a"), F.col("cols")[1].alias("b"), F.col("cols")[2].alias("c"), F.element_at("cols", -1).alias("d"), F.size("cols").alias("n")),
    "SELECT 'articles' AS \"table\", CAST(id AS varchar) AS a, CAST(NULL AS varchar) AS b, replace(title, 'study', 'st''udy') AS c, 'a, (b)' AS d, 12 AS n FROM v_article UNION ALL SELECT 'articles', '7', NULL, 'x', '9', 12 FROM v_article",
)
bind(
    "listing_parse",
    lambda v: text.listing_parse(v.listing, "1999-01-01").select("name", "is_dir", "size", "mtime"),
    "SELECT path AS name, false AS is_dir, size, CAST(CASE WHEN size % 2 = 0 THEN date_trunc('day', mtime) ELSE date_trunc('day', mtime) + INTERVAL '14 hours 30 minutes' END AS timestamp) AS mtime FROM v_snap_new",
)
bind("history_read", lambda v: records.history_read(v.history, 3), "SELECT article_id, 'value' AS field, '0' AS old, CAST(CAST(floor(value) AS bigint) AS varchar) AS new, ts AS at FROM (SELECT *, event_id % 1000 AS article_id, row_number() OVER (PARTITION BY event_id % 1000 ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 3")
PEOPLE = "SELECT article_id, ord, surname_ru, surname_en, concat(ini, '.') AS initials, CASE WHEN ord % 2 = 0 THEN '0000-0001-0002-0003' ELSE '' END AS orcid FROM v_author"
bind(
    "registry_json_read",
    lambda v: records.registry_json_read(
        v.sql("SELECT p.id, p.doi, a.title, p.pages FROM v_pub_article p JOIN v_article a ON a.id = p.id").join(v.author.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("ord", "surname_ru", "surname_en"))).alias("p")), F.col("id") == F.col("article_id")).select(
            F.to_json(F.struct("doi", F.struct("title", "pages", F.transform("p", lambda x: F.struct(x["surname_ru"].alias("surname"))).alias("authors")).alias("RUS"), F.struct(F.lower("title").alias("title"), F.transform("p", lambda x: F.struct(x["surname_en"].alias("surname"))).alias("authors")).alias("ENG"))).alias("payload")
        )
    ).select("doi", "title_ru", "title_en", "pages", F.array_join(F.transform("authors", lambda a: F.concat_ws("/", a["surname_ru"], a["surname_en"])), ";").alias("authors")),
    "SELECT p.doi, a.title AS title_ru, lower(a.title) AS title_en, p.pages, (SELECT string_agg(surname_ru || '/' || surname_en, ';' ORDER BY ord) FROM v_author w WHERE w.article_id = p.id) AS authors FROM v_pub_article p JOIN v_article a ON a.id = p.id WHERE p.id IN (SELECT article_id FROM v_author)",
)
REPORT = "SELECT a.*, j.name AS journal FROM v_article_full a JOIN v_journal j ON j.id = a.journal_id"
MARKS = ", ".join(f"CASE WHEN coalesce({c}, false) THEN '{{}}' ELSE '{{}}' END AS {c}" for c in ("payment_received", "has_review", "edited", "has_expertise_act"))
bind(
    "articles_csv",
    lambda v: exports.articles_csv_frame(v.sql(REPORT)),
    f"SELECT row_number() OVER (ORDER BY a.id DESC) AS n, title, coalesce(authors, '-') AS authors, j.name AS journal, {MARKS.replace('{}', '✓', 1).replace('{}', '✗', 1).replace('{}', '✓', 1).replace('{}', '✗', 1).replace('{}', '✓', 1).replace('{}', '✗', 1).replace('{}', '✓', 1).replace('{}', '✗', 1)} FROM v_article_full a JOIN v_journal j ON j.id = a.journal_id",
)
SIGNS = ", ".join(f"CASE WHEN coalesce({c}, false) THEN '+' ELSE '' END AS {c}" for c in ("payment_received", "has_review", "edited", "has_expertise_act"))
TOTALS = ", ".join(f"CAST(count(CASE WHEN {c} THEN 1 END) AS varchar) || '/' || CAST(count(*) AS varchar)" for c in ("payment_received", "has_review", "edited", "has_expertise_act"))
bind("articles_sheet", lambda v: exports.articles_sheet(v.article), f"SELECT row_number() OVER (ORDER BY id DESC) AS place, title, {SIGNS} FROM v_article UNION ALL SELECT count(*) + 1, 'total', {TOTALS} FROM v_article")
DRAFTS = "SELECT p.id, p.issue_id, concat('S', CAST(p.id % 3 AS string)) AS section, p.pages, p.doi, a.title AS title_ru, lower(a.title) AS title_en, '' AS fulltext, CASE WHEN p.id % 2 = 0 THEN 'abstract' END AS abstract, CAST(p.id % 9 AS string) AS volume, p.site_art_id FROM v_pub_article p JOIN v_article a ON a.id = p.id"
PAGE = "CAST(split_part(pages, '-', 1) AS int)"
bind(
    "export_index_xml",
    lambda v: exports.export_index_frame(v.sql(DRAFTS), v.sql(PEOPLE), v.ref).select("issue_id", "place", "section", "pages", F.col("codes.doi").alias("doi"), "text", F.size("authors.author").alias("authors"), F.size("references.reference").alias("refs")),
    f"""WITH d AS ({DRAFTS}) SELECT issue_id, row_number() OVER (PARTITION BY issue_id ORDER BY {PAGE}, id) AS place, CASE WHEN row_number() OVER (PARTITION BY issue_id, section ORDER BY {PAGE}, id) = 1 THEN section END AS section, pages, doi, coalesce(abstract, title_ru) AS text,
      CAST((SELECT CASE WHEN count(*) > 0 THEN count(*) END FROM v_author w WHERE w.article_id = d.id) AS int) AS authors, CAST((SELECT CASE WHEN count(*) > 0 THEN count(*) END FROM v_ref w WHERE w.article_id = d.id) AS int) AS refs FROM d""",
)


def round_trip(v):
    """The index frame written as XML and read back as records."""
    path = scratch(v.spark, "index-xml")
    exports.write_xml(exports.export_index_frame(v.sql(DRAFTS).filter("doi IS NOT NULL"), v.sql(PEOPLE), v.ref).drop("issue_id", "place", "section"), path, compression="gzip")
    return records.journal_xml_read(v.spark, path)


bind(
    "journal_xml_read",
    lambda v: round_trip(v).select("doi", "first_page", "last_page", "title_ru", "title_en", F.coalesce(F.array_join(F.transform("authors", lambda a: F.concat_ws("/", a["surname_ru"], a["surname_en"])), ";"), F.lit("")).alias("authors"), F.coalesce(F.array_join(F.transform("references", lambda r: r["ru"]), ";"), F.lit("")).alias("refs")),
    """SELECT p.doi, split_part(pages, '-', 1) AS first_page, split_part(pages, '-', 2) AS last_page, a.title AS title_ru, lower(a.title) AS title_en,
      coalesce((SELECT string_agg(surname_ru || '/' || surname_en, ';' ORDER BY ord) FROM v_author w WHERE w.article_id = p.id), '') AS authors, coalesce((SELECT string_agg(ru, ';' ORDER BY pos) FROM v_ref w WHERE w.article_id = p.id), '') AS refs
    FROM v_pub_article p JOIN v_article a ON a.id = p.id WHERE p.doi IS NOT NULL""",
)
bind(
    "export_registry_xml",
    lambda v: exports.export_registry_frame(v.sql(DRAFTS).filter("doi IS NOT NULL"), v.sql(PEOPLE), joins.align_references(v.ref.select("article_id", "pos", F.col("ru").alias("text")), v.ref.filter("en IS NOT NULL").select("article_id", "pos", F.col("en").alias("text")))).select(F.col("codes.doi").alias("doi"), "volume", F.size("references.reference").alias("refs")),
)
bind(
    "export_deposit_xml",
    lambda v: exports.export_deposit_frame(v.sql(DRAFTS), v.sql(PEOPLE), v.ref, "https://journal.example/a?id=").select("doi_data.doi", "doi_data.resource", F.col("titles.title")[0].alias("title"), F.col("pages.first_page").alias("first_page"), F.array_join(F.transform("contributors.person_name", lambda p: F.concat_ws(" ", p["_sequence"], p["surname"], p["ORCID"])), ";").alias("people"), F.array_join(F.transform("citation_list.citation", lambda c: c["_key"]), ",").alias("refs")),
    """SELECT p.doi, 'https://journal.example/a?id=' || CAST(site_art_id AS varchar) AS resource, lower(a.title) AS title, split_part(pages, '-', 1) AS first_page,
      (SELECT string_agg(CASE WHEN ord = 1 THEN 'first ' ELSE 'additional ' END || surname_en || CASE WHEN ord % 2 = 0 THEN ' https://orcid.org/0000-0001-0002-0003' ELSE '' END, ';' ORDER BY ord) FROM v_author w WHERE w.article_id = p.id) AS people,
      (SELECT string_agg('ref' || CAST(pos AS varchar), ',' ORDER BY pos) FROM v_ref w WHERE w.article_id = p.id) AS refs FROM v_pub_article p JOIN v_article a ON a.id = p.id WHERE p.doi IS NOT NULL""",
)
bind("table_dump_xml", lambda v: exports.table_dump_frame({t: getattr(v, t) for t in ("journal", "issue", "article")}).select(F.col("_name").alias("name"), F.col("_rows").alias("n"), F.size("column").alias("columns")), "SELECT 'journal' AS name, count(*) AS n, 4 AS columns FROM v_journal UNION ALL SELECT 'issue', count(*), 6 FROM v_issue UNION ALL SELECT 'article', count(*), 10 FROM v_article")


def committed(v):
    """Two snapshots committed one after the other; the newest is read back."""
    path = scratch(v.spark, "snapshots")
    exports.snapshot_commit(v.snap_old, path, 0)
    exports.snapshot_commit(v.snap_new, path, 1)
    return exports.latest_snapshot(v.spark, path)


bind("snapshot_commit", lambda v: committed(v).select("path", "size", "mtime"), "SELECT path, size, mtime FROM v_snap_new")
bind("snapshot_retention", lambda v: exports.snapshot_retention(v.events.select("event_id", "ts"), F.lit("2024-01-15").cast("timestamp_ntz")).select("event_id", "keep"), "SELECT event_id, ts >= TIMESTAMP '2024-01-15' - INTERVAL 7 DAY AS keep FROM events")
bind(
    "export_names",
    lambda v: exports.export_names(v.sql("SELECT i.id, j.issn, j.name, i.number, i.year FROM v_issue i JOIN v_journal j ON j.id = i.journal_id WHERE i.year > 0"), v.sql("SELECT issn, concat('J', CAST(id AS string)) AS abbr FROM v_journal WHERE id % 3 = 0"), v.sql("SELECT name AS part, 'part' AS abbr FROM v_journal WHERE id = 1"), "idx"),
    "SELECT i.id, CASE WHEN j.id % 3 = 0 THEN 'J' || CAST(j.id AS varchar) WHEN contains(lower(j.name), (SELECT lower(name) FROM v_journal WHERE id = 1)) THEN 'part' ELSE left(regexp_replace(j.name, '[^0-9A-Za-z]', '', 'g'), 6) END || '_' || CAST(i.number AS varchar) || '_' || CAST(i.year AS varchar) || '_idx.xml' AS file FROM v_issue i JOIN v_journal j ON j.id = i.journal_id WHERE i.year > 0",
)
# ---- streams


def in_time(v, path: str, rows, column: str = "ts", files: int = 3) -> None:
    """Rows written as files one after the other, in the order of a time, as a log grows."""
    seconds = F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    cuts = rows.select(seconds.alias("s")).approxQuantile("s", [k / files for k in range(1, files)], 0.001)
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        own = (F.lit(True) if low is None else seconds > low) & (F.lit(True) if high is None else seconds <= high)
        rows.filter(own).coalesce(1).write.mode("append").parquet(path)


def replayed(v):
    """The activity stream run over the events in files, some of them delivered twice; a last event closes all windows before it."""
    source, out = scratch(v.spark, "events"), scratch(v.spark, "activity")
    in_time(v, source, v.events.unionByName(v.events.filter("event_id % 10 = 0")))
    last = v.events.agg((F.max("ts") + F.expr("INTERVAL 3 DAYS")).alias("ts")).withColumn("event_id", F.lit(-1))
    v.events.limit(0).unionByName(last, allowMissingColumns=True).coalesce(1).write.mode("append").parquet(source)
    jobs.activity_stream(v.spark, source, out, scratch(v.spark, "activity-check")).awaitTermination()
    return v.spark.read.parquet(out).select(F.col("start").cast("timestamp_ntz").alias("start"), "action", "n")


bind("activity_stream", replayed, "SELECT date_trunc('day', ts) AS start, event_type AS action, count(*) AS n FROM events GROUP BY 1, 2")


def merged(v):
    source, state = scratch(v.spark, "events"), scratch(v.spark, "state")
    v.events.repartition(3).write.parquet(source)
    jobs.latest_state_stream(v.spark, source, state, scratch(v.spark, "merge"), files_per_batch=1).awaitTermination()
    return jobs.current_states(v.spark, state)


bind("latest_state_stream", lambda v: merged(v).select("user_id", "state", "at", "event_id"), "SELECT user_id, event_type AS state, ts AS at, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")


def watched(v):
    """Two snapshots as a stream; the diff that was delivered."""
    source, out = scratch(v.spark, "watch"), scratch(v.spark, "delivered")
    v.snap_old.write.parquet(source)
    state, checkpoint = scratch(v.spark, "watch-state"), scratch(v.spark, "watch-check")
    deliver = lambda diff: diff.write.mode("overwrite").parquet(out)
    jobs.watch_stream(v.spark, source, v.snap_old.schema, state, checkpoint, deliver).awaitTermination()
    v.snap_new.write.mode("append").parquet(source)
    jobs.watch_stream(v.spark, source, v.snap_old.schema, state, checkpoint, deliver).awaitTermination()
    return v.spark.read.parquet(out)


bind("watch_stream", watched, DIFF)
bind(
    "digest",
    lambda v: jobs.digest(aggs.digest_groups(v.snap_old, v.snap_new), windows.latest_issue_per_journal(v.snap_new), 900),
    f"""WITH g AS (SELECT split_part(path, '/', 1) AS journal, split_part(path, '/', 3) AS issue, count_if(kind = 'added') AS a, count_if(kind = 'changed') AS c, count_if(kind = 'removed') AS r FROM ({DIFF}) GROUP BY 1, 2),
    t AS (SELECT string_agg(journal || ' ' || issue || ' ' || concat_ws(', ', CASE WHEN a > 0 THEN 'added ' || CAST(a AS varchar) END, CASE WHEN c > 0 THEN 'changed ' || CAST(c AS varchar) END, CASE WHEN r > 0 THEN 'removed ' || CAST(r AS varchar) END), chr(10)
      ORDER BY journal || ' ' || issue || ' ' || concat_ws(', ', CASE WHEN a > 0 THEN 'added ' || CAST(a AS varchar) END, CASE WHEN c > 0 THEN 'changed ' || CAST(c AS varchar) END, CASE WHEN r > 0 THEN 'removed ' || CAST(r AS varchar) END)) AS t FROM g)
    SELECT regexp_replace(left(t, 900), '\\n[^\\n]*$', '') AS text FROM t""",
)
STATUS = "SELECT concat('f', CAST(user_id % 50 AS string)) AS file_uid, ts AS seen, CAST(event_id % 4 + 1 AS int) AS status_code, event_id, concat('u', CAST(event_id % 3 AS string)) AS uid FROM events"
bind(
    "processing_progress",
    lambda v: jobs.processing_progress(v.sql(STATUS).select("file_uid", F.struct("seen", "event_id").alias("at"), "status_code", F.array(F.struct("uid", F.col("event_id").alias("n"))).alias("articles"))).select("file_uid", "status_code", F.array_join(F.transform("articles", lambda a: F.concat_ws(":", a["uid"], a["n"].cast("string"))), ",").alias("articles")),
    f"""WITH s AS ({STATUS}), l AS (SELECT file_uid, status_code, row_number() OVER (PARTITION BY file_uid ORDER BY seen DESC, event_id DESC) AS r FROM s), u AS (SELECT file_uid, uid, event_id, row_number() OVER (PARTITION BY file_uid, uid ORDER BY seen DESC, event_id DESC) AS r FROM s)
    SELECT l.file_uid, status_code, (SELECT string_agg(uid || ':' || CAST(event_id AS varchar), ',' ORDER BY uid) FROM u WHERE u.file_uid = l.file_uid AND u.r = 1) AS articles FROM l WHERE l.r = 1""",
)
def streamed_progress(v):
    """The same from a stream of messages in files, in their order of time."""
    source, out = scratch(v.spark, "status"), scratch(v.spark, "progress")
    rows = v.sql(STATUS).select("file_uid", F.col("seen").alias("at"), F.col("event_id").alias("seq"), "status_code", F.to_json(F.array(F.struct("uid", F.col("event_id").alias("n")))).alias("articles"))
    in_time(v, source, rows, "at")
    jobs.progress_stream(v.spark, source, out, scratch(v.spark, "progress-check"), files_per_batch=1).awaitTermination()
    articles = F.from_json("articles", "array<struct<uid:string,n:long>>")
    return jobs.current_progress(v.spark, out).select("file_uid", "status_code", F.array_join(F.transform(articles, lambda a: F.concat_ws(":", a["uid"], a["n"].cast("string"))), ",").alias("articles"))


bind("processing_progress_stream", streamed_progress, SQL["processing_progress"], views=False)
bind(
    "comment_thread",
    lambda v: jobs.comment_thread(v.comment).select("article_id", F.sha2(F.array_join(F.transform("thread", lambda x: F.concat_ws(":", x["seq"].cast("string"), x["user_name"], x["text"])), "|"), 256).alias("thread")),
    "SELECT article_id, sha256(string_agg(CAST(seq AS varchar) || ':' || user_name || ':' || text, '|' ORDER BY seq, user_name, text)) AS thread FROM v_comment GROUP BY article_id",
)
# ---- uploads: files rendered from the tables

UPLOADS = """SELECT concat('a', CAST(id AS string), CASE id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.txt' ELSE '.exe' END) AS name,
CASE WHEN id % 7 = 0 THEN 200000000 ELSE 1000 END AS len, CASE WHEN id % 8 < 3 THEN '%PDF-1.4 ' ELSE 'PK' END AS head, title FROM v_article"""


def uploads(v):
    zipped = F.concat(F.when(F.col("head") == "PK", F.unhex(F.lit("504B0304"))).otherwise(F.col("head").cast("binary")), F.col("title").cast("binary"))
    return v.sql(UPLOADS).select("name", F.col("len").cast("long").alias("len"), zipped.alias("sample"))


DETECTED = "CASE WHEN head = 'PK' THEN 'zip' ELSE 'pdf' END"
EXPECTED = "CASE WHEN suffix(name, '.pdf') THEN 'pdf' WHEN suffix(name, '.docx') THEN 'zip' WHEN suffix(name, '.txt') THEN 'text' END"
bind("upload_audit_scan", lambda v: records.upload_audit_scan(v.spark, f"{v.sf_dir}/benchmark.parquet").select("name", "len", F.length("sample").alias("sampled")))
bind("mime_audit", lambda v: mining.mime_audit(uploads(v)), f"SELECT name, {DETECTED} AS detected, {EXPECTED} AS expected, coalesce({DETECTED} = {EXPECTED}, false) AS ok FROM ({UPLOADS})")
bind(
    "upload_audit",
    lambda v: mining.upload_audit(uploads(v)),
    f"""WITH u AS (SELECT name, len, {DETECTED} AS d, {EXPECTED} AS e FROM ({UPLOADS}))
    SELECT name, e IS NOT NULL AS extension_ok, len <= 104857600 AS size_ok, coalesce(d = e, false) AS type_ok, CASE WHEN e IS NULL THEN 'extension' WHEN len > 104857600 THEN 'size' WHEN d <> e THEN 'type' ELSE 'accepted' END AS verdict FROM u""",
)


def encoded(v):
    """References in one of four charsets by their place."""
    for key in ("javaCharsets", "codingErrorAction"):
        v.spark.conf.set(f"spark.sql.legacy.{key}", "true")
    rows = v.ref.select(F.concat_ws("-", F.col("article_id").cast("string"), F.col("pos").cast("string")).alias("name"), "pos", "ru")
    content = F.when(F.col("pos") % 4 == 1, F.encode("ru", "windows-1251")).when(F.col("pos") % 4 == 2, F.encode("ru", "IBM866")).when(F.col("pos") % 4 == 3, F.encode("ru", "KOI8-R")).otherwise(F.encode("ru", "UTF-8"))
    return rows.select("name", content.alias("content"))


bind(
    "best_charset",
    lambda v: mining.best_charset(encoded(v)),
    "SELECT CAST(article_id AS varchar) || '-' || CAST(pos AS varchar) AS name, CASE pos % 4 WHEN 1 THEN 'windows-1251' WHEN 2 THEN 'IBM866' WHEN 3 THEN 'KOI8-R' ELSE 'UTF-8' END AS charset, ru AS text FROM v_ref",
)

# ---- stored tables: an index, pushes, changes of parts


def _indexed(v):
    tables = Tables(v.spark, scratch(v.spark, "search"))
    grams.build_search_index(tables, v.article_full, v.article_author)
    return grams.indexed_search(tables, v.article_full, v.article_author, v.journal, "TION_1", 120)


bind("search_all_indexed", _indexed, SQL["search_all"], views=False)
SITE_DRAFTS = """SELECT p.id, p.issue_id, i.journal_id, j.issn, i.year, cast(i.number AS string) AS number, CASE WHEN p.id % 4 < 3 THEN concat('S', cast(p.id % 4 AS string)) END AS section,
  a.title, p.pages, CASE WHEN p.id % 2 = 0 THEN p.doi END AS doi, concat('Цель. ', a.title) AS abstract
FROM v_pub_article p JOIN v_article a ON a.id = p.id JOIN v_issue i ON i.id = p.issue_id JOIN v_journal j ON j.id = i.journal_id WHERE p.site_art_id IS NULL"""
SITE_TABLES = {
    "site_issue": "SELECT id AS num_id, journal_id, year, cast(number AS string) AS number FROM v_issue WHERE id % 2 = 0 AND year > 0",
    "site_section": "SELECT DISTINCT p.issue_id * 10 + p.id % 4 AS razd_id, p.issue_id AS num_id, concat('S', cast(p.id % 4 AS string)) AS title, cast(p.id % 4 + 1 AS int) AS sort FROM v_pub_article p WHERE p.issue_id % 2 = 0 AND p.id % 4 < 3 AND p.site_art_id IS NOT NULL",
    "site_article": "SELECT p.site_art_id AS art_id, p.issue_id * 10 + p.id % 4 AS razd_id, p.doi, 'old' AS title, p.pages, '' AS authors_html, '' AS orgs_html, '' AS abstract_html, p.id AS draft_id FROM v_pub_article p WHERE p.issue_id % 2 = 0 AND p.id % 4 < 3 AND p.site_art_id IS NOT NULL",
    "push_record": "SELECT p.issue_id, p.id AS draft_id, p.id AS num_id, p.id AS razd_id, p.id AS art_id, p.doi, true AS num_created, true AS razd_created FROM v_pub_article p WHERE p.id < 0",
}
BLOCKED = "SELECT id AS issue_id FROM v_issue WHERE id % 3 = 0"


def _site(v):
    """The site with all drafts pushed that nothing stands against."""
    tables = Tables(v.spark, scratch(v.spark, "site"))
    tables.commit({name: Change(v.sql(text), key=publishing.KEYS[name], parts=8) for name, text in SITE_TABLES.items()}, -1, "load")
    publishing.push(tables, v.sql(SITE_DRAFTS), v.sql(AUTHORS), v.sql(BLOCKED))
    return tables


def _rolled_back(v):
    tables = _site(v)
    publishing.roll_back(tables, v.sql("SELECT id AS issue_id FROM v_issue WHERE id % 5 = 0"))
    return tables


PUSHED_ROWS = f"""si AS ({SITE_TABLES['site_issue']}), ss AS ({SITE_TABLES['site_section']}), sa AS ({SITE_TABLES['site_article']}), t AS ({SITE_DRAFTS}), d AS (SELECT * FROM t WHERE issue_id % 3 <> 0 AND issue_id NOT IN (SELECT issue_id FROM t WHERE id NOT IN (SELECT article_id FROM v_author))),
ni AS (SELECT (SELECT max(num_id) FROM si) + row_number() OVER (ORDER BY journal_id, year, number) AS num_id, journal_id, year, number FROM (SELECT DISTINCT journal_id, year, number FROM d ANTI JOIN si USING (journal_id, year, number))),
r AS (SELECT d.*, n.num_id, coalesce(section, 'Без раздела') AS sec FROM d JOIN (SELECT * FROM si UNION ALL SELECT num_id, journal_id, year, number FROM ni) n USING (journal_id, year, number)),
ns AS (SELECT (SELECT max(razd_id) FROM ss) + row_number() OVER (ORDER BY num_id, title) AS razd_id, num_id, title FROM (SELECT DISTINCT num_id, sec AS title FROM r ANTI JOIN ss ON ss.num_id = r.num_id AND ss.title = r.sec)),
have AS (SELECT num_id, count(*) AS n FROM sa JOIN ss USING (razd_id) GROUP BY num_id),
pushed AS (SELECT r.id, r.issue_id, r.num_id, s.razd_id, r.title, row_number() OVER (PARTITION BY r.num_id ORDER BY CAST(split_part(pages, '-', 1) AS int), id) AS place, coalesce(have.n, 0) AS have, r.doi, r.issn, r.year, r.number
  FROM r JOIN (SELECT razd_id, num_id, title FROM ss UNION ALL SELECT * FROM ns) s ON s.num_id = r.num_id AND s.title = r.sec LEFT JOIN have ON have.num_id = r.num_id),
numbered AS (SELECT *, (SELECT max(art_id) FROM sa) + row_number() OVER (ORDER BY num_id, place) AS art_id,
  coalesce(doi, '10.18127/j' || replace(issn, '-', '') || '-' || CAST(year AS varchar) || CASE WHEN length(number) < 2 THEN '0' ELSE '' END || number || '-' || CASE WHEN have + place < 10 THEN '0' ELSE '' END || CAST(have + place AS varchar)) AS new_doi FROM pushed)"""
bind(
    "push_issue_staged",
    lambda v: _site(v).read("site_article").select("art_id", "razd_id", "doi", "title", "draft_id"),
    f"WITH {PUSHED_ROWS} SELECT art_id, razd_id, doi, title, draft_id FROM sa UNION ALL SELECT art_id, razd_id, new_doi, title, id FROM numbered",
)
bind(
    "push_issue_staged_sections",
    lambda v: _site(v).read("site_section").select("razd_id", "num_id", "title", "sort"),
    f"WITH {PUSHED_ROWS} SELECT razd_id, num_id, title, sort FROM ss UNION ALL SELECT razd_id, num_id, title, CAST(coalesce((SELECT max(sort) FROM ss WHERE ss.num_id = ns.num_id), 0) + row_number() OVER (PARTITION BY num_id ORDER BY title) AS int) FROM ns",
)
bind(
    "push_rolled_back",
    lambda v: _rolled_back(v).read("site_article").select("art_id", "razd_id", "draft_id"),
    f"WITH {PUSHED_ROWS} SELECT art_id, razd_id, draft_id FROM sa UNION ALL SELECT art_id, razd_id, id FROM numbered WHERE issue_id % 5 <> 0",
)
bind(
    "push_rolled_back_issues",
    lambda v: _rolled_back(v).read("site_issue"),
    f"WITH {PUSHED_ROWS} SELECT num_id, journal_id, year, number FROM si UNION ALL SELECT num_id, journal_id, year, number FROM ni WHERE num_id IN (SELECT num_id FROM numbered WHERE issue_id % 5 <> 0)",
)


def _cascaded(v):
    """The article table after a cascade that wrote only the parts of the issues it hit."""
    tables, ids = Tables(v.spark, scratch(v.spark, "articles")), v.sql(IDS)
    tables.commit({"issue": Change(v.issue, key="id", parts=8), "article": Change(v.article, key="issue_id", parts=8)}, -1, "load")
    keys = {"issue": "id", "article": "issue_id"}
    tables.commit({n: changed_parts(tables, n, ids, lambda t, k=k: maintenance.soft_deleted(t, ids, now(), k)) for n, k in keys.items()}, 0, "delete")
    return tables


bind("soft_delete_parts", lambda v: _cascaded(v).read("article").select("id", state("deleted_at")), SQL["soft_delete_cascade"], views=False)


def _authors_by_year(v):
    """Distinct authors by journal and year from the stored sketches of issues, beside the exact numbers."""
    tables, by = Tables(v.spark, scratch(v.spark, "sketches")), ["journal_id", "year"]
    issue = v.issue.select(F.col("id").alias("issue_id"), *by)
    tables.commit({"issue": Change(sketches.author_sketches(v.article_author, v.article), key="issue_id", parts=8)}, -1, "load")
    exact = v.article_author.join(v.article.select(F.col("id").alias("article_id"), "issue_id"), "article_id").join(issue, "issue_id").groupBy(*by).agg(F.count_distinct(F.lower("full_name")).alias("n"))
    return sketches.compared(sketches.rolled_up(tables.read("issue").join(issue, "issue_id"), by), exact, by)


bind("authors_by_journal_year", _authors_by_year, "SELECT journal_id, year, count(DISTINCT lower(full_name)) AS n, true AS close FROM v_article_author x JOIN v_article a ON a.id = x.article_id JOIN v_issue i ON i.id = a.issue_id GROUP BY journal_id, year")


def _stored_page(v):
    path = scratch(v.spark, "pages")
    paging.store_pages(v.article.select("id", "title"), path, rows=500)
    return paging.Pages(v.spark, path).page(31, 40)


bind("page_of_stored", _stored_page, "SELECT id, title, (SELECT count(*) FROM v_article) AS total, CAST(ceil((SELECT count(*) FROM v_article) / 40.0) AS bigint) AS pages FROM v_article ORDER BY id DESC LIMIT 40 OFFSET 1200")
