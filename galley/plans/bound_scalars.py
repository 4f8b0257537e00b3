"""SURVEY 2.H: every scalar function over a table column."""

from pyspark.sql import functions as F

from galley.functions import scalars as s

from .registry import bind

REFS = "SELECT article_id, pos, ru, en FROM v_ref"


def _texts(v, column: str):
    return v.documents.select("doc_id", F.col("text").alias(column))


LOW = "replace(lower({}), 'ё', 'е')"


def _sql_translit(c: str) -> str:
    out = LOW.format(c)
    for old, new in s.SEVERAL:
        out = f"replace({out}, '{old}', '{new}')"
    return f"translate({out}, '{s.SINGLE[0]}', '{s.SINGLE[1]}')"


def _sql_skeleton(c: str) -> str:
    several, single = s.skeleton_steps()
    out = f"lower({c})"
    for spelling, letter in several:
        out = f"replace({out}, '{spelling}', '{letter}')"
    return f"regexp_replace(translate({out}, '{single[0]}', '{single[1]}'), '[^a-z0-9]', '', 'g')"


bind("fold_text", lambda v: v.ref.select("article_id", "pos", s.fold_text(F.col("ru")).alias("folded")), f"SELECT article_id, pos, {LOW.format('ru')} AS folded FROM v_ref")
bind(
    "compare_norm",
    lambda v: v.ref.select("article_id", "pos", s.compare_norm(F.concat("ru", F.lit(" № 5"))).alias("norm")),
    f"SELECT article_id, pos, regexp_replace({LOW.format('''replace(ru || ' № 5', '№', 'no')''')}, '[^0-9a-zа-я]', '', 'g') AS norm FROM v_ref",
)
bind("name_norm", lambda v: v.article.select("id", s.name_norm(F.col("title")).alias("norm")), "SELECT id, regexp_replace(lower(title), '[^0-9a-zа-яё]', '', 'g') AS norm FROM v_article")
bind("translit_ru", lambda v: v.ref.select("article_id", "pos", s.translit_ru(F.col("ru")).alias("latin")), f"SELECT article_id, pos, {_sql_translit('ru')} AS latin FROM v_ref")
bind("translit_skeleton", lambda v: v.ref.select("article_id", "pos", s.translit_skeleton(F.col("ru")).alias("skeleton")), f"SELECT article_id, pos, {_sql_skeleton('ru')} AS skeleton FROM v_ref")
bind(
    "bigram_dice",
    lambda v: v.ref.select("article_id", "pos", F.round(s.bigram_dice(s.translit_skeleton(F.col("ru")), s.translit_skeleton(F.coalesce("en", F.lit("")))), 6).alias("dice")),
    f"""WITH k AS (SELECT article_id, pos, {_sql_skeleton('ru')} AS a, {_sql_skeleton("coalesce(en, '')")} AS b FROM v_ref),
    g AS (SELECT article_id, pos, list_distinct([a[i:i+1] FOR i IN range(1, length(a))]) AS x, list_distinct([b[i:i+1] FOR i IN range(1, length(b))]) AS y FROM k)
    SELECT article_id, pos, round(CASE WHEN len(x) + len(y) > 0 THEN 2.0 * len(list_intersect(x, y)) / (len(x) + len(y)) ELSE 0 END, 6) AS dice FROM g""",
)
bind(
    "homoglyph_fix",
    lambda v: v.ref.select("article_id", "pos", s.homoglyph_fix(F.translate(F.split("ru", " ")[0], "аеор", "aeop")).alias("word")),
    "SELECT article_id, pos, translate(translate(split_part(ru, ' ', 1), 'аеор', 'aeop'), 'ABEKMHOPCTXaeopcyx', 'АВЕКМНОРСТХаеорсух') AS word FROM v_ref",
)
bind(
    "author_key",
    lambda v: v.article_author.select("article_id", "ord", s.author_key(F.col("full_name")).alias("key")),
    "SELECT article_id, ord, lower(split_part(full_name, ' ', 2)) || '_' || lower(left(full_name, 1)) || lower(left(full_name, 1)) AS key FROM v_article_author",
)
bind(
    "clean_text",
    lambda v: v.documents.select("doc_id", F.sha2(s.clean_text(F.concat(F.lit("a\r\nb  c ,d\t EMBED \n "), "text")), 256).alias("digest")),
    r"""SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace('a' || chr(13) || chr(10) || 'b  c ,d' || chr(9) || ' EMBED ' || chr(10) || ' ' || text,
      '\r\n|\r|\x{2028}|\x{2029}', chr(10), 'g'), '(EMBED|MERGEFORMAT|HYPERLINK)( "[^"]*")?', '', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), '[ \t\x{00a0}]+', ' ', 'g'), ' +([,.;:])', '\1', 'g'), ' ?\n ?', chr(10), 'g'), ' ')) AS digest FROM documents""",
)


def _sql_entities(c: str) -> str:
    for old, new in s.ENTITIES:
        c = f"replace({c}, '{old}', '{new}')"
    return c


bind(
    "strip_html",
    lambda v: v.pages.select("page_id", F.sha2(s.strip_html(F.col("html")), 256).alias("digest")),
    "SELECT page_id, sha256(trim(regexp_replace(regexp_replace("
    + _sql_entities("regexp_replace(regexp_replace(html, '(?i)<br[^>]*>|</p>', chr(10), 'g'), '<[^>]*>', '', 'g')")
    + r", '[ \t]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ')) AS digest FROM pages",
)
bind(
    "escape_html",
    lambda v: v.pages.select("page_id", F.md5(s.escape_html(F.col("html"))).alias("digest")),
    "SELECT page_id, md5(replace(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '«', '&laquo;'), '»', '&raquo;'), '–', '&ndash;')) AS digest FROM pages",
)
bind(
    "plural_form",
    lambda v: v.article.select("id", s.plural_form(F.col("id"), "статья", "статьи", "статей").alias("form")),
    "SELECT id, CASE WHEN id % 10 = 1 AND id % 100 <> 11 THEN 'статья' WHEN id % 10 BETWEEN 2 AND 4 AND id % 100 NOT BETWEEN 12 AND 14 THEN 'статьи' ELSE 'статей' END AS form FROM v_article",
)
bind(
    "date_parts",
    lambda v: v.article.select("id", F.when(F.col("id") % 10 == 0, "31.02.2001").otherwise(F.date_format("submitted_at", "dd.MM.yyyy")).alias("d")).select("id", "d", s.iso_date(F.col("d")).alias("iso"), s.ru_date(F.coalesce(s.iso_date(F.col("d")), F.col("d"))).alias("back")),
    "WITH x AS (SELECT id, CASE WHEN id % 10 = 0 THEN '31.02.2001' ELSE strftime(submitted_at, '%d.%m.%Y') END AS d, submitted_at FROM v_article) SELECT id, d, CASE WHEN id % 10 <> 0 THEN strftime(submitted_at, '%Y-%m-%d') END AS iso, d AS back FROM x",
)
bind(
    "msk_time",
    lambda v: v.events.select("event_id", s.msk_time(F.col("ts").cast("timestamp")).alias("msk")),
    "SELECT event_id, strftime(timezone('Europe/Moscow', timezone('UTC', ts)), '%d.%m.%Y %H:%M') AS msk FROM events",
)
bind(
    "human_size",
    lambda v: v.snap_new.select("path", s.human_size(F.col("size") * 7).alias("shown")),
    "SELECT path, CASE WHEN size * 7 < 1024 THEN CAST(size * 7 AS varchar) || ' Б' WHEN size * 7 < 1048576 THEN printf('%.1f', floor(size * 70 / 1024.0 + 0.5) / 10) || ' КБ' ELSE printf('%.1f', floor(size * 70 / 1048576.0 + 0.5) / 10) || ' МБ' END AS shown FROM v_snap_new",
)
bind(
    "split_keywords",
    lambda v: v.article.select("id", s.split_keywords(F.concat(F.lit("alpha (x, y), "), "title", F.lit(";  beta   gamma; «q, r» s,"))).alias("k")).select("id", F.array_join("k", "|").alias("keywords"), F.size("k").cast("long").alias("n")),
    "SELECT id, 'alpha (x, y)|' || title || '|beta gamma|«q, r» s' AS keywords, CAST(4 AS bigint) AS n FROM v_article",
)
bind(
    "expand_indices",
    lambda v: v.article.select("id", F.array_join(s.expand_indices(F.concat((F.col("id") % 5).cast("string"), F.lit(", "), (F.col("id") % 7 + 6).cast("string"), F.lit("-"), (F.col("id") % 7 + 8).cast("string"))), ",").alias("numbers")),
    "SELECT id, concat_ws(',', id % 5, id % 7 + 6, id % 7 + 7, id % 7 + 8) AS numbers FROM v_article",
)
bind(
    "extract_codes",
    lambda v: v.manuscript.select("doc_id", F.size(s.emails(F.col("text"))).cast("long").alias("emails"), F.coalesce(F.get(s.dois(F.col("text")), F.lit(0)), F.lit("")).alias("doi"), s.udk(F.col("text")).alias("udk"), F.size(s.orcids(F.col("text"))).cast("long").alias("orcids"), F.size(s.spins(F.col("text"))).cast("long").alias("spins")),
    "SELECT m.doc_id, 2 * (SELECT count(a.email) FROM v_author a WHERE a.article_id = m.doc_id) AS emails, coalesce(p.doi, '') AS doi, '539.2' AS udk, 0 AS orcids, CASE WHEN p.doi IS NULL THEN 0 ELSE 1 END AS spins FROM v_manuscript m JOIN v_pub_article p ON p.id = m.doc_id",
)
bind(
    "extract_pages",
    lambda v: v.sql("SELECT id, pages FROM v_pub_article").select("id", s.extract_pages(F.concat(F.lit("Иванов И.И. // Журнал. 2000. Т. 1. № 1. С. "), "pages", F.lit("."))).alias("found")),
    "SELECT id, pages AS found FROM v_pub_article",
)
bind(
    "parse_doi",
    lambda v: v.pub_article.select("id", s.parse_doi(F.col("doi")).alias("d")).select("id", "d.*"),
    "SELECT p.id, CASE WHEN doi IS NOT NULL THEN j.issn END AS issn, CASE WHEN doi IS NOT NULL THEN i.year END AS year, CASE WHEN doi IS NOT NULL THEN i.number END AS number, CAST(split_part(doi, '-', 3) AS int) AS seq FROM v_pub_article p JOIN v_issue i ON p.issue_id = i.id JOIN v_journal j ON i.journal_id = j.id",
)
bind(
    "issue_numbers",
    lambda v: v.issue.filter("year > 0").select("id", F.array_join(s.issue_numbers(F.concat(F.lit("Iss_"), F.col("number").cast("string"), F.lit("-"), (F.col("number") + 1).cast("string"), F.lit("(1) "), F.col("year").cast("string"))), ",").alias("numbers")),
    "SELECT id, CAST(number AS varchar) || ',' || CAST(number + 1 AS varchar) AS numbers FROM v_issue WHERE year > 0",
)
bind(
    "citation_tail",
    lambda v: v.pub_article.select("id", s.citation_tail(F.concat(F.lit("Иванов И.И. Название // Журнал "), F.col("id").cast("string"), F.lit(". 2000. Т. 12. № 1. С. "), "pages")).alias("t")).select("id", "t.journal", "t.volume"),
    "SELECT id, 'Журнал ' || CAST(id AS varchar) AS journal, '12' AS volume FROM v_pub_article",
)
bind(
    "path_parts",
    lambda v: v.snap_new.select("path", s.path_parts(F.concat(F.lit("\\"), F.replace("path", F.lit("/"), F.lit("//")))).alias("p")).select("path", "p.safe", "p.journal", "p.year", "p.folder"),
    "SELECT path, true AS safe, split_part(path, '/', 1) AS journal, split_part(path, '/', 2) AS year, split_part(path, '/', 3) AS folder FROM v_snap_new",
)
bind(
    "mask_secret",
    lambda v: v.customer.select("c_custkey", s.mask_secret(F.concat(F.lit("ftp://"), "c_name", F.lit(":pw"), F.col("c_custkey").cast("string"), F.lit("@host/x"))).alias("url")),
    "SELECT c_custkey, 'ftp://' || c_name || ':***@host/x' AS url FROM customer",
)
bind(
    "safe_filename",
    lambda v: v.snap_new.select("path", s.safe_filename(F.concat("path", F.lit("?:x"))).alias("name")),
    "SELECT path, split_part(path, '/', 5) || '__x' AS name FROM v_snap_new",
)
bind(
    "org_tail",
    lambda v: v.author.select("article_id", "ord", s.org_tail(F.when(F.col("ord") % 2 == 0, F.concat("organization", F.lit(" (Moscow, 2 Street, Russia)"))).otherwise(F.concat("organization", F.lit(" (MIT)")))).alias("o")).select("article_id", "ord", "o.org", "o.town", "o.country"),
    "SELECT article_id, ord, CASE WHEN ord % 2 = 0 THEN organization ELSE organization || ' (MIT)' END AS org, CASE WHEN ord % 2 = 0 THEN 'Moscow' ELSE '' END AS town, CASE WHEN ord % 2 = 0 THEN 'Russia' ELSE '' END AS country FROM v_author",
)
bind("sentence_case", lambda v: v.article.select("id", s.sentence_case(F.col("title")).alias("title")), "SELECT id, upper(left(title, 1)) || lower(substr(title, 2)) AS title FROM v_article")
bind(
    "is_initialism",
    lambda v: v.author.select("article_id", "ord", s.is_initialism(F.when(F.col("ord") % 2 == 0, F.concat(F.lit("io"), F.left(F.split("organization", " ")[2], F.lit(1)))).otherwise(F.lit("abc")), F.col("organization")).alias("fits")),
    "SELECT article_id, ord, ord % 2 = 0 AND length(organization) - length(replace(organization, ' ', '')) = 2 AS fits FROM v_author",
)
bind(
    "recent_flag",
    lambda v: v.snap_new.select("path", s.recent_flag(F.col("mtime"), F.lit("1998-08-02").cast("timestamp_ntz"), 60).alias("recent")),
    "SELECT path, mtime >= TIMESTAMP '1998-08-02' - INTERVAL 60 DAY AS recent FROM v_snap_new",
)
bind(
    "clean_none",
    lambda v: v.article.select("id", s.clean_none(F.when(F.col("id") % 3 == 0, " None ").when(F.col("id") % 3 == 1, F.concat(F.lit("  "), "title"))).alias("shown")),
    "SELECT id, CASE WHEN id % 3 = 1 THEN title ELSE '' END AS shown FROM v_article",
)
bind("fit_length", lambda v: v.article.select("id", s.fit_length(F.col("title"), 12).alias("title")), "SELECT id, left(title, 12) AS title FROM v_article")
bind(
    "search_description",
    lambda v: v.article_full.select("id", s.search_description(F.when(F.col("id") % 2 == 0, F.lit("волны")), F.when(F.col("id") % 3 == 0, F.lit("Журнал")), F.when(F.col("id") % 5 == 0, F.lit("не оплачено"))).alias("shown")),
    "SELECT id, concat_ws('; ', CASE WHEN id % 2 = 0 THEN 'поиск: волны' END, CASE WHEN id % 3 = 0 THEN 'журнал: Журнал' END, CASE WHEN id % 5 = 0 THEN 'статус: не оплачено' END) AS shown FROM v_article_full",
)
bind(
    "fit_digest",
    lambda v: v.documents.select("doc_id", F.sha2(s.fit_digest(F.col("text"), 300), 256).alias("digest")),
    r"SELECT doc_id, sha256(CASE WHEN length(text) <= 300 THEN text ELSE regexp_replace(left(text, 300), '\n[^\n]*$', '') END) AS digest FROM documents",
)
