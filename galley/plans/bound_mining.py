"""SURVEY 2.I bound to rendered manuscripts: what is mined is compared with the columns it was rendered from."""

from pyspark.sql import functions as F

from galley.operators import mining as m
from galley.operators import windows
from galley.operators.frontmatter import front_authors, front_matter
from galley.sources.text import manuscript_lines

from .bound_windows import LINES
from .registry import bind


def _lines(v):
    return manuscript_lines(v.manuscript)


MS_LINES = LINES.replace("FROM documents", "FROM v_manuscript")
bind("manuscript_lines", lambda v: manuscript_lines(v.documents).select("doc_id", "line_no", F.md5("line").alias("line")), f"WITH {LINES} SELECT doc_id, line_no, md5(line) AS line FROM lines")
NAMES = " ".join(f"WHEN '{h}' THEN '{s}'" for h, s in m.HEADINGS)
HEADED = f"""{MS_LINES}, headed AS (SELECT doc_id, line_no, line, CASE lower(line) {NAMES} END AS heading FROM lines),
segs AS (SELECT *, last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM headed)"""
bind("canon_headings", lambda v: m.canon_headings(_lines(v)).filter("heading IS NOT NULL").select("doc_id", "line_no", "heading"), f"WITH {HEADED} SELECT doc_id, line_no, heading FROM headed WHERE heading IS NOT NULL")
TEXTS = ", ".join(f"string_agg(line, chr(10) ORDER BY line_no) FILTER (section = '{s}') AS {s}" for s in m.SECTIONS)
bind("section_texts", lambda v: m.section_texts(v.manuscript), f"WITH {HEADED} SELECT doc_id, {TEXTS} FROM segs WHERE heading IS NULL AND section IS NOT NULL GROUP BY doc_id")


def _glue_sql(start: str, text: str) -> str:
    return f"""WITH {LINES}, b AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM lines),
    r AS (SELECT *, sum(CASE WHEN {start} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM b)
    SELECT doc_id, CAST(run AS bigint) AS run, md5({text}) AS text FROM r GROUP BY doc_id, run"""


AGG = "string_agg(line, ' ' ORDER BY line_no)"
bind(
    "glue_paragraphs",
    lambda v: m.glue_paragraphs(manuscript_lines(v.documents)).select("doc_id", F.col("run").cast("long").alias("run"), F.md5("text").alias("text")),
    _glue_sql(r"(before IS NULL OR regexp_matches(before, '[.!?:;]\s*$') OR before = '') AND NOT regexp_matches(line, '^(https?://|www\.)')", AGG),
)
bind(
    "dehyphenate_lines",
    lambda v: m.dehyphenate_lines(manuscript_lines(v.documents)).select("doc_id", F.col("run").cast("long").alias("run"), F.md5("text").alias("text")),
    _glue_sql("before IS NULL OR NOT (suffix(before, '-') OR regexp_matches(line, '^[а-яёa-z]'))", f"replace({AGG}, '- ', '')"),
)
bind(
    "split_references",
    lambda v: m.split_references(v.manuscript),
    """WITH ok AS (SELECT doc_id FROM v_manuscript), e AS (SELECT article_id, row_number() OVER (PARTITION BY article_id ORDER BY pos) AS k, en FROM v_ref WHERE en IS NOT NULL)
    SELECT article_id AS doc_id, 'ru' AS lang, pos, ru AS ref FROM v_ref WHERE article_id IN (SELECT doc_id FROM ok) UNION ALL SELECT article_id, 'en', CAST(k AS int), en FROM e WHERE article_id IN (SELECT doc_id FROM ok)""",
)
CUT = "SELECT article_id AS doc_id, 'ru' AS lang, 2 * pos - 1 AS pos, ru AS ref FROM v_ref UNION ALL SELECT article_id, 'ru', 2 * pos, '- vol. 2' FROM v_ref WHERE pos % 2 = 0 UNION ALL SELECT article_id, 'en', pos, coalesce(en, 'X') FROM v_ref"
bind(
    "repair_reference_lists",
    lambda v: m.repair_reference_lists(v.sql(CUT)),
    "SELECT article_id AS doc_id, 'ru' AS lang, pos, ru || CASE WHEN pos % 2 = 0 THEN ' - vol. 2' ELSE '' END AS ref FROM v_ref UNION ALL SELECT article_id, 'en', pos, coalesce(en, 'X') FROM v_ref",
)
bind(
    "title_lines",
    lambda v: m.title_lines(v.manuscript),
    "SELECT doc_id, lang, a.title FROM v_manuscript d JOIN v_article a ON a.id = d.doc_id, (SELECT unnest(['ru', 'en']) AS lang)",
)
bind(
    "author_tokens",
    lambda v: m.author_tokens(v.manuscript).select("doc_id", "lang", "pos", "surname", F.array_join("indices", ",").alias("indices")),
    "SELECT article_id AS doc_id, lang, ord AS pos, CASE lang WHEN 'ru' THEN surname_ru ELSE surname_en END AS surname, '1' AS indices FROM v_author, (SELECT unnest(['ru', 'en']) AS lang) WHERE article_id IN (SELECT doc_id FROM v_manuscript)",
)
bind(
    "org_chunks",
    lambda v: m.org_chunks(v.manuscript).select("doc_id", "lang", F.array_join("indices", ",").alias("indices"), "org", "town", "country"),
    "SELECT doc_id, lang, '1' AS indices, CASE lang WHEN 'ru' THEN 'Институт' ELSE 'Institute' END AS org, CASE lang WHEN 'ru' THEN 'Москва' ELSE 'Moscow' END AS town, CASE lang WHEN 'ru' THEN 'Россия' ELSE 'Russia' END AS country FROM v_manuscript, (SELECT unnest(['ru', 'en']) AS lang)",
)
bind(
    "surname_by_translit",
    lambda v: m.surname_by_translit(v.author.select("article_id", F.col("ord").alias("pos"), F.col("surname_ru").alias("surname")), v.author.select("article_id", F.explode(F.array("surname_en", "ini", F.lit("Institute"))).alias("word"))),
    "SELECT article_id, ord AS pos, surname_en AS word FROM v_author",
)
bind(
    "equalize_keywords",
    lambda v: m.equalize_keywords(v.article.select(F.col("id").alias("doc_id"), F.array(F.lit("сеть связи"), F.lit("сс"), F.lit("поле")).alias("ru"), F.when(F.col("id") % 2 == 0, F.array(F.lit("network"), F.lit("field"))).otherwise(F.array(F.lit("network"), F.lit("n"), F.lit("field"))).alias("en"))).select("doc_id", F.array_join("ru", "|").alias("ru"), F.array_join("en", "|").alias("en")),
    "SELECT id AS doc_id, CASE WHEN id % 2 = 0 THEN 'сеть связи, сс|поле' ELSE 'сеть связи|сс|поле' END AS ru, CASE WHEN id % 2 = 0 THEN 'network|field' ELSE 'network|n|field' END AS en FROM v_article",
)
bind("milestone_dates", lambda v: m.milestone_dates(v.manuscript), "SELECT doc_id, '01.02.2000' AS received, '03.02.2000' AS approved, '05.02.2000' AS accepted FROM v_manuscript")
bind(
    "parse_warnings",
    lambda v: m.parse_warnings(m.parsed_manuscripts(v.manuscript)),
    """WITH n AS (SELECT article_id, count(*) AS ru, count(en) AS en FROM v_ref GROUP BY article_id)
    SELECT doc_id, 'no doi' AS rule, '' AS detail FROM v_manuscript JOIN v_pub_article ON id = doc_id WHERE doi IS NULL
    UNION ALL SELECT doc_id, 'references ru/en', CAST(ru AS varchar) || ' / ' || CAST(en AS varchar) FROM v_manuscript JOIN n ON article_id = doc_id WHERE ru <> en""",
)
bind(
    "classify_upload",
    lambda v: m.classify_upload(m.parsed_manuscripts(v.manuscript)),
    "SELECT doc_id, CASE WHEN doi IS NULL THEN 'error' ELSE 'article' END AS kind, CASE WHEN doi IS NULL THEN 'no doi' END AS reason FROM v_manuscript JOIN v_pub_article ON id = doc_id",
)
bind(
    "citation_author_count",
    lambda v: m.section_texts(v.manuscript).select("doc_id", m.citation_author_count(F.col("citation_ru")).alias("n")),
    "SELECT article_id AS doc_id, CAST(count(*) AS int) AS n FROM v_author WHERE article_id IN (SELECT doc_id FROM v_manuscript) GROUP BY article_id",
)
bind(
    "front_matter",
    lambda v: front_matter(manuscript_lines(v.sql("SELECT p.id AS doc_id, concat('УДК 539', chr(10), a.title, chr(10), x.en_line, chr(10), 'Institute', chr(10), 'Text.') AS text FROM v_pub_article p JOIN v_article a ON a.id = p.id JOIN v_author_lines x ON x.article_id = p.id"))).select("doc_id", "title", F.array_join(F.transform("authors", lambda a: F.concat(a["name"], F.array_join(a["numbers"], ","))), "; ").alias("authors")),
    "SELECT p.id AS doc_id, a.title, string_agg(ini || '.' || ini || '. ' || surname_en || '1', '; ' ORDER BY ord) AS authors FROM v_pub_article p JOIN v_article a ON a.id = p.id JOIN v_author w ON w.article_id = p.id GROUP BY p.id, a.title",
)
# Texts in six forms of names by the article's id, with and without numbers, some with names behind a © only, some without any.
FORM = """CASE article_id % 6 WHEN 0 THEN concat('А.Б. ', surname_ru) WHEN 1 THEN concat(surname_ru, ' В. Г.') WHEN 2 THEN concat(surname_ru, ' Иван Ильич')
WHEN 3 THEN concat(ini, '. ', ini, '. ', surname_en) WHEN 4 THEN concat(surname_en, ' ', ini, '.', ini, '.') ELSE concat('John ', surname_en) END"""
KIND = "CASE WHEN article_id % 7 = 3 THEN 'holders' WHEN article_id % 11 = 5 THEN 'nameless' WHEN article_id % 5 < 3 THEN 'numbered' ELSE 'plain' END"
UNTEMPLATED = f"""WITH w AS (SELECT article_id, ord, {FORM} AS name, {KIND} AS kind, email, organization FROM v_author),
g AS (SELECT article_id, kind, array_sort(collect_list(struct(ord, name, email, organization))) AS xs FROM w GROUP BY article_id, kind)
SELECT g.article_id AS doc_id, concat_ws(chr(10), 'УДК 539', a.title, '', 'and its second line',
  CASE kind WHEN 'numbered' THEN array_join(transform(xs, x -> concat(x.name, x.ord)), ', ') WHEN 'plain' THEN array_join(transform(xs, x -> x.name), ', ') END,
  array_join(transform(xs, x -> concat(CASE WHEN kind = 'numbered' THEN concat(x.ord, ' ') ELSE '' END, x.organization, ', ул. Мира, д. 5')), chr(10)),
  array_join(transform(filter(xs, x -> x.email IS NOT NULL), x -> concat(CASE WHEN kind = 'numbered' THEN CAST(x.ord AS string) ELSE '' END, x.email)), ', '), 'named after A.B. Popov', 'Аннотация', 'Текст. Петров П.П.',
  CASE WHEN kind = 'holders' THEN concat('© ', array_join(transform(xs, x -> x.name), ', '), ', 2020') END) AS text
FROM g JOIN v_pub_article p ON p.id = g.article_id JOIN v_article a ON a.id = p.id"""
bind(
    "front_authors",
    lambda v: front_authors(front_matter(manuscript_lines(v.sql(UNTEMPLATED))), "title"),
    f"""WITH w AS (SELECT article_id, ord, {FORM} AS name, {KIND} AS kind, email, organization FROM v_author JOIN v_pub_article p ON p.id = article_id),
    mails AS (SELECT article_id, list(email ORDER BY ord) AS ms FROM w WHERE email IS NOT NULL GROUP BY article_id),
    orgs AS (SELECT article_id, list(organization ORDER BY ord) AS os FROM (SELECT article_id, organization, min(ord) AS ord FROM w GROUP BY ALL) GROUP BY article_id),
    named AS (SELECT article_id, ord AS pos, name, CASE WHEN kind = 'numbered' THEN CAST(ord AS varchar) ELSE '' END AS numbers, coalesce(CASE WHEN kind = 'numbered' THEN email END, ms[ord], '') AS email,
      coalesce(CASE WHEN kind = 'numbered' THEN organization END, CASE WHEN len(os) = 1 THEN os[1] ELSE os[ord] END, '') AS organization FROM w LEFT JOIN mails USING (article_id) JOIN orgs USING (article_id) WHERE kind <> 'nameless'),
    nameless AS (SELECT article_id, CAST(row_number() OVER (PARTITION BY article_id ORDER BY ord) AS int) AS pos, '' AS name, '' AS numbers, email, '' AS organization FROM w WHERE kind = 'nameless' AND email IS NOT NULL)
    SELECT x.article_id AS doc_id, pos, name, numbers, email, organization, a.title || ' and its second line' AS title FROM (SELECT * FROM named UNION ALL SELECT * FROM nameless) x JOIN v_article a ON a.id = x.article_id""",
)
SPANS = """SELECT id AS doc_id, 1 AS page, 1 AS line_no, 9.0 AS size, 'Journal head' AS text FROM v_article UNION ALL SELECT id, 1, 2, 16.0, title FROM v_article
UNION ALL SELECT id, 1, 3, CASE WHEN id % 2 = 0 THEN 16.0 ELSE 10.0 END, 'second line' FROM v_article UNION ALL SELECT id, 1, 5, 16.0, 'far away line' FROM v_article UNION ALL SELECT id, 2, 1, 30.0, 'page two' FROM v_article"""
bind("title_by_font", lambda v: m.title_by_font(v.sql(SPANS)), "SELECT id AS doc_id, CASE WHEN id % 2 = 0 THEN title || ' second line' ELSE title END AS title, CASE WHEN id % 2 = 0 THEN 3 ELSE 2 END AS last_line FROM v_article")
TOC = "SELECT id AS doc_id, k AS line_no, CASE k WHEN 1 THEN 'JOURNAL' WHEN 2 THEN 'Содержание' WHEN 3 THEN concat('РАЗДЕЛ ', chr(65 + CAST(id % 5 AS int))) WHEN 4 THEN 'Статья 5' WHEN 5 THEN concat('PART ', chr(65 + CAST(id % 5 AS int))) WHEN 6 THEN concat('PART ', chr(65 + CAST(id % 5 AS int))) ELSE 'ИТОГИ' END AS line FROM v_journal CROSS JOIN (SELECT explode(sequence(1, 7)) AS k)"
bind(
    "toc_headings",
    lambda v: m.toc_headings(v.sql(TOC)),
    "SELECT id AS doc_id, 1 AS pos, 'РАЗДЕЛ ' || chr(65 + CAST(id % 5 AS int)) AS ru, 'PART ' || chr(65 + CAST(id % 5 AS int)) AS en FROM v_journal UNION ALL SELECT id, 2, 'ИТОГИ', NULL FROM v_journal",
)
FORMAT = "CASE article_id % 3 WHEN 0 THEN 'html' WHEN 1 THEN 'detailed' ELSE 'simple' END"
bind("route_author_format", lambda v: m.route_author_format(v.author_raw).select("article_id", "format"), f"SELECT article_id, {FORMAT} AS format FROM v_author_raw")
routed = lambda v, f: m.route_author_format(v.author_raw).filter(F.col("format") == f)
NAME = "ini || '.' || ini || '. ' || surname_en"
bind("authors_from_html", lambda v: m.authors_from_html(routed(v, "html")), f"SELECT article_id, ord, {NAME} AS full_name FROM v_author WHERE article_id % 3 = 0")
bind("authors_from_detail", lambda v: m.authors_from_detail(routed(v, "detailed")), f"SELECT article_id, ord, {NAME} AS full_name, organization, email FROM v_author WHERE article_id % 3 = 1")
bind("authors_from_list", lambda v: m.authors_from_list(routed(v, "simple")), "SELECT article_id, ord, surname_en || ' ' || ini || '.' || ini || '.' AS full_name FROM v_author WHERE article_id % 3 = 2")
bind(
    "valid_names",
    lambda v: m.valid_names(v.article_author.select("article_id", "ord", F.when(F.col("ord") == 2, "12").when(F.col("ord") == 3, F.concat("full_name", F.lit("2,*"))).otherwise(F.concat(F.lit("(x)  "), "full_name")).alias("full_name"))),
    "SELECT article_id, ord, CASE WHEN ord = 3 THEN full_name || ',' ELSE full_name END AS full_name FROM v_article_author WHERE ord <> 2",
)
bind(
    "pick_issue_files",
    lambda v: m.pick_issue_files(v.snap_new.select(F.concat_ws("/", F.slice(F.split("path", "/"), 1, 3)).alias("issue"), F.concat_ws("/", F.slice(F.split("path", "/"), 4, 9)).alias("path")).withColumn("path", F.when(F.hash("issue") % 2 == 0, F.regexp_replace("path", "doc/", "")).otherwise(F.col("path")))).groupBy("issue").agg(F.count("*").alias("n")),
    "SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) || '/' || split_part(path, '/', 3) AS issue, count(*) AS n FROM v_snap_new GROUP BY 1",
)
bind(
    "author_positions",
    lambda v: m.author_positions(v.author.select("article_id", F.concat(F.lit("Иван "), "surname_ru", F.lit(" – доцент "), F.col("ord").cast("string")).alias("line")), v.author.select("article_id", "ord", F.col("surname_ru").alias("surname"))),
    "SELECT a.article_id, a.ord, min('доцент ' || CAST(b.ord AS varchar)) AS position FROM v_author a JOIN v_author b ON a.article_id = b.article_id AND a.surname_ru = b.surname_ru GROUP BY a.article_id, a.ord",
)
bind("numbered_references", lambda v: _lines(v).groupBy("doc_id").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])).alias("t")).select("doc_id", windows.numbered_list_size(F.regexp_extract("t", "(?s)Список источников\n(.*?)\nИнформация", 1)).alias("n")), "SELECT article_id AS doc_id, CAST(max(pos) AS int) AS n FROM v_ref WHERE article_id IN (SELECT doc_id FROM v_manuscript) GROUP BY article_id")
