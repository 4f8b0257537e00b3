"""Corpus jobs: manuscripts, as whole texts or as a table of lines, mined by built-in expressions.

The lines of a text stay in its row as an array, so no line is moved. A table of lines is gathered by document, or read as windows partitioned by
document, so one shuffle of the lines by doc_id serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galley.functions.scalars import CONFUSABLE, author_key, bigram_dice, dois, emails, expand_indices, extract_pages, homoglyph_fix, is_initialism, org_tail, split_keywords, strip_html, translit_ru, usual_letters
from galley.sources.text import digits_of_superscripts, manuscript_lines

from .windows import glue_runs

# Headings of manuscripts and the section that each opens.
HEADINGS = (
    ("аннотация", "abstract_ru"), ("ключевые слова", "keywords_ru"), ("для цитирования", "citation_ru"), ("введение", "body_ru"), ("список источников", "refs_ru"), ("список литературы", "refs_ru"),
    ("информация об авторах", "info_ru"), ("original article", "front_en"), ("abstract", "abstract_en"), ("keywords", "keywords_en"), ("for citation", "citation_en"), ("references", "refs_en"), ("information about the authors", "info_en"),
)
SECTIONS = tuple(dict.fromkeys(s for _, s in HEADINGS))
CAPITAL, SMALL = "А-ЯЁA-Z", "а-яёa-z"
LETTERS = "А-Яа-яЁёA-Za-z"
# An author of an author line: initials (one may have small letters, a second one may lack its stop before a blank), surname, index. The empty groups
# tell what a match has: two initials, a capital surname, an index. One initial counts only with a capital surname that an index, a comma or the end follows.
INITIAL = f"[{CAPITAL}][{SMALL}]*\\."
_LISTED = f"(?:[0-9]+(?:\\s*[-–—−,]\\s*[0-9]+)++(?=\\s*(?:,|\\z)|\\s+{INITIAL})|[0-9]+)"
_TOKEN = f"{INITIAL}(?:\\s?{INITIAL}()|\\s?[{CAPITAL}](?=\\s))?\\s*(?:(?=[{CAPITAL}])()|)[{LETTERS}-]+\\s?(?:{_LISTED}()|)"
INITIALED = f"(?:(?<=, |[0-9]\\s)|^)(?>{_TOKEN})(?:\\1|\\2(?:\\3|(?=\\s*(?:,|\\z))))"
_NAME = f"[{CAPITAL}][{LETTERS}'’-]+"
#: Written-out names inside a list with initials, and a line of nothing else: their index is what tells them from titles and organisations.
WRITTEN_OUT = f"(?:^|(?<=, |[0-9] )){_NAME}(?: {_NAME}){{1,2}}[0-9]+(?=[,\\s]|\\z)"
WRITTEN_OUT_LINE = f"^\\s*{_NAME}(?:\\s+{_NAME}){{1,3}}\\s*[0-9]+\\s*(?:,\\s*{_NAME}(?:\\s+{_NAME}){{1,3}}\\s*[0-9]+\\s*)*\\z"
LEADING_INDEX = f"^[0-9]+(?:\\s*[,–—−-]\\s*[0-9]+)*\\s+(?=[{CAPITAL}]\\.)"
ADDRESSED = r"(?:(?<!\S)[0-9]+(?:\s*[,–—−-]\s*[0-9]+)*\s*)?[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+.*$"
# References: how one begins, what can only go on with the one before, and how one ends that goes on or ends in an address.
NUMBERED = r"^\[?[0-9]{1,3}[.)\]]\s+"
REFERENCE_TAIL = r"(?iu)^(?:(?:P{1,2}|V|Vol|С|S|Т|T|Вып|Iss|Ч|Ch|No|N)\.?\s*[A-Z]?[0-9]|№\s*[0-9]|[0-9]+\s*[сcps]\.|(?:DOI|EDN)(?![\p{L}\p{N}_])|https?://|www\.|\(|In:?\s)"
REFERENCE_START = f"^(?:[{CAPITAL}][^\\s.,]*(?:,?\\s+[{CAPITAL}][^\\s.,]*){{0,2}},?\\s+[{CAPITAL}][{SMALL}]?\\.|[{CAPITAL}]\\.\\s?(?:[{CAPITAL}]\\.\\s?)?[{CAPITAL}][{SMALL}]+)"
UNFINISHED = f"(?:[,:;]|\\s[/–—-]|[{LETTERS}]-)\\z"
ENDS_WITH_LINK = r"(?:https?://\S*[^\s.]|10\.[0-9]{4,9}/\S*[^\s.])\z"
SENTENCE_END = r"[.!?…»\"')]\s*\z"
APPENDIX = r"^(?:ПРИЛОЖЕНИЕ|Приложение|APPENDIX|Appendix)(?![\p{L}\p{N}_])"
BLANK = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\x1c-\x1f]"
#: Front parts by name, with what opens them: the DOI or the heading of the English part.
FRONTS = {"opening_ru": "front_ru", "opening_en": "front_en"}
#: What a word processor's text puts before a line that goes on with the one before: a soft line break.
SOFT_BREAK = "\u2028"


def heading_key(c: Column) -> Column:
    """Small letters and digits of a line, look-alikes as homoglyph_fix has them; a line of usual characters costs no regular expression for it."""
    kept, rest = usual_letters()
    bare = lambda y: F.when(F.translate(y, f"{kept}ё", "") == "", y).otherwise(F.regexp_replace(y, "[^0-9a-zа-яё]+", ""))
    # transform binds the lower case, which three tests and a translation ask for, and what is left of it.
    plain = F.transform(F.array(F.lower(c)), lambda x: F.translate(homoglyph_fix(x), rest, ""))
    return F.get(F.transform(plain, bare), F.lit(0))


def canon_headings(lines: DataFrame, near: float = 0.07, most: int = 80) -> DataFrame:
    """lines with heading: the section that a line opens; null where it is no heading.

    Short lines are compared without blanks and look-alike letters; from nine letters on one wrong letter in about fourteen is forgiven.
    """
    return lines.withColumn("heading", heading_of(F.col("line"), near, most))


def heading_of(line: Column, near: float = 0.07, most: int = 80) -> Column:
    """The section that a line opens, as canon_headings has it."""
    bare = [(h.replace(" ", ""), s) for h, s in HEADINGS]
    names = F.create_map(*[F.lit(x) for pair in bare for x in pair])
    longest = max(len(h) for h, _ in bare)
    forgiven = -int(-near * (longest + longest * near) // 1)

    def found(k: Column) -> Column:
        # Lengths rule most lines out before any distance is computed.
        wrong = F.ceil(near * F.length(k))
        distance = lambda h: F.levenshtein(k, F.lit(h), forgiven)
        close = [F.when((F.abs(F.length(k) - len(h)) <= wrong) & distance(h).between(0, wrong), s) for h, s in bare if len(h) >= 9]
        return F.coalesce(names[k], F.when(F.length(k) >= 9, F.coalesce(*close)))

    # transform binds the key: it is computed once a line, whatever the optimizer moves where. Headings as they are need none.
    length = F.length(line)
    exact = F.when(length.between(*(f(len(h) for h, _ in HEADINGS) for f in (min, max))) & (length < most), F.create_map(*[F.lit(x) for pair in HEADINGS for x in pair])[F.lower(line)])
    heading = F.get(F.transform(F.array(heading_key(line)), found), F.lit(0))
    # No heading has digits, so each one is a wrong letter; many lines have too many. (contains takes some 5 ns a byte, ten of them more than one pattern.)
    digits = line.rlike(f"^(?:[^0-9]*[0-9]){{{forgiven + 1}}}")
    short = length.between(min(len(h) for h, _ in bare), most - 1)
    return F.coalesce(exact, F.when(short & ~digits, heading))


def marked_lines(lines: DataFrame) -> DataFrame:
    """lines (doc_id, line_no, line) with what all jobs below ask of them: heading and section, is_doi, and opens and part, where the lines
    under the DOI are front_ru."""
    last = lambda c: F.last(c, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    is_doi = F.lower(F.left("line", F.lit(3))) == "doi"
    rows = canon_headings(lines).withColumn("is_doi", is_doi).withColumn("opens", F.when(F.col("is_doi"), "front_ru").otherwise(F.col("heading")))
    return rows.withColumns({"section": last("heading"), "part": last("opens")})


def store_lines(lines: DataFrame, table: str, path: str, buckets: int) -> None:
    """The marked lines as a table bucketed by doc_id: they are moved once, and jobs over the table move no line."""
    dealt = lines.repartition(buckets, "doc_id")
    marked_lines(dealt).write.bucketBy(buckets, "doc_id").sortBy("doc_id", "line_no").option("path", path).saveAsTable(table)


def document_parts(source: DataFrame, *names: str) -> DataFrame:
    """(doc_id, doi, soft, lines, one column per name): the lines of a section or of a front part of each document, as an array.

    source has lines, marked or not, which are gathered by document; or whole texts (doc_id, text), whose lines never leave their row. Lines of
    a front part don't begin with a ©; doi is the least one of the lines that begin with it; soft tells whether the text marks soft line breaks.
    """
    return _parts_of_texts(source, names) if "text" in source.columns else _parts_of_lines(source, names)


def _parts_of_lines(lines: DataFrame, names: tuple[str, ...]) -> DataFrame:
    rows = lines if "part" in lines.columns else marked_lines(lines)
    held = lambda where: F.transform(F.array_sort(F.collect_list(F.when(where, F.struct("line_no", "line")))), lambda x: x["line"])
    own = lambda n: held((F.col("part") == FRONTS[n]) & F.col("opens").isNull() & ~F.startswith("line", F.lit("©"))) if n in FRONTS else held((F.col("section") == n) & F.col("heading").isNull())
    doi = F.min(F.when(F.col("is_doi"), F.get(dois(F.col("line")), F.lit(0))))
    return rows.groupBy("doc_id").agg(doi.alias("doi"), F.bool_or(F.contains("line", F.lit(SOFT_BREAK))).alias("soft"), held(F.lit(True)).alias("lines"), *[own(n).alias(n) for n in names])


def _parts_of_texts(docs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Lines that open something are few, so they are found first, and parts are slices between them."""
    text = digits_of_superscripts(F.col("text"))
    rows = docs.select("doc_id", F.col("text").rlike(SOFT_BREAK).alias("soft"), F.transform(F.split(text, "\n"), lambda x: F.trim(x)).alias("lines"))
    opening = lambda t, i: F.struct(i.alias("at"), t.rlike("^[dD][oO][iI]").alias("is_doi"), heading_of(t).alias("heading"))
    marks = F.filter(F.transform("lines", opening), lambda m: m["is_doi"] | m["heading"].isNotNull())
    # A generated row is computed once: a condition on it is not moved below, with what it rests on once more.
    rows = rows.select("doc_id", F.explode(F.array(F.struct("soft", "lines", marks.alias("_marks")))).alias("_d")).select("doc_id", "_d.*").withColumn("_headings", F.filter("_marks", lambda m: m["heading"].isNotNull()))

    def slices(marks: str, opened, kept) -> Column:
        ends = F.transform(marks, lambda m, i: F.struct(opened(m).alias("opened"), m["at"].alias("at"), (F.coalesce(F.get(F.col(marks), i + 1)["at"], F.size("lines")) - m["at"] - 1).alias("n")))
        return F.flatten(F.transform(F.filter(ends, lambda x: kept(x["opened"])), lambda x: F.slice("lines", x["at"] + 2, x["n"])))

    fronts = lambda n: F.filter(slices("_marks", lambda m: F.when(m["is_doi"], "front_ru").otherwise(m["heading"]), lambda x: x == FRONTS[n]), lambda t: ~F.startswith(t, F.lit("©")))
    own = lambda n: fronts(n) if n in FRONTS else slices("_headings", lambda m: m["heading"], lambda x: x == n)
    doi = F.array_min(F.transform(F.filter("_marks", lambda m: m["is_doi"]), lambda m: F.get(dois(F.get("lines", m["at"])), F.lit(0))))
    return rows.select("doc_id", doi.alias("doi"), "soft", "lines", *[own(n).alias(n) for n in names])


def _bound(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _by_language(docs: DataFrame, name: str, of) -> DataFrame:
    """(doc_id, lang, what `of` makes of a language)."""
    return docs.select("doc_id", F.explode(F.array(*[F.struct(F.lit(x).alias("lang"), of(x).alias(name)) for x in ("ru", "en")])).alias("_l")).select("doc_id", "_l.lang", f"_l.{name}")


def section_texts(lines: DataFrame) -> DataFrame:
    """One row per document and one column per section: its lines without the heading."""
    docs = document_parts(lines, *SECTIONS)
    text = lambda c: F.nullif(F.array_join(c, "\n"), F.lit(""))
    some = F.greatest(*[F.size(c) for c in SECTIONS]) > 0
    row = F.explode(F.array(F.struct(some.alias("_some"), *[text(c).alias(c) for c in SECTIONS])))
    return docs.select("doc_id", row.alias("_r")).select("doc_id", "_r.*").filter("_some").drop("_some")


def glue_paragraphs(lines: DataFrame) -> DataFrame:
    """(doc_id, run, text): a line goes on with the one before unless that one ends a sentence; lines of an address always go on."""
    before = F.lag("line").over(Window.partitionBy("doc_id").orderBy("line_no"))
    start = (before.isNull() | before.rlike(r"[.!?:;]\s*$") | (before == "")) & ~F.col("line").rlike("^(https?://|www\\.)")
    return _glued(lines, start)


def dehyphenate_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, run, text): a line that starts in lower case, or follows a hyphen at a line's end, goes on with the one before; the hyphen goes."""
    before = F.lag("line").over(Window.partitionBy("doc_id").orderBy("line_no"))
    start = before.isNull() | ~(before.endswith("-") | F.col("line").rlike(f"^[{SMALL}]"))
    glued = _glued(lines, start)
    return glued.withColumn("text", F.regexp_replace("text", "- ", ""))


def _glued(lines: DataFrame, start: Column) -> DataFrame:
    marked = lines.withColumn("_begins", F.coalesce(start, F.lit(True)))
    return glue_runs(marked, F.col("_begins"), ["doc_id"])


def split_references(lines: DataFrame) -> DataFrame:
    """(doc_id, lang, pos, ref) of the lists of references, each up to an appendix. A numbered line begins a reference and one that starts with _ goes on
    with the one before, without a blank; the others by soft line breaks where the text marks them, else by how they begin and the one before ends."""
    docs = document_parts(lines, "refs_ru", "refs_en")
    listed = _by_language(docs, "refs", lambda x: references_of(F.col(f"refs_{x}"), F.col("soft")))
    return listed.select("doc_id", "lang", F.posexplode("refs").alias("pos", "ref")).select("doc_id", "lang", (F.col("pos") + 1).alias("pos"), "ref")


def references_of(lines: Column, soft: Column) -> Column:
    """The references that the lines of a list make."""
    bare = lambda t: F.regexp_replace(F.trim(F.regexp_replace(t, f"{BLANK}+", " ")), NUMBERED, "")
    # A list of numbered lines only, as most are, needs no look at the line before.
    return _bound(_up_to_appendix(lines), lambda x: F.when(F.forall(x, lambda t: t.rlike(NUMBERED)), F.transform(x, bare)).otherwise(_glued_references(x, soft)))


def _up_to_appendix(lines: Column) -> Column:
    appendix = F.array_min(F.filter(F.transform(lines, lambda t, i: F.when(t.rlike(APPENDIX), i)), lambda i: i.isNotNull()))
    return F.when(F.exists(lines, lambda t: t.rlike(APPENDIX)), F.slice(lines, 1, appendix)).otherwise(lines)


def _glued_references(lines: Column, soft: Column) -> Column:
    squeezed = F.transform(lines, lambda t: F.struct(F.trim(F.regexp_replace(t, f"{BLANK}+", " ")).alias("t"), F.startswith(t, F.lit(SOFT_BREAK)).alias("tied")))
    items = F.transform(F.filter(squeezed, lambda x: x["t"] != ""), lambda x: F.struct(F.regexp_replace(x["t"], NUMBERED, "").alias("t"), x["t"].rlike(NUMBERED).alias("numbered"), x["tied"].alias("tied")))
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit(None).cast("string").alias("last"))
    word = lambda t: F.regexp_replace(F.substring_index(t, " ", 1), "[.,:]+$", "")

    def goes_on(last: Column, x: Column) -> Column:
        t = x["t"]
        by_look = F.when(t.rlike(REFERENCE_TAIL) | last.rlike(UNFINISHED), True).when(t.rlike(REFERENCE_START), False).when(last.rlike(ENDS_WITH_LINK), ~word(t).rlike(f"^[{CAPITAL}][{LETTERS}'’ʼ-]*$")).otherwise(~last.rlike(SENTENCE_END))
        return F.when(soft, x["tied"]).otherwise(by_look)

    def step(s: Column, x: Column) -> Column:
        state = lambda done, last: F.struct(done.alias("done"), last.alias("last"))
        begun = state(F.when(s["last"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["last"]))), x["t"])
        tied = state(s["done"], F.concat(s["last"], x["t"]))
        return F.when(s["last"].isNull() | x["numbered"], begun).when(F.startswith(x["t"], F.lit("_")), tied).when(goes_on(s["last"], x), state(s["done"], F.concat(s["last"], F.lit(" "), x["t"]))).otherwise(begun)

    return F.aggregate(items, start, step, lambda s: F.filter(F.concat(s["done"], F.array(s["last"])), lambda t: t.isNotNull()))


def repair_reference_lists(refs: DataFrame) -> DataFrame:
    """refs (doc_id, lang, pos, ref) where the longer list's last surplus items that do not begin like a reference are glued to the one before."""
    sizes = refs.groupBy("doc_id").agg(F.count_if(F.col("lang") == "ru").alias("ru"), F.count_if(F.col("lang") == "en").alias("en"))
    rows = refs.join(sizes, "doc_id")
    surplus = F.when(F.col("lang") == "ru", F.col("ru") - F.col("en")).otherwise(F.col("en") - F.col("ru"))
    orphan = (F.col("pos") > 1) & ~F.col("ref").rlike(f"^[{CAPITAL}]")
    rank = F.sum(F.when(orphan, 1).otherwise(0)).over(Window.partitionBy("doc_id", "lang").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    marked = rows.withColumn("_glue", orphan & (rank <= surplus)).select("doc_id", "lang", F.col("pos").alias("line_no"), F.col("ref").alias("line"), "_glue")
    runs = glue_runs(marked, ~F.col("_glue"), ["doc_id", "lang"])
    return runs.select("doc_id", "lang", F.col("run").cast("int").alias("pos"), F.col("text").alias("ref"))


def title_lines(lines: DataFrame, most: int = 6) -> DataFrame:
    """(doc_id, lang, title): the lines of a front part up to the authors or a blank line."""
    docs = document_parts(lines, *FRONTS)
    return _by_language(docs, "title", lambda x: _title(f"opening_{x}", most)).filter("title IS NOT NULL")


def _without_leading_index(line: Column) -> Column:
    return F.when(line.rlike("^[0-9]"), F.regexp_replace(line, LEADING_INDEX, "")).otherwise(line)


def is_author_line(line: Column) -> Column:
    """Whether a line begins with an author, behind an index maybe, or lists written-out names with indices; initials inside a title or an organisation don't count."""
    found = lambda t: (t.rlike(f"^{_TOKEN}") & t.rlike(INITIALED)) | ((F.length(t) <= 140) & t.rlike(WRITTEN_OUT_LINE))
    return _bound(_without_leading_index(line), found)


def author_lines(front: Column) -> Column:
    """The author line of a front part, its e-mails cut, with the lines that go on with it behind a comma; null where there is none."""
    bare = lambda t: F.when(F.contains(t, F.lit("@")), F.trim(F.regexp_replace(t, ADDRESSED, ""))).otherwise(t)
    ends = lambda t: F.contains(t, F.lit("@")) | ~F.endswith(F.rtrim(t), F.lit(","))
    first = F.array_min(F.filter(F.transform(front, lambda t, i: F.when(is_author_line(t), i)), lambda i: i.isNotNull()))

    def block(rest: Column) -> Column:
        last = F.array_min(F.filter(F.transform(rest, lambda t, i: F.when(ends(t) | ~F.coalesce(is_author_line(F.get(rest, i + 1)), F.lit(False)), i)), lambda i: i.isNotNull()))
        # Most author lines are one.
        return F.when(ends(rest[0]), bare(rest[0])).otherwise(F.array_join(F.transform(F.slice(rest, 1, last + 1), bare), " "))

    return _bound(first, lambda i: F.when(i.isNotNull(), _bound(F.slice(front, i + 1, F.size(front)), block)))


def authors_of(line: Column) -> Column:
    """The authors of an author line: structs of initials, surname and indices, in the order of the line."""
    listed = lambda t: F.regexp_extract_all(t, F.lit(f"{INITIALED}|{WRITTEN_OUT}"), F.lit(0))
    # Names without initials count beside some with, or where the whole line has no others.
    alone = lambda t: F.when((F.length(t) <= 140) & t.rlike(WRITTEN_OUT_LINE), F.split(t, ",")).otherwise(F.expr("cast(array() as array<string>)"))
    kept = lambda t: _bound(listed(t), lambda xs: F.when(F.exists(xs, lambda x: x.rlike(f"^{INITIAL}")), xs).otherwise(alone(t)))
    return F.transform(_bound(_bound(F.trim(line), _without_leading_index), kept), lambda x: F.when(x.rlike(f"^{INITIAL}"), _initialed(x)).otherwise(_written_out(x)))


def _author(initials: Column, surname: Column, index: Column) -> Column:
    return F.struct(initials.alias("initials"), surname.alias("surname"), F.when(index == "", F.expr("cast(array() as array<int>)")).otherwise(expand_indices(F.translate(index, "—−", "--"))).alias("indices"))


def _initialed(token: Column) -> Column:
    first = f"^({INITIAL}(?:\\s?{INITIAL}|\\s?[{CAPITAL}](?=\\s))?)\\s*([{LETTERS}-]+)"
    initials = F.regexp_replace(F.regexp_extract(token, first, 1), "\\s", "")
    return _author(F.when(F.endswith(initials, F.lit(".")), initials).otherwise(F.concat(initials, F.lit("."))), F.regexp_extract(token, first, 2), F.regexp_extract(token, "[0-9].*$", 0))


def _written_out(name: Column) -> Column:
    """Surname last; Cyrillic look-alikes in Latin words are mended."""
    latin = lambda w: F.when(w.rlike("[A-Za-z]"), F.translate(w, *CONFUSABLE)).otherwise(w)
    words = F.transform(F.split(F.trim(F.regexp_replace(name, "[0-9]+\\s*$", "")), "\\s+"), latin)
    made = lambda ws: _author(F.array_join(F.transform(F.slice(ws, 1, F.size(ws) - 1), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lit("."))), ""), F.element_at(ws, -1), F.regexp_extract(name, "[0-9]+\\s*$", 0))
    return _bound(words, made)


def author_tokens(lines: DataFrame) -> DataFrame:
    """(doc_id, lang, pos, initials, surname, indices) of the author lines in the front parts: two initials or one, or written-out names with an index."""
    docs = document_parts(lines, *FRONTS)
    listed = _by_language(docs, "authors", lambda x: authors_of(author_lines(F.col(f"opening_{x}"))))
    return listed.select("doc_id", "lang", F.posexplode("authors").alias("k", "a")).select("doc_id", "lang", (F.col("k") + 1).alias("pos"), "a.initials", "a.surname", "a.indices")


def org_chunks(lines: DataFrame) -> DataFrame:
    """(doc_id, lang, indices, org, town, country) of the numbered affiliation lines in the front parts."""
    docs = document_parts(lines, *FRONTS)
    rows = _by_language(docs, "orgs", lambda x: _org_lines(f"opening_{x}")).select("doc_id", "lang", F.explode("orgs").alias("line"))
    name = F.regexp_replace("line", r"^[0-9][0-9, -]*\s*", "")
    return rows.select("doc_id", "lang", expand_indices(F.regexp_extract("line", r"^([0-9][0-9, -]*)", 1)).alias("indices"), org_tail(name).alias("o")).select("doc_id", "lang", "indices", "o.org", "o.town", "o.country")


def surname_by_translit(ru: DataFrame, words: DataFrame) -> DataFrame:
    """(article_id, pos, word): per Russian surname (article_id, pos, surname) the word (article_id, word) most like its transliteration.

    Edits count before shared pairs of letters: sets of pairs tell neither order nor repeats, so a longer name that happens to hold a pair twice would win.
    """
    surnames = ru.select("article_id", "pos", translit_ru(F.col("surname")).alias("surname"))
    listed = words.groupBy("article_id").agg(F.collect_set(F.struct("word", F.lower("word").alias("low"))).alias("words"))
    near = lambda w: -F.levenshtein("surname", w["low"]) / F.greatest(F.length("surname"), F.length(w["low"]), F.lit(1))
    # Pairs of letters are compared only among words of equally few edits, which are seldom more than one.
    best = lambda xs: F.when(F.size(xs) == 1, xs[0]["word"]).otherwise(F.array_max(F.transform(xs, lambda x: F.struct(bigram_dice(F.col("surname"), x["low"]), x["word"].alias("word"))))["word"])
    least = lambda xs: _bound(F.array_max(F.transform(xs, lambda y: y["near"])), lambda top: F.filter(xs, lambda x: x["near"].eqNullSafe(top)))
    scored = F.transform("words", lambda w: F.struct(near(w).alias("near"), w["word"].alias("word"), w["low"].alias("low")))
    found = _bound(_bound(scored, least), best)
    return surnames.join(listed, "article_id").select("article_id", "pos", found.alias("word"))


def equalize_keywords(keywords: DataFrame) -> DataFrame:
    """(doc_id, ru, en): initialisms glued to the word before them where that makes the two lists equally long. Input: arrays ru and en."""

    def glued(c: str) -> Column:
        a = F.col(c)
        return F.aggregate(a, F.array().cast("array<string>"), lambda acc, x: F.when((F.size(acc) > 0) & is_initialism(x, F.element_at(acc, -1)), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.lit(", "), x)))).otherwise(F.concat(acc, F.array(x))))

    rows = keywords.withColumn("_r", glued("ru")).withColumn("_e", glued("en"))
    better = (F.size("ru") != F.size("en")) & (F.size("_r") == F.size("_e"))
    return rows.select("doc_id", F.when(better, F.col("_r")).otherwise(F.col("ru")).alias("ru"), F.when(better, F.col("_e")).otherwise(F.col("en")).alias("en"))


# Fixed values.
MILESTONES = (("received", "поступила в редакцию"), ("approved", "одобрена после рецензирования"), ("accepted", "принята к публикации"))


def milestone_dates(lines: DataFrame) -> DataFrame:
    """(doc_id, received, approved, accepted), dd.MM.yyyy; lines as document_parts takes them, or any (doc_id, line)."""
    date = lambda t: F.regexp_extract(t, r"([0-9]{2}\.[0-9]{2}\.[0-9]{4})", 1)
    kind = lambda low: F.coalesce(*[F.when(F.contains(low, F.lit(words)), name) for name, words in MILESTONES])
    if "text" in lines.columns:
        lines = manuscript_lines(lines)
    # A date is looked for first: few lines have one.
    lines = lines.filter(F.col("line").rlike(r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}"))
    rows = lines.select("doc_id", kind(F.lower("line")).alias("kind"), date(F.col("line")).alias("date")).filter("kind IS NOT NULL AND date <> ''")
    return rows.groupBy("doc_id").pivot("kind", [n for n, _ in MILESTONES]).agg(F.min("date"))


def parsed_manuscripts(lines: DataFrame) -> DataFrame:
    """(doc_id, doi, title_ru, title_en, n_authors_ru, n_authors_en, n_orgs, n_cited, pages, n_keywords_ru, n_keywords_en, n_refs_ru, n_refs_en): what the jobs above find, per document."""
    docs = document_parts(lines, *FRONTS, "abstract_ru", "citation_ru", "keywords_ru", "keywords_en", "refs_ru", "refs_en")
    text = lambda c: F.nullif(F.array_join(c, "\n"), F.lit(""))
    keywords = lambda x: F.size(split_keywords(F.coalesce(text(f"keywords_{x}"), F.lit(""))))
    references = lambda x: F.size(references_of(F.col(f"refs_{x}"), F.col("soft"))).cast("long")
    authors = lambda x: F.coalesce(F.array_size(authors_of(author_lines(F.col(f"opening_{x}")))), F.lit(0)).cast("long")
    return docs.select(
        "doc_id", "doi", _title("opening_ru").alias("title_ru"), _title("opening_en").alias("title_en"), authors("ru").alias("n_authors_ru"), authors("en").alias("n_authors_en"),
        (F.size(_org_lines("opening_ru")) + F.size(_org_lines("opening_en"))).cast("long").alias("n_orgs"), references("ru").alias("n_refs_ru"), references("en").alias("n_refs_en"),
        citation_author_count(text("citation_ru")).alias("n_cited"), extract_pages(F.coalesce(text("citation_ru"), F.lit(""))).alias("pages"),
        keywords("ru").alias("n_keywords_ru"), keywords("en").alias("n_keywords_en"), text("abstract_ru").isNotNull().alias("has_abstract"),
    )


def _title(front: str, most: int = 6) -> Column:
    """As title_lines has it, over the lines of a front part."""
    own = F.slice(front, 1, most)
    stop = F.array_min(F.filter(F.transform(own, lambda t, i: F.when(((t == "") & (i > 0)) | is_author_line(t), i)), lambda i: i.isNotNull()))
    kept = F.filter(F.slice(own, 1, F.coalesce(stop, F.lit(most))), lambda t: t != "")
    return F.nullif(F.array_join(kept, " "), F.lit(""))


def _org_lines(front: str) -> Column:
    """The numbered lines of organisations below the authors."""
    first = F.array_min(F.filter(F.transform(front, lambda t, i: F.when(is_author_line(t), i)), lambda i: i.isNotNull()))
    named = lambda t: t.rlike(f"^[0-9][0-9, -]*\\s*[{CAPITAL}]") & ~F.contains(t, F.lit("@")) & ~is_author_line(t)
    below = lambda i: F.when(i.isNotNull(), F.filter(F.slice(front, i + 2, F.size(front)), named)).otherwise(F.expr("cast(array() as array<string>)"))
    return _bound(first, below)


def parse_warnings(parsed: DataFrame) -> DataFrame:
    """(doc_id, rule, detail) for what a parsed manuscript lacks or contradicts."""
    both = lambda a, b: F.concat(F.col(a).cast("string"), F.lit(" / "), F.col(b).cast("string"))
    rule = lambda cond, name, detail=F.lit(""): F.when(cond, F.struct(F.lit(name).alias("rule"), detail.alias("detail")))
    rules = [
        rule(F.col("doi").isNull(), "no doi"), rule(F.coalesce("title_ru", F.lit("")) == "", "no title"), rule(~F.coalesce("has_abstract", F.lit(False)), "no abstract"),
        rule(F.col("n_authors_ru") == 0, "no authors"), rule((F.col("n_cited") > 0) & (F.col("n_cited") != F.col("n_authors_ru")), "authors differ from citation", both("n_authors_ru", "n_cited")),
        rule(F.col("n_authors_ru") != F.col("n_authors_en"), "authors ru/en", both("n_authors_ru", "n_authors_en")), rule(F.col("n_keywords_ru") != F.col("n_keywords_en"), "keywords ru/en", both("n_keywords_ru", "n_keywords_en")),
        rule(F.col("n_refs_ru") != F.col("n_refs_en"), "references ru/en", both("n_refs_ru", "n_refs_en")), rule(F.col("n_orgs") == 0, "no organisation"), rule(F.coalesce("pages", F.lit("")) == "", "no pages"),
    ]
    # As an outer one, so that the rules aren't computed for a filter on their number too.
    return parsed.select("doc_id", F.explode_outer(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("r")).filter("r IS NOT NULL").select("doc_id", "r.rule", "r.detail")


def classify_upload(parsed: DataFrame) -> DataFrame:
    """(doc_id, kind, reason): an article has a DOI and authors; without both a file is skipped, with one of them it is an error."""
    has_doi, has_authors = F.col("doi").isNotNull(), F.col("n_authors_ru") > 0
    kind = F.when(has_doi & has_authors, "article").when(has_doi | has_authors, "error").otherwise("skipped")
    return parsed.select("doc_id", kind.alias("kind"), F.when(has_doi & ~has_authors, "no authors").when(has_authors & ~has_doi, "no doi").alias("reason"))


NAMED = f"[{CAPITAL}][{SMALL}{CAPITAL}-]+\\s[{CAPITAL}]\\.(?:\\s?[{CAPITAL}]\\.)?"


def citation_author_count(c: Column) -> Column:
    """Names ('Surname I.I.') before the double slash of a citation."""
    return F.regexp_count(F.split(F.coalesce(c, F.lit("")), "//")[0], F.lit(NAMED))


def title_by_font(spans: DataFrame) -> DataFrame:
    """(doc_id, title, last_line): the first consecutive lines in the greatest font on page 1, of lines over five characters.

    spans: doc_id, page, line_no, size, text.
    """
    page = spans.filter("page = 1 AND length(text) > 5")
    top = page.withColumn("most", F.max("size").over(Window.partitionBy("doc_id"))).filter("size = most")
    run = F.col("line_no") - F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))
    runs = top.withColumn("run", run).groupBy("doc_id", "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ").alias("title"), F.max("line_no").alias("last_line"))
    return runs.groupBy("doc_id").agg(F.min_by(F.struct("title", "last_line"), "run").alias("m")).select("doc_id", "m.title", "m.last_line")


CHARSETS = ("UTF-8", "windows-1251", "IBM866", "KOI8-R", "UTF-16LE")


def best_charset(files: DataFrame, content: str = "content") -> DataFrame:
    """(name, charset, text): bytes decoded in five ways; the one with most Russian letters and least damage is kept, ties by the order of CHARSETS.

    Three of the charsets need spark.sql.legacy.javaCharsets=true, and damage is only replaced with spark.sql.legacy.codingErrorAction=true.
    """
    tried = F.array(*[F.struct(F.lit(-i).alias("order"), F.lit(c).alias("charset"), F.decode(content, c).alias("text")) for i, c in enumerate(CHARSETS)])

    def score(text: Column) -> Column:
        n = lambda p: F.regexp_count(text, F.lit(p))
        return n("[а-яё]") * 2 + n("[a-z ]") - n("[А-ЯЁ]") - n("�") * 50 - n("[\\u0000-\\u0008\\u000e-\\u001f]") * 10 - n("[ђѓєѕіїјљњћќўџ\\u2500-\\u25ff]") * 5

    # The best of a file is told in its row, so that one text of five is moved.
    best = F.array_max(F.transform(tried, lambda t: F.struct(score(t["text"]).alias("score"), t["order"].alias("order"), t["charset"].alias("charset"), t["text"].alias("text"))))
    rows = files.select("name", best.alias("t")).select("name", "t.*")
    return rows.groupBy("name").agg(F.max_by(F.struct("charset", "text"), F.struct("score", "order")).alias("m")).select("name", "m.charset", "m.text")


def toc_headings(lines: DataFrame) -> DataFrame:
    """(doc_id, pos, ru, en): headings in capitals after 'contents', repeats dropped, Russian and English ones paired by place."""
    low = F.lower("line")
    w = Window.partitionBy("doc_id").orderBy("line_no")
    after = F.max(F.when(low.rlike("^(содержание|contents)$"), True)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    caps = F.col("line").rlike(f"[{CAPITAL}]{{3}}") & ~F.col("line").rlike(f"[{SMALL}]") & ~F.col("line").rlike("[0-9]+$") & ~low.rlike("^(содержание|contents)$")
    rows = lines.withColumn("after", F.coalesce(after, F.lit(False))).filter(F.col("after") & caps)
    rows = rows.withColumn("before", F.lag("line").over(w)).filter("before IS NULL OR before <> line")
    lang = F.when(F.col("line").rlike("[А-ЯЁ]"), "ru").otherwise("en")
    rows = rows.withColumn("lang", lang).withColumn("pos", F.row_number().over(Window.partitionBy("doc_id", "lang").orderBy("line_no")))
    side = lambda x: rows.filter(F.col("lang") == x).select("doc_id", "pos", F.col("line").alias(x))
    return side("ru").join(side("en"), ["doc_id", "pos"], "full_outer")


def route_author_format(raw: DataFrame) -> DataFrame:
    """raw with format: html, detailed or simple."""
    kind = F.when(F.col("raw").rlike("(?i)<(strong|b|p|sup)[ >]"), "html").when(F.col("raw").rlike("(?i)\\s[-–]\\s|e-mail:"), "detailed").otherwise("simple")
    return raw.withColumn("format", kind)


def authors_from_html(raw: DataFrame) -> DataFrame:
    """(article_id, ord, full_name): the bold names of marked-up author strings."""
    names = F.regexp_extract_all("raw", F.lit("(?i)<(?:strong|b)>([^<]+)</(?:strong|b)>"), F.lit(1))
    return raw.select("article_id", F.posexplode(names).alias("pos", "name")).select("article_id", (F.col("pos") + 1).alias("ord"), strip_html(F.col("name")).alias("full_name"))


def authors_from_detail(raw: DataFrame) -> DataFrame:
    """(article_id, ord, full_name, organization, email) of lines 'Name - organisation. E-mail: address'; an e-mail on a line of its own belongs to the one before."""
    lines = raw.select("article_id", F.posexplode(F.split("raw", "\n")).alias("line_no", "line")).filter("trim(line) <> ''")
    runs = glue_runs(lines, ~F.lower("line").rlike("^\\s*(e-mail|email)"), ["article_id"])
    name = F.trim(F.regexp_extract("text", r"^(.*?)\s[-–]\s", 1))
    org = F.trim(F.regexp_extract("text", r"(?i)^.*?\s[-–]\s(.*?)\.?\s*(?:e-mail:.*)?$", 1))
    return runs.select("article_id", F.col("run").cast("int").alias("ord"), name.alias("full_name"), org.alias("organization"), F.get(emails(F.col("text")), F.lit(0)).alias("email")).filter("full_name <> ''")


def authors_from_list(raw: DataFrame) -> DataFrame:
    """(article_id, ord, full_name) of a comma list; initials that stand alone go to the name before."""
    parts = raw.select("article_id", F.posexplode(F.split("raw", r"\s*[,;]\s*")).alias("line_no", "line")).filter("line <> ''")
    runs = glue_runs(parts, ~F.col("line").rlike(f"^[{CAPITAL}]\\.(\\s?[{CAPITAL}]\\.)?$"), ["article_id"])
    return runs.select("article_id", F.col("run").cast("int").alias("ord"), F.trim("text").alias("full_name"))


def valid_names(author: DataFrame) -> DataFrame:
    """author rows with cleaned names that can be names: a capital, two letters, no more than six words, no digits left."""
    name = F.trim(F.regexp_replace(F.regexp_replace("full_name", "[0-9*]+|\\([^)]*\\)", ""), "\\s+", " "))
    cleaned = author.withColumn("full_name", name)
    return cleaned.filter(F.col("full_name").rlike(f"[{CAPITAL}]") & (F.length("full_name") > 2) & (F.size(F.split("full_name", " ")) <= 6))


def pick_issue_files(files: DataFrame) -> DataFrame:
    """(issue, path, kind, place): the documents of an issue folder; where a doc or pdf subfolder is, only those in one.

    files: issue, path (below the issue folder).
    """
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(ext.isin("doc", "docx", "rtf"), "doc").when(ext == "pdf", "pdf")
    rows = files.withColumn("kind", kind).filter(F.col("kind").isNotNull() & ~name.startswith("~") & ~name.startswith("."))
    own = F.lower(F.split("path", "/")[0]).isin("doc", "pdf") & (F.size(F.split("path", "/")) > 1)
    rows = rows.withColumn("own", own).withColumn("any", F.bool_or("own").over(Window.partitionBy("issue"))).filter("own OR NOT any")
    return rows.select("issue", "path", "kind", F.row_number().over(Window.partitionBy("issue", "kind").orderBy("path")).alias("place"))


# First bytes (hexadecimal) of file types, and the types that extensions may have.
MAGIC = (("25504446", "pdf"), ("D0CF11E0A1B11AE1", "ole"), ("504B0304", "zip"), ("7B5C727466", "rtf"), ("89504E470D0A1A0A", "png"), ("FFD8FF", "jpeg"), ("47494638", "gif"), ("49492A00", "tiff"), ("4D4D002A", "tiff"))
EXPECTED = (("pdf", "pdf"), ("doc", "ole"), ("xls", "ole"), ("docx", "zip"), ("xlsx", "zip"), ("zip", "zip"), ("rtf", "rtf"), ("png", "png"), ("jpg", "jpeg"), ("jpeg", "jpeg"), ("gif", "gif"), ("tif", "tiff"), ("tiff", "tiff"), ("txt", "text"))
UPLOAD_MOST = 100 << 20


def mime_audit(files: DataFrame) -> DataFrame:
    """(name, detected, expected, ok) of files (name, sample): the type by first bytes against the one that the extension promises."""
    head = F.hex(F.substring("sample", 1, 16))
    detected = F.coalesce(*[F.when(F.startswith(head, F.lit(m)), t) for m, t in MAGIC], F.when(~F.hex("sample").rlike("^(..)*00"), "text"), F.lit("unknown"))
    ext = F.lower(F.regexp_extract("name", r"\.([A-Za-z0-9]+)$", 1))
    expected = F.create_map(*[F.lit(x) for pair in EXPECTED for x in pair])[ext]
    return files.select("name", detected.alias("detected"), expected.alias("expected"), F.coalesce(detected == expected, F.lit(False)).alias("ok"))


def upload_audit(files: DataFrame) -> DataFrame:
    """(name, extension_ok, size_ok, type_ok, verdict) of files (name, len, sample)."""
    audit = mime_audit(files.select("name", "sample"))
    out = files.select("name", "len").join(audit, "name")
    e, s, t = F.col("expected").isNotNull(), F.col("len") <= UPLOAD_MOST, F.col("ok")
    verdict = F.when(~e, "extension").when(~s, "size").when(~t, "type").otherwise("accepted")
    return out.select("name", e.alias("extension_ok"), s.alias("size_ok"), t.alias("type_ok"), verdict.alias("verdict"))


def author_positions(info: DataFrame, author: DataFrame) -> DataFrame:
    """(article_id, ord, position): 'Name – position' lines joined to authors (article_id, ord, surname) by the folded last word of the name."""
    split = info.select("article_id", F.trim(F.regexp_extract("line", r"^(.*?)\s[-–]\s", 1)).alias("who"), F.trim(F.regexp_extract("line", r"^.*?\s[-–]\s(.*)$", 1)).alias("position")).filter("who <> ''")
    key = lambda c: F.translate(F.lower(F.element_at(F.split(c, r"\s+"), -1)), "ё", "е")
    found = split.withColumn("k", key("who")).join(author.select("article_id", "ord", F.translate(F.lower("surname"), "ё", "е").alias("k")), ["article_id", "k"])
    return found.groupBy("article_id", "ord").agg(F.min("position").alias("position"))


def name_keys(author: DataFrame) -> DataFrame:
    """author rows with the key that groups spellings of one person."""
    return author.withColumn("key", author_key(F.col("full_name")))
