"""Front matter of texts without headings: title, and the authors with their addresses and organisations.

All of it is decided from the first lines of a document: one window over them and one aggregation, both by document, so lines that are
stored by document don't move. Lines become arrays of names, addresses and organisations before they are grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galley.functions.scalars import expand_indices

# Words of organisations (the short ones begin a word), of lines that end the front matter, and beginnings of lines that don't belong to it.
ORGANISATIONS = (
    "университет", "институт", "академия", "факультет", "кафедра", "лаборатория", "фгаоу", "фгбоу", "фгбну", "фгуп",
    "university", "institute", "academy", "college", "department", "laboratory", "research center", "school of",
)
SHORT_ORGANISATIONS = ("нии", "мгту", "мгу", "мирэа", "мфти", "мифи", "вунц", "центр", "им\\.", "имени")
STOPS = ("аннотация", "abstract", "введение", "introduction", "ключевые слова", "keywords", "key words", "постановка", "рецензи", "поступила", "received")
SKIPPED = ("удк", "udc", "doi:", "doi ", "научная статья", "original article", "http")
ADDRESS = ("улица", "ул\\.", "e-mail", "email", "тел", "phone", "spin", "адрес", "д\\.\\s*[0-9]")

ORGANISATION = f"{'|'.join(ORGANISATIONS)}|(?<![а-яё])(?:{'|'.join(SHORT_ORGANISATIONS)})"
HONOURED = r"\bnamed?\b"
MAIL = r"[A-Za-z][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
NUMBERS = "[0-9]{1,2}(?:\\s*[,–−-]\\s*[0-9]{1,2})*"
#: What may stand before the first name of a line.
LEAD = "^(?iu:(?:авторы?|authors?)\\s*:)?[\\s0-9,*–−-]*"
#: A line of more characters is body text and ends the front matter.
LONGEST = 2000


def _forms(capital: str, small: str, whole: str) -> tuple[str, str]:
    """Names with two initials, before or after the surname; and names that are written out."""
    surname, word, initials = f"{capital}{small}+(?:-{capital}{small}+)*", f"{capital}{small}{{2,}}(?:-{capital}{small}+)?", f"{capital}\\.\\s*{capital}\\."
    return f"{initials}\\s*{surname}|{surname}\\s+{initials}", whole.replace("W", word).replace("I", f"{capital}\\.")


_ru, _en = _forms("[А-ЯЁ]", "[а-яё]", r"W\s+W\s+W"), _forms("[A-Z]", "[a-z]", r"W\s+(?:W\s+|I\s+)?W")
INITIALLED, WRITTEN_OUT = f"(?:{_ru[0]}|{_en[0]})", f"(?:{_ru[1]}|{_en[1]})"
AFTER = f"\\s*({NUMBERS})?"
TOKEN = f"(?<![А-Яа-яЁёA-Za-z])({INITIALLED}){AFTER}"
WHOLE = f"^\\s*({INITIALLED}|{WRITTEN_OUT}){AFTER}\\s*[.*]*\\s*$"
#: Commas between names, not those inside a list of numbers.
BETWEEN = "[;,](?!\\s*[0-9]{1,2}\\s*(?:[,;]|$))"

NAMES = "array<struct<name:string,numbers:array<int>>>"
none = lambda kind: F.array().cast(kind)
squeezed = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
numbers_in = lambda c: expand_indices(F.regexp_replace(c, "−", "-"))


def _named(token: Column, pattern: str) -> Column:
    return F.struct(squeezed(F.regexp_extract(token, pattern, 1)).alias("name"), numbers_in(F.regexp_extract(token, pattern, 2)).alias("numbers"))


def line_names(line: Column) -> Column:
    """array<struct<name, numbers>>: the names of a line from left to right.

    Initials with a surname are a name wherever they stand; words alone are one only in a list that begins the line and up to its first
    entry that is something else ("Moscow, Russian Federation" has none). Entries that name an organisation or tell whom it honours have none.
    """
    pieces = F.split(F.regexp_replace(line, LEAD, ""), BETWEEN)
    other = lambda x: F.lower(x).rlike(ORGANISATION) | F.lower(x).rlike(HONOURED)

    def found(pieces: Column) -> Column:
        end = F.coalesce(F.array_min(F.filter(F.transform(pieces, lambda x, i: F.when(~x.rlike(WHOLE) | other(x), i)), lambda i: i.isNotNull())), F.size(pieces))
        inside = lambda x: F.transform(F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0)), lambda t: _named(t, TOKEN))
        names = lambda x, i, end: F.when(i < end, F.array(_named(x, WHOLE))).when(other(x), none(NAMES)).otherwise(inside(x))
        return F.get(F.transform(F.array(end), lambda end: F.flatten(F.transform(pieces, lambda x, i: names(x, i, end)))), F.lit(0))

    return F.get(F.transform(F.array(pieces), found), F.lit(0))


def line_mails(line: Column) -> Column:
    """array<struct<mail, numbers>>: addresses with the numbers right before them ("1a@b.ru", "1, 2 a@b.ru"; those of a street don't count)."""
    whole = f"(?:(?:^|(?<=[,;]))\\s*({NUMBERS})\\s*)?({MAIL})"
    tight = F.regexp_replace(line, r"@\s+", "@")
    return F.transform(F.regexp_extract_all(tight, F.lit(whole), F.lit(0)), lambda t: F.struct(F.regexp_extract(t, f"{MAIL}$", 0).alias("mail"), numbers_in(F.regexp_extract(t, f"^\\s*({NUMBERS})\\s*{MAIL}$", 1)).alias("numbers")))


def line_organisation(line: Column) -> Column:
    """array<struct<name, numbers>> of one organisation or none: from the first entry with a word of one to an address; numbers that begin the line are its."""
    pieces = F.split(F.regexp_replace(line, f"^\\s*{NUMBERS}\\s*", ""), ",")

    def cut(pieces: Column) -> Column:
        at = F.array_min(F.filter(F.transform(pieces, lambda x, i: F.when(F.lower(x).rlike(ORGANISATION), i + 1)), lambda i: i.isNotNull()))
        kept = F.regexp_replace(F.array_join(F.slice(pieces, at, F.size(pieces)), ","), f"(?iu),\\s*(?:{'|'.join(ADDRESS)}).*$", "")
        return F.regexp_replace(squeezed(F.regexp_replace(kept, f"(?:[0-9]+\\s*)?{MAIL}", "")), "[,;. ]+$", "")

    name = F.get(F.transform(F.array(pieces), cut), F.lit(0))
    made = lambda name: F.when(F.length(name) > 5, F.array(F.struct(name.alias("name"), numbers_in(F.regexp_extract(line, f"^\\s*({NUMBERS})", 1)).alias("numbers")))).otherwise(none(NAMES))
    return F.when(F.lower(line).rlike(ORGANISATION), F.get(F.transform(F.array(name), made), F.lit(0))).otherwise(none(NAMES))


def front_lines(lines: DataFrame, zone: int = 30) -> DataFrame:
    """(doc_id, k, line, is_title) of the lines of the front matter, k counted without empty lines.

    It lies in the first `zone` lines and ends before one with a stop word or over LONGEST characters. Its first line of more than three
    characters begins the title, unless a name with initials begins it or it has an address. The title goes on to the first line that is
    short (five characters or less), begins with any name, or has an address or an organisation.
    """
    w = Window.partitionBy("doc_id")
    rows = lines.filter(F.trim("line") != "").select("doc_id", F.row_number().over(w.orderBy("line_no")).alias("k"), F.trim("line").alias("line")).filter(F.col("k") <= zone)
    low = F.lower("line")
    stops = F.min(F.when(low.rlike("|".join(STOPS)) | (F.length("line") > LONGEST), F.col("k"))).over(w)
    rows = rows.withColumn("stop", F.coalesce(stops, F.lit(zone + 1))).filter((F.col("k") < F.col("stop")) & ~low.rlike(f"^(?:{'|'.join(SKIPPED)})") & (F.length("line") > 2))
    entry = F.get(F.split(F.regexp_replace("line", LEAD, ""), BETWEEN), F.lit(0))
    opens = F.col("line").rlike(f"{LEAD}{INITIALLED}") | F.col("line").rlike(MAIL)
    rows = rows.withColumn("opens", opens).withColumn("first", F.min(F.when(F.length("line") > 3, F.col("k"))).over(w))
    later = (F.col("k") > F.col("first")) & (low.rlike(ORGANISATION) | (F.length("line") <= 5) | entry.rlike(WHOLE))
    end = F.min(F.when((F.col("k") >= F.col("first")) & (F.col("opens") | later), F.col("k"))).over(w)
    return rows.withColumn("end", F.coalesce(end, F.lit(zone + 1))).filter(F.col("k") >= F.col("first")).select("doc_id", "k", "line", (F.col("k") < F.col("end")).alias("is_title"))


def copyright_names(lines: DataFrame) -> DataFrame:
    """(doc_id, holders): the names behind the last © of the first line, anywhere in the text, that has such names."""
    found = lines.filter(F.contains("line", F.lit("©"))).select("doc_id", "line_no", line_names(F.substring_index("line", "©", -1)).alias("names")).filter(F.size("names") > 0)
    return found.groupBy("doc_id").agg(F.min_by("names", "line_no").alias("holders"))


def _linked(names: Column, mails: Column, orgs: Column) -> Column:
    """Names with what bears one of their numbers: addresses by the first number, organisations by any. What has no number of its own goes by place, and a single organisation to all."""
    different = F.array_distinct(F.transform(orgs, lambda o: o["name"]))

    def author(x: Column, i: Column) -> Column:
        own = F.filter(mails, lambda m: F.array_contains(m["numbers"], F.get(x["numbers"], F.lit(0))))
        of = F.array_distinct(F.transform(F.filter(orgs, lambda o: F.arrays_overlap(o["numbers"], x["numbers"])), lambda o: o["name"]))
        mail = F.when(F.size(own) > 0, F.array_join(F.transform(own, lambda m: m["mail"]), ", ")).otherwise(F.get(mails, i)["mail"])
        org = F.when(F.size(of) > 0, F.array_join(of, "; ")).when(F.size(different) == 1, F.get(different, F.lit(0))).otherwise(F.get(different, i))
        return F.struct(x["name"].alias("name"), x["numbers"].alias("numbers"), F.coalesce(mail, F.lit("")).alias("email"), F.coalesce(org, F.lit("")).alias("organization"))

    return F.transform(names, author)


def front_matter(lines: DataFrame, zone: int = 30) -> DataFrame:
    """(doc_id, title, authors array<struct<name, numbers, email, organization>>) of texts without headings: a row for each with a title, a name or an address.

    lines: doc_id, line_no, line. A name is taken where it stands first; repeats in its own line are namesakes, in later ones mentions. An
    address without a number belongs to that of the address before it. Without names in the front, those behind a © count; without any,
    each address is an author of no name. Texts of empty lines and null lines give nothing.
    """
    rows = front_lines(lines, zone).withColumns({"names": line_names(F.col("line")), "mails": line_mails(F.col("line")), "orgs": line_organisation(F.col("line"))})
    part = F.when(~F.col("is_title"), F.struct("k", "names", "mails", "orgs"))
    grouped = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("is_title"), F.struct("k", "line")))).alias("heads"), F.array_sort(F.collect_list(part)).alias("parts"))
    placed = F.flatten(F.transform("parts", lambda p: F.transform(p["names"], lambda n: F.struct(n["name"].alias("name"), n["numbers"].alias("numbers"), p["k"].alias("k")))))
    title = F.regexp_replace(F.array_join(F.transform("heads", lambda h: h["line"]), " "), r"^[0-9]+\.\s*", "")
    told = grouped.select("doc_id", title.alias("title"), placed.alias("placed"), F.flatten(F.transform("parts", lambda p: p["mails"])).alias("mails"), F.flatten(F.transform("parts", lambda p: p["orgs"])).alias("orgs"))
    names = F.filter("placed", lambda x: ~F.exists("placed", lambda y: (y["name"] == x["name"]) & (y["k"] < x["k"])))
    before = lambda i: F.filter(F.slice("mails", F.lit(1), i + 1), lambda m: F.size(m["numbers"]) > 0)
    mails = F.transform("mails", lambda m, i: F.struct(m["mail"].alias("mail"), F.coalesce(F.get(before(i), F.size(before(i)) - 1)["numbers"], m["numbers"]).alias("numbers")))
    told = told.select("doc_id", "title", F.transform(names, lambda x: F.struct(x["name"].alias("name"), x["numbers"].alias("numbers"))).alias("names"), mails.alias("mails"), "orgs")
    all_rows = told.join(copyright_names(lines), "doc_id", "full_outer")
    empty = {"mails": "array<struct<mail:string,numbers:array<int>>>", "orgs": NAMES, "names": NAMES, "holders": NAMES}
    all_rows = all_rows.withColumns({c: F.coalesce(c, none(kind)) for c, kind in empty.items()})
    nameless = F.transform("mails", lambda m: F.struct(F.lit("").alias("name"), F.array().cast("array<int>").alias("numbers"), m["mail"].alias("email"), F.lit("").alias("organization")))
    known = F.when(F.size("names") > 0, F.col("names")).otherwise(F.col("holders"))
    authors = F.when((F.size("names") == 0) & (F.size("holders") == 0), nameless).otherwise(_linked(known, F.col("mails"), F.col("orgs")))
    return all_rows.select("doc_id", F.coalesce("title", F.lit("")).alias("title"), authors.alias("authors")).filter((F.col("title") != "") | (F.size("authors") > 0))


def front_authors(front: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, pos, name, numbers, email, organization, keep): one row an author, pos from 1; numbers comma-joined; keep: columns of the document."""
    rows = front.select("doc_id", *keep, F.posexplode("authors").alias("i", "a"))
    return rows.select("doc_id", (F.col("i") + 1).alias("pos"), "a.name", F.array_join("a.numbers", ",").alias("numbers"), "a.email", "a.organization", *keep)
