"""Small literal cases of scalar functions and line jobs."""

import pytest
from pyspark.sql import functions as F

from galley.functions import scalars as s
from galley.operators import filters, joins, mining, windows
from galley.sources import records, text


def value(spark, column, **row):
    return spark.createDataFrame([row or {"x": ""}]).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("n", "form"), [(1, "статья"), (2, "статьи"), (5, "статей"), (11, "статей"), (21, "статья"), (112, "статей"), (0, "статей")])
def test_plural(spark, n, form):
    assert value(spark, s.plural_form(F.col("n"), "статья", "статьи", "статей"), n=n) == form


def test_keywords_keep_brackets(spark):
    assert value(spark, s.split_keywords(F.col("t")), t="метод (один, два); [a, b], «в, г» ,, конец") == ["метод (один, два)", "[a, b]", "«в, г»", "конец"]


def test_indices(spark):
    assert value(spark, s.expand_indices(F.col("t")), t="1, 2, 4-6, 2") == [1, 2, 4, 5, 6]


def test_codes(spark):
    t = "a@b.example 0000-0001-0002-000X 1234-5678 УДК 539.2 https://doi.org/10.18127/j00001111-199901-05."
    assert value(spark, s.orcids(F.col("t")), t=t) == ["0000-0001-0002-000X"]
    assert value(spark, s.spins(F.col("t")), t="0000-0001-0002-000X 1234-5678") == ["1234-5678"]
    assert value(spark, s.dois(F.col("t")), t=t) == ["10.18127/j00001111-199901-05"]
    assert value(spark, s.udk(F.col("t")), t=t) == "539.2"


def test_homoglyphs_and_skeletons(spark):
    assert value(spark, s.homoglyph_fix(F.col("t")), t="Aннотация") == "Аннотация"
    for texts in (["Журавлёв Юрий", "Zhuravlev Yurij", "Žuravlëv Ûrij", "Zhuravlev Juriy"], ["Щёголев Цой", "Shchegolev Tsoy", "Ŝëgolev Coj"], ["Чаплыгин, Яхин", "Chaplygin, Yakhin", "Čaplygin, Âhin"], ["Схимник", "Skhimnik"]):
        assert len({value(spark, s.translit_skeleton(F.col("t")), t=t) for t in texts}) == 1, texts
    assert value(spark, s.translit_skeleton(F.col("t")), t="Схимник") != value(spark, s.translit_skeleton(F.col("t")), t="Симник")
    assert value(spark, s.translit_skeleton(F.col("t")), t="Щукин Ю.") == value(spark, s.translit_skeleton(F.col("t")), t="Shchukin Yu.")


def test_dates(spark):
    assert value(spark, s.iso_date(F.col("t")), t="01.02.2000") == "2000-02-01"
    assert value(spark, s.iso_date(F.col("t")), t="31.02.2000") is None
    assert value(spark, s.ru_date(F.col("t")), t="soon") == "soon"


def test_numbering(spark):
    assert value(spark, windows.numbered_list_size(F.col("t")), t="1. a\n2. b\n7. x\n3. c\n4. _d") == 3


def test_natural_order(spark):
    df = spark.createDataFrame([("Rt_10",), ("rt_9",), ("Rt_2",)], "name string")
    assert [r["name"] for r in windows.natural_sort(df, "name").collect()] == ["Rt_2", "rt_9", "Rt_10"]


def test_listing(spark):
    lines = ["-rw-r--r-- 1 u g 12 Dec 31 10:20 a b.txt", "drwxr-xr-x 2 u g 0 Jan 5 1999 d", "01-02-99 02:30PM <DIR> e", "total 5"]
    rows = text.listing_parse(spark.createDataFrame([(x,) for x in lines], "line string"), "2000-06-01").collect()
    assert [(r["name"], r["is_dir"], r["size"], str(r["mtime"])) for r in rows] == [("a b.txt", False, 12, "1999-12-31 10:20:00"), ("d", True, 0, "1999-01-05 00:00:00"), ("e", True, 0, "1999-01-02 14:30:00")]


def test_like_pattern_is_literal(spark):
    df = spark.createDataFrame([(1, "50% off", "x", None), (2, "50 off", "x", None)], "id int, title string, authors string, deleted_at timestamp")
    assert [r["id"] for r in filters.search_title_author(df, "50%").collect()] == [1]


def test_references_align_in_order(spark):
    ru = spark.createDataFrame([(1, 1, "Иванов И.И. Волны в среде"), (1, 2, "Только по-русски"), (1, 3, "Петров П. https://doi.org/10.1234/ab")], "article_id int, pos int, text string")
    en = spark.createDataFrame([(1, 1, "Ivanov I.I. Volny v srede"), (1, 2, "Something, doi 10.1234/ab"), (1, 3, "Extra one")], "article_id int, pos int, text string")
    rows = {(r["ru_pos"], r["en_pos"]) for r in joins.align_references(ru, en).collect()}
    assert rows == {(1, 1), (2, None), (3, 2), (None, 3)}


def test_references_glue(spark):
    lines = ["Список источников", "1. First", "part two", "_tail", "2. Second"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines, 1)], "doc_id int, line_no int, line string")
    assert sorted((r["pos"], r["ref"]) for r in mining.split_references(df).collect()) == [(1, "First part two_tail"), (2, "Second")]


def test_near_heading(spark):
    df = spark.createDataFrame([(1, 1, "Список  источнокив"), (1, 2, "Ключевые  слова:"), (1, 3, "Keyword")], "doc_id int, line_no int, line string")
    assert [r["heading"] for r in mining.canon_headings(df).orderBy("line_no").collect()][1:] == ["keywords_ru", None]


def test_charset(spark):
    for key in ("javaCharsets", "codingErrorAction"):
        spark.conf.set(f"spark.sql.legacy.{key}", "true")
    names = {"windows-1251": "cp1251", "IBM866": "cp866", "KOI8-R": "koi8-r", "UTF-8": "utf-8"}
    t = "Научная статья о волнах в средах"
    df = spark.createDataFrame([(k, bytearray(t.encode(v))) for k, v in names.items()], "name string, content binary")
    assert all(r["name"] == r["charset"] and r["text"] == t for r in mining.best_charset(df).collect())


def test_uploads(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.docx").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "c.exe").write_bytes(b"MZ")
    rows = {r["name"]: r["verdict"] for r in mining.upload_audit(records.upload_audit_scan(spark, str(tmp_path))).collect()}
    assert rows == {"a.pdf": "accepted", "b.docx": "type", "c.exe": "extension"}


@pytest.mark.parametrize(
    ("en", "pairs"),
    [
        ([0, 1, 2, 3], {(0, 0), (1, 1), (2, 2), (3, 3)}),
        ([1, 2, 3, 0], {(1, 0), (2, 1), (3, 2)}),  # a list that begins with the second reference keeps three pairs
        ([0, None, 1], {(0, 0), (1, 2)}),
        ([], set()),
    ],
)
def test_references_keep_the_best_order(spark, en, pairs):
    ru = ["Журавлёв И.И. Основы теории полёта. М.: Наука, 2010.", "Петров П.П. Методы расчёта. СПб.: Питер, 2015.", "Щукин Ю.Ю. Химия и жизнь. Казань, 1999.", "Без букв. DOI: 10.1000/abc.123"]
    latin = ["Zhuravlev I.I. Osnovy teorii poleta. M.: Nauka, 2010.", "Petrov P.P. Metody rascheta. SPb.: Piter, 2015.", "Shchukin Yu.Yu. Khimiya i zhizn. Kazan, 1999.", "Quite different words. DOI: 10.1000/abc.123"]
    left = spark.createDataFrame([(1, i, t) for i, t in enumerate(ru)], "article_id int, pos int, text string")
    right = spark.createDataFrame([(1, i, "Wxqv jjj zzq, 1801" if k is None else latin[k]) for i, k in enumerate(en)], "article_id int, pos int, text string")
    rows = joins.align_references(left, right).collect()
    assert {(r["ru_pos"], r["en_pos"]) for r in rows if r["score"] is not None} == pairs
    assert len(rows) == len(ru) + len(en) - len(pairs)


def test_dump_values_may_be_long_or_have_brackets(spark):
    long = "x'y (z), \\ " * 9000
    quoted = "'" + long.replace("\\", "\\\\").replace("'", "\\'") + "'"
    line = f"INSERT INTO `nomera` VALUES (1,{quoted},now(),NULL),(2,'(',f(1, 2),3);"
    rows = [tuple(r["cols"]) for r in text.sql_dump_ingest(spark.createDataFrame([(line,)], "value string")).collect()]
    assert rows == [("1", long, "now()", None), ("2", "(", "f(1, 2)", "3")]


def test_listing_forms(spark):
    lines = [
        "lrwxrwxrwx 1 ftp ftp 7 jan 05 2001 now -> Iss 01", "crw------- 1 root root 0 Feb  3 04:05 dev", "drwxr-xr-x   2 ftp ftp 4096 Dec 31 23:59 a  b",
        "03-04-05  17:06  <dir>  docs", "03-04-1999  05:06pm  12 a b.pdf", "03-04-70  12:06AM  12 c", "total 12", "drwxr-xr-x 2 ftp ftp 4096 Foo 31 2000 x", "",
    ]
    got = [(r["name"], r["is_dir"], r["size"], str(r["mtime"])) for r in text.listing_parse(spark.createDataFrame([(x,) for x in lines], "line string"), "2003-06-01").collect()]
    assert got == [
        ("now", False, 7, "2001-01-05 00:00:00"), ("dev", False, 0, "2003-02-03 04:05:00"), ("a  b", True, 4096, "2002-12-31 23:59:00"),
        ("docs", True, 0, "2005-03-04 17:06:00"), ("a b.pdf", False, 12, "1999-03-04 17:06:00"), ("c", False, 12, "1970-03-04 00:06:00"),
    ]


def test_numbers_over_all_rows(spark):
    from galley.operators.numbering import numbered_by

    rows = [((i * 7919) % 997 if i % 50 else None, f"k{i % 13}") for i in range(3000)]
    got = numbered_by(spark.createDataFrame(rows, "a int, b string").repartition(5), ["a", "b"], parts=7, sample=60).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(r["n"] for r in got) == list(range(1, 3001))
    assert [key(r) for r in sorted(got, key=lambda r: r["n"])] == sorted(map(key, rows))
    assert numbered_by(spark.createDataFrame([], "a int, b string"), ["a", "b"]).count() == 0


def test_numbers_of_dois_are_never_cut(spark):
    from galley.operators import windows

    article = spark.range(1, 106).selectExpr("id", "1L AS issue_id", "concat(id, '-', id) AS pages", "CASE WHEN id = 105 THEN 'x' END AS doi")
    issue = spark.createDataFrame([(1, "0033-8486", 2020, "1(1)")], "issue_id long, issn string, year int, number string")
    found = sorted(r["doi"] for r in windows.assign_doi(article, issue).collect())
    assert len(set(found)) == 104
    assert "10.18127/j00338486-202001(01)-02" in found and "10.18127/j00338486-202001(01)-105" in found


def test_issue_segments(spark):
    from galley.functions.scalars import issue_segment

    rows = spark.createDataFrame([("1",), ("1(1)",), (" 10 ",), ("100(12)",), ("1-2",), ("-1",)], "n string")
    assert [r[0] for r in rows.select(issue_segment(F.col("n"))).collect()] == ["01", "01(01)", "10", "100(12)", "1-2", "-1"]


def test_natural_order_of_long_numbers(spark):
    from galley.operators import windows

    names = ["a1234567890129", "a123456789013", "a0007", "a7b", "a12345678901234567890123456789", "b"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r["name"] for r in windows.natural_sort(df, "name").collect()] == ["a0007", "a7b", "a123456789013", "a1234567890129", "a12345678901234567890123456789", "b"]


def test_names_of_a_citation(spark):
    from galley.functions.scalars import unbroken
    from galley.operators.checks import name_count

    cases = {
        "Иванов И.И., Петров П.П.": 2, "Маслов. И.В., Кариа C.Н.": 2, "Кузнецова-Белых А.": 1, "Иванов Иван, Петров П. ": 2, "Иванов Иван": 0,
        "Нгуен Ван, Ли С.": 2, "просто слова, и ещё": 0, "": 0,
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "listed string, n int")
    assert [(r[0], r[1]) for r in df.select("listed", name_count(F.col("listed"))).collect()] == list(cases.items())
    broken = spark.createDataFrame([("Кари- \n  бов А.\nда -\nнет",)], "t string")
    assert broken.select(unbroken(F.col("t"))).first()[0] == "Карибов А.\nда -\nнет"
