"""Front matter of untemplated texts: forms of names, links by number and place, copyright lines, edge cases."""

import pytest
from pyspark.sql import functions as F

from galley.operators.frontmatter import LONGEST, front_authors, front_matter, line_mails, line_names, line_organisation
from galley.sources.text import manuscript_lines


def front(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return {r["doc_id"]: r for r in front_matter(manuscript_lines(docs)).collect()}


def authors(row):
    return [(a["name"], a["email"], a["organization"]) for a in row["authors"]]


@pytest.mark.parametrize(
    "line, names",
    [
        ("М.В. Букин1, А. А. Керхайли2,3, П.П.Орлов", [("М.В. Букин", [1]), ("А. А. Керхайли", [2, 3]), ("П.П.Орлов", [])]),
        ("Букин М.В. Орлов П. П.", [("Букин М.В.", []), ("Орлов П. П.", [])]),
        ("1 Иванов Алексей Борисович2; Петрова-Водкина Анна Ильинична 1–3", [("Иванов Алексей Борисович", [2]), ("Петрова-Водкина Анна Ильинична", [1, 2, 3])]),
        ("A.B. Ivanov, Petrov C. D., John Smith1, Mary Ann Jones2, Paul K. Wood*", [("A.B. Ivanov", []), ("Petrov C. D.", []), ("John Smith", [1]), ("Mary Ann Jones", [2]), ("Paul K. Wood", [])]),
        ("Авторы: Ли С.П., У. Ц. Ли", [("Ли С.П.", []), ("У. Ц. Ли", [])]),
        ("John Smith, Moscow State University, Russian Federation", [("John Smith", [])]),
        ("Moscow, Russian Federation", []),
        ("МГТУ им. Н.Э. Баумана, кафедра И.И. Иванова", []),
        ("Medal named after A.B. Popov", []),
        ("", []),
        (None, None),
    ],
)
def test_names_of_lines(spark, line, names):
    got = spark.createDataFrame([(line,)], "line string").select(line_names(F.col("line")).alias("n")).first()["n"]
    assert (got and [(x["name"], x["numbers"]) for x in got]) == (names or ([] if line is not None else None))


@pytest.mark.parametrize(
    "line, mails",
    [
        ("1vic@mail.ru, 2 b.c@d.org", [("vic@mail.ru", [1]), ("b.c@d.org", [2])]),
        ("1−3vka@mil.ru", [("vka@mil.ru", [1, 2, 3])]),
        ("ул. Мира, д. 36 a@b.ru", [("a@b.ru", [])]),
        ("kiyashko@ ipfran.ru", [("kiyashko@ipfran.ru", [])]),
        ("none", []),
    ],
)
def test_addresses_of_lines(spark, line, mails):
    got = spark.createDataFrame([(line,)], "line string").select(line_mails(F.col("line")).alias("m")).first()["m"]
    assert [(x["mail"], x["numbers"]) for x in got] == mails


@pytest.mark.parametrize(
    "line, orgs",
    [
        ("1,3 Российский университет дружбы, Москва, ул. Мира, д. 5", [("Российский университет дружбы, Москва", [1, 3])]),
        ("И.И. Иванов, Институт физики РАН, e-mail: a@b.ru", [("Институт физики РАН", [])]),
        ("2Institute of Physics 2 a@b.ru", [("Institute of Physics", [2])]),
        ("при исследовании влиянии", []),
        ("Центр", []),
    ],
)
def test_organisations_of_lines(spark, line, orgs):
    got = spark.createDataFrame([(line,)], "line string").select(line_organisation(F.col("line")).alias("o")).first()["o"]
    assert [(x["name"], x["numbers"]) for x in got] == orgs


def test_links(spark):
    got = front(
        spark,
        "УДК 1\nКороткая теория\nвсего\nИ.И. Иванов1, П.П. Петров2, И.И. Иванов3\n1,3 Институт А\n2 Институт Б\n1a@b.ru, c@d.ru, 2e@f.ru\nАннотация\nС.С. Сидоров",
        "1. Title of it\nA.B. First, C.D. Second\nInstitute of All\nx@y.org\nA.B. First thanks\nAbstract",
        "Заметка\nАннотация\nтекст\n© Иванов И.И., Петров П.П., 2020",
        "Заметка\nq@w.ru, 2 z@w.ru\nВведение",
        "И.И. Иванов\nИнститут Один\nИнститут Два\nAbstract",
    )
    assert got[0]["title"] == "Короткая теория"  # "всего" is short
    assert authors(got[0]) == [("И.И. Иванов", "a@b.ru, c@d.ru", "Институт А"), ("П.П. Петров", "e@f.ru", "Институт Б"), ("И.И. Иванов", "e@f.ru", "Институт А")]
    assert got[1]["title"] == "Title of it"
    assert authors(got[1]) == [("A.B. First", "x@y.org", "Institute of All"), ("C.D. Second", "", "Institute of All")]
    assert authors(got[2]) == [("Иванов И.И.", "", ""), ("Петров П.П.", "", "")]
    assert authors(got[3]) == [("", "q@w.ru", ""), ("", "z@w.ru", "")]
    assert got[4]["title"] == "" and authors(got[4]) == [("И.И. Иванов", "", "Институт Один")]


def test_edges(spark):
    body = "К 100-летию А.А. Харкевича\n" + "слово И.И. Иванов " * (LONGEST // 10) + "\nП.П. Петров"
    got = front(spark, "", None, "\n\n", body, "Abstract", "Тема\n" + "\n" * 50 + "И.И. Иванов", "Тема\n" + "Слово и слово.\n" * 40 + "И.И. Иванов")
    assert sorted(got) == [3, 5, 6]
    assert got[3]["title"] == "К 100-летию А.А. Харкевича" and got[3]["authors"] == []  # the long line ends the front
    assert [a[0] for a in authors(got[5])] == ["И.И. Иванов"]  # empty lines don't count
    assert got[6]["authors"] == []
    empty = spark.createDataFrame([], "doc_id int, line_no int, line string")
    assert front_matter(empty).count() == 0 and front_authors(front_matter(empty)).count() == 0


def test_rows_of_authors(spark):
    docs = spark.createDataFrame([(7, "Тема\nИ.И. Иванов1,2, П.П. Петров\n1 a@b.ru")], "doc_id long, text string")
    rows = front_authors(front_matter(manuscript_lines(docs))).orderBy("pos").collect()
    assert [tuple(r) for r in rows] == [(7, 1, "И.И. Иванов", "1,2", "a@b.ru", ""), (7, 2, "П.П. Петров", "", "", "")]
