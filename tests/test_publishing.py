"""Pushes as one commit: all tables or none, and back again."""

import pytest
from pyspark.sql import functions as F

from galley.operators import publishing as p
from galley.operators.maintenance import author_html
from galley.operators.numbering import sum_before
from galley.sources.versions import Change, Tables

SITE = {
    "site_issue": ([(50, 1, 2020, "1")], "num_id long, journal_id long, year int, number string"),
    "site_section": ([(500, 50, "Физика", 3)], "razd_id long, num_id long, title string, sort int"),
    "site_article": ([(900, 500, "https://doi.org/10.18127/j11112222-202001-01", "Старая", "1-4", "", "", "", None)], "art_id long, razd_id long, doi string, title string, pages string, authors_html string, orgs_html string, abstract_html string, draft_id long"),
    "push_record": ([], "issue_id long, draft_id long, num_id long, razd_id long, art_id long, doi string, num_created boolean, razd_created boolean"),
}
DRAFT = [
    (1, 10, 1, "1111-2222", 2020, "1", "Физика", "Первая", "9-12", None, "Цель. А & Б."),
    (2, 10, 1, "1111-2222", 2020, "1", " ", "Вторая", "5-8", None, None),
    (3, 20, 1, "1111-2222", 2020, "2(1)", "Химия", "Третья", "1-2", "10.1/x", "x"),
    (4, 30, 1, "1111-2222", 2020, "3", "Химия", "Без авторов", "1-2", None, "x"),
    (5, 40, 1, "1111-2222", 2020, "4", "Химия", "С замечаниями", "1-2", None, "x"),
    (6, 60, 1, "1111-2222", 2020, "6", "Химия", "Слишком длинное название статьи", "1-2", None, "x"),
]


@pytest.fixture
def site(spark, tmp_path):
    tables = Tables(spark, f"file://{tmp_path}/site")
    tables.commit({n: Change(spark.createDataFrame(*rows), key=p.KEYS[n], parts=8) for n, rows in SITE.items()}, -1, "load")
    draft = spark.createDataFrame(DRAFT, "id long, issue_id long, journal_id long, issn string, year int, number string, section string, title string, pages string, doi string, abstract string")
    author = spark.createDataFrame([(i, k, f"А.А. Автор{k}", "НИИ <1>", None) for i in (1, 2, 3, 5, 6) for k in (0, 1)], "article_id long, ord int, name string, organization string, email string")
    blocked = spark.createDataFrame([(40,)], "issue_id long")
    return tables, draft, author, blocked


def rows(tables, name):
    return sorted((tuple(r) for r in tables.read(name).collect()), key=repr)


def test_push_makes_issues_sections_dois_and_html(site):
    tables, draft, author, blocked = site
    p.push(tables, draft, author, blocked, {"title": 20})
    assert rows(tables, "site_issue") == [(50, 1, 2020, "1"), (51, 1, 2020, "2(1)")]
    assert rows(tables, "site_section") == [(500, 50, "Физика", 3), (501, 50, "Без раздела", 4), (502, 51, "Химия", 1)]
    found = {r["draft_id"]: r for r in tables.read("site_article").filter("draft_id IS NOT NULL").collect()}
    assert {k: (r["art_id"], r["razd_id"], r["doi"]) for k, r in found.items()} == {2: (901, 501, "10.18127/j11112222-202001-02"), 1: (902, 500, "10.18127/j11112222-202001-03"), 3: (903, 502, "10.1/x")}
    assert found[1]["authors_html"] == "А.А. Автор0<sup>1</sup>, А.А. Автор1<sup>1</sup>" and found[1]["orgs_html"] == "<sup>1</sup> НИИ &lt;1&gt;" and found[1]["abstract_html"] == "<b>Цель.</b> А &amp; Б."
    reasons = {tuple(r) for r in p.refusals(draft, author, blocked, {"title": 20}).collect()}
    assert reasons == {(30, "no authors"), (40, "findings"), (60, "title too long")}


@pytest.mark.parametrize("at", ["site_section", "site_article", "push_record", "pointer"])
def test_all_tables_or_none(site, monkeypatch, at):
    tables, draft, author, blocked = site
    before = {n: rows(tables, n) for n in SITE}
    stage = Tables._stage

    def failing(self, name, change, old):
        if name == at:
            raise OSError("disk full")
        return stage(self, name, change, old)

    def no_pointer(*_):
        raise OSError("disk full")

    with monkeypatch.context() as patched:
        patched.setattr(Tables, "_stage", failing)
        if at == "pointer":
            patched.setattr(Tables, "_put", no_pointer)
        with pytest.raises(OSError):
            p.push(tables, draft, author, blocked)
    assert {n: rows(tables, n) for n in SITE} == before
    p.push(tables, draft, author, blocked)  # what the failed push has left stands in nobody's way
    assert len(rows(tables, "site_article")) == 5


def test_rollback_undoes_a_push(site, spark):
    tables, draft, author, blocked = site
    before = {n: rows(tables, n) for n in SITE}
    p.push(tables, draft, author, blocked)
    pushed = {n: rows(tables, n) for n in SITE}
    assert p.roll_back(tables, spark.createDataFrame([(10,), (20,), (60,)], "issue_id long")).collect() == []
    assert {n: rows(tables, n) for n in SITE} == before
    p.push(tables, draft, author, blocked)
    assert {n: rows(tables, n) for n in SITE} == pushed


def test_rollback_leaves_edited_articles(site, spark):
    tables, draft, author, blocked = site
    p.push(tables, draft, author, blocked)
    edited = tables.read("site_article").withColumn("doi", F.when(F.col("draft_id") == 3, "10.9/other").otherwise(F.col("doi")))
    tables.commit({"site_article": Change(edited, key="razd_id", parts=8)}, tables.current().number, "editor")
    skipped = p.roll_back(tables, spark.createDataFrame([(10,), (20,)], "issue_id long"))
    assert [tuple(r) for r in skipped.collect()] == [(903, "10.9/other")]
    assert {r[0] for r in rows(tables, "site_article")} == {900, 903, 904} and {r[0] for r in rows(tables, "site_section")} == {500, 502, 503}
    assert {r[0] for r in rows(tables, "site_issue")} == {50, 51, 52}


def test_articles_are_written_once_with_their_html(site):
    tables, draft, author, blocked = site
    found, written = [tables.read(n) for n in ("site_issue", "site_section", "site_article")], []

    def stage(df):
        written.append(set(df.columns))
        return df

    p.push_rows(draft, author, *found, blocked, stage=stage)
    assert not any("organization" in columns for columns in written)
    assert sum("authors_html" in columns for columns in written) == 1


def test_authors_without_an_organisation_take_no_part(spark):
    rows = [(1, 1, "А", "НИИ"), (1, 2, "Б", None), (1, 3, "В", "МГУ"), (1, 4, "Г", "НИИ"), (2, 1, "Д", None), (3, 1, None, "НИИ"), (4, 2, "Е", "МГУ"), (4, 1, "Ж", "<НИИ>")]
    found = author_html(spark.createDataFrame(rows, "article_id long, ord int, name string, organization string"))
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == {
        1: ("А<sup>1</sup>, В<sup>3</sup>, Г<sup>1</sup>", "<sup>1</sup> НИИ<br><sup>3</sup> МГУ"),
        2: (None, ""),
        3: ("", "<sup>1</sup> НИИ"),
        4: ("Ж<sup>1</sup>, Е<sup>2</sup>", "<sup>1</sup> &lt;НИИ&gt;<br><sup>2</sup> МГУ"),
    }


def test_sums_before_a_key_go_on_over_blocks(spark):
    found = sum_before(spark.range(50).selectExpr("id * 7 AS k", "id % 3 AS n"), "k", "n", "before", block=8).collect()
    assert len(found) == 50 and all(r["before"] == sum(i % 3 for i in range(r["k"] // 7)) for r in found)
