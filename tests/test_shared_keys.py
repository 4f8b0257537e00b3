"""DOIs that several articles bear, site ids that several sections give, and other texts on which short tables don't differ."""

from pyspark.sql import functions as F

from galley.functions.scalars import fit_digest, spins
from galley.operators import checks, joins, maintenance, mining


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_digest_ends_before_its_last_line_only(spark):
    got = spark.createDataFrame([("ab\ncd\nef",)], "t string").select(fit_digest(F.col("t"), 6)).first()[0]
    assert got == "ab\ncd"


def test_pages_are_no_spins(spark):
    got = spark.createDataFrame([("С. 1005-1012. SPIN 1234-5678",)], "t string").select(spins(F.col("t"))).first()[0]
    assert got == ["1234-5678"]


def test_print_of_a_shared_doi(spark):
    article = spark.createDataFrame([(1, "10.1000/a"), (2, "10.1000/a"), (3, "10.1000/b")], "id long, doi string")
    prints = spark.createDataFrame([(1, "10.1000/a", "10.1000/a"), (2, "cover", "10.1000/a"), (3, "10.1000/b", "10.1000/b"), (4, "cover", "10.1000/b")], "print_id long, first_page string, all_text string")
    assert rows(joins.match_print(article, prints)) == [(1, None, "ambiguous"), (2, None, "ambiguous"), (3, 3, "found")]


def test_registry_has_a_doi_as_often(spark):
    article = spark.createDataFrame([(1, "10.1/a"), (1, "10.1/a"), (2, "10.1/b")], "issue_id long, doi string")
    registry = spark.createDataFrame([("10.1/a", "f"), ("10.1/b", "g")], "doi string, file_uid string")
    assert joins.registry_link(article, registry).orderBy("issue_id").collect() == [(1, None, "not all in the registry"), (2, "g", None)]


def test_one_doi_on_other_pages_is_missing(spark):
    draft = spark.createDataFrame([(1, 1, "10.1/a", "5-12", "old")], "id long, issue_id long, doi string, pages string, section string")
    parsed = spark.createDataFrame([(1, 1, "10.1/a", "5-12"), (2, 1, "10.1/a", "13-20"), (3, 1, "10.1/a", None)], "id long, issue_id long, doi string, pages string")
    toc = spark.createDataFrame([(1, 13, "S")], "issue_id long, page int, section string")
    assert rows(maintenance.append_missing(draft, parsed, toc).select("id", "section")) == [(1, "old"), (2, "S")]


def test_each_pushed_row_has_its_own_id(spark):
    draft = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "issue_id long, doi string")
    site = spark.createDataFrame([(7, "b")], "art_id long, doi string")
    pushed, record = maintenance.push_issue(draft, site, spark.createDataFrame([], "issue_id long"))
    assert rows(pushed) == [(7, "b"), (8, "a"), (9, "a")] and record.count() == 2


def test_sections_with_the_same_ids(spark):
    site = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "art_id long, doi string, razd_id long")
    record = spark.createDataFrame([(1, "b", 2)], "art_id long, doi string, razd_id long")
    kept, skipped = maintenance.rollback_push(record, site, ("razd_id",))
    assert rows(kept.select("art_id", "doi")) == [(1, "a")] and skipped.count() == 0
    plan = spark.createDataFrame([(5, 1, "b", 2)], "issue_id long, old long, doi string, razd_id long")
    assert rows(checks.reorder_guard(plan, site, ("razd_id",))) == [(5, None)]


def test_surname_whose_pairs_a_longer_one_holds_too(spark):
    ru = spark.createDataFrame([(1, 1, "Авторба")], "article_id long, pos int, surname string")
    words = spark.createDataFrame([(1, "Authorba"), (1, "Authorbav")], "article_id long, word string")
    assert mining.surname_by_translit(ru, words).first()["word"] == "Authorba"
