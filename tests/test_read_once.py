"""Texts that a job reads once: no second rendering of documents for a column or a second question about them."""

from galley import catalog
from galley.operators import joins

from .conftest import DATA


def _generated(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Generate ")


def test_titles_come_with_the_authors(spark):
    # Names and holders are read from the lines, and authors are exploded; a join with the titles would do all that again.
    assert _generated(catalog.queries()["front_authors"](spark, DATA)) == 3


def test_prints_are_read_once_for_orphans(spark):
    prints = spark.createDataFrame([(1, "cover", "x 10.1/no 10.1234/a"), (2, None, "10.1234/B and 10.1234/c"), (3, "10.1234/d", None), (4, "", "none"), (5, None, None)], "print_id int, first_page string, all_text string")
    article = spark.createDataFrame([(1, "https://doi.org/10.1234/A"), (2, "10.1234/b"), (3, "10.1234/b"), (4, None)], "id int, doi string")
    found = joins.orphan_prints(prints, article)
    assert [r.print_id for r in found.collect()] == [3] and _generated(found) == 1
    assert sorted(map(tuple, joins.print_dois(prints).collect())) == [(1, "10.1234/a", 1), (2, "10.1234/b", 1), (2, "10.1234/c", 1), (3, "10.1234/d", 0)]
