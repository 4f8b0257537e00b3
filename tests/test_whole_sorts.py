"""Sorts of whole tables: every row, in DuckDB's order."""

import pytest

from galley import catalog

from .conftest import DATA, normal

SORTS = ("natural_sort", "folder_order", "issues_order", "issues_order_public", "sorted_directory")


@pytest.mark.parametrize("name", SORTS)
def test_whole_sort(spark, duck, name):
    found = catalog.queries()[name](spark, DATA)
    theirs = duck.cursor().execute(catalog.oracle_sql()[name])
    names = [d[0] for d in theirs.description]
    rows = [tuple(map(normal, r)) for r in theirs.fetchall()]
    assert [tuple(normal(r[c]) for c in names) for r in found.collect()] == rows
    assert rows
    assert "GlobalLimit" not in found._jdf.queryExecution().optimizedPlan().toString()
