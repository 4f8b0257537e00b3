"""Every query with SQL gives DuckDB's rows."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from galley import catalog

from .conftest import DATA, same_rows

SQL = catalog.oracle_sql()
QUERIES = catalog.queries()


@pytest.fixture(scope="module")
def outcomes(spark, duck, request):
    """name -> the check of that query; planning takes most of the time on small tables, so eight queries run at once."""

    def check(name):
        found = QUERIES[name](spark, DATA)
        if name in SQL:
            same_rows(found, duck.cursor(), SQL[name])
        else:
            assert found.collect()

    wanted = [item.callspec.params["name"] for item in request.session.items if item.path == request.path]
    pool = ThreadPoolExecutor(8)
    yield {name: pool.submit(check, name) for name in wanted}
    pool.shutdown(cancel_futures=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(outcomes, name):
    outcomes[name].result()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql(outcomes, name):
    outcomes[name].result()
