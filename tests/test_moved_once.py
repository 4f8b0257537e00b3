"""Author rows are moved once for all that groups them by article, and XML that is only read back is compressed."""

import pytest

from galley.plans import bound_sources
from galley.plans.views import RENDERED, VIEWS, Views
from galley.sources.exports import write_xml

from .conftest import DATA


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_author_rows_grouped_by_article_move_once(spark):
    v = Views(spark, DATA)
    assert exchanges(v.author.groupBy("article_id").count()) == 1
    assert exchanges(v.sql("SELECT article_id, collect_list(ru) FROM v_ref GROUP BY article_id")) == 1


@pytest.mark.parametrize("name", RENDERED)
def test_sparks_rendering_is_the_view(spark, name):
    v = Views(spark, DATA)
    ours, fixture = v.sql(f"SELECT * FROM {name}"), v.sql(VIEWS[name])
    assert ours.dtypes == fixture.dtypes
    assert ours.exceptAll(fixture).isEmpty() and fixture.exceptAll(ours).isEmpty()


def test_read_back_xml_is_compressed(spark, tmp_path):
    found = bound_sources.round_trip(Views(spark, DATA))
    assert all(f.endswith(".xml.gz") for f in found.inputFiles())
    write_xml(spark.range(3), f"file://{tmp_path}/plain")
    assert all(f.endswith(".xml") for f in spark.read.format("xml").option("rowTag", "article").load(f"file://{tmp_path}/plain").inputFiles())
