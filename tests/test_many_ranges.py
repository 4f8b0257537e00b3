"""Pages of a table in very many ranges."""

from pyspark.sql import functions as F

from galley.sources import paging


def test_place_among_many_cuts(spark):
    cuts = [float(x) for x in range(30_000, 0, -10)]
    got = spark.range(0, 30_050, 7).select("id", paging.place_among(F.col("id"), cuts).alias("n")).collect()
    assert all(r["n"] == sum(r["id"] < c for c in cuts) for r in got)
