"""Counts of distinct authors from mergeable sketches: one per issue is stored, and any group of issues is counted without a second pass over the authors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2 to this power are the registers of a sketch; an estimate's standard error is 1.04 / sqrt(4096), 1.6 %.
LG_REGISTERS = 12
#: What estimates are held to: three standard errors.
ERROR = 0.05


def author_sketches(author: DataFrame, article: DataFrame, name: str = "full_name") -> DataFrame:
    """(issue_id, authors): a sketch of the lower-cased names of each issue's authors. author: article_id and the name; article: id, issue_id."""
    own = article.select(F.col("id").alias("article_id"), "issue_id")
    return author.filter(F.col(name).isNotNull()).join(own, "article_id").groupBy("issue_id").agg(F.hll_sketch_agg(F.lower(name), F.lit(LG_REGISTERS)).alias("authors"))


def rolled_up(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(by, n): the estimated number of distinct authors of all sketches of a group."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("authors")).alias("n"))


def compared(estimated: DataFrame, exact: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, close): exact counts, and whether the estimate is within ERROR of them (one name at least)."""
    both = exact.join(estimated.withColumnRenamed("n", "_n"), by)
    return both.select(*by, "n", (F.abs(F.col("_n") - F.col("n")) <= F.greatest(F.lit(1.0), ERROR * F.col("n"))).alias("close"))
