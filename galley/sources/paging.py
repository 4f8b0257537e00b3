"""Pages of a sorted table that is stored in ranges: a page opens the ranges that it lies in, whatever its number.

Rows are written in folders by range of the key, cut at approximate quantiles, so a range has about ROWS rows; a directory of the ranges'
sizes is written beside them. A page's place among all rows says which ranges hold it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = 100_000
MOST_RANGES = 1024  # folders; of more rows each range has more
RANGE = "range_no"


def place_among(c: Column, cuts: list) -> Column:
    """How many of the cuts, falling ones, are greater than c: by halves, so the expression is as deep as their number has digits, not as long."""

    def within(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(c < cuts[middle], within(middle + 1, high)).otherwise(within(low, middle))

    return within(0, len(cuts))


def store_pages(t: DataFrame, path: str, order: str = "id", rows: int = ROWS) -> None:
    """t in ranges of its numeric column order, from the largest to the smallest; nulls are the last range."""
    total = t.count()
    parts = min(MOST_RANGES, max(1, -(-total // rows)))
    cuts = sorted(set(t.approxQuantile(order, [i / parts for i in range(1, parts)], 0.1 / parts)), reverse=True) if parts > 1 else []
    no = place_among(F.col(order), cuts)
    ranged = t.withColumn(RANGE, F.when(F.col(order).isNull(), len(cuts) + 1).otherwise(no))
    ranged.hint("rebalance", F.col(RANGE)).sortWithinPartitions(RANGE, F.desc(order)).write.partitionBy(RANGE).parquet(f"{path}/rows")
    ranged.groupBy(RANGE).agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/directory")


@dataclass
class Pages:
    spark: SparkSession
    path: str

    def __post_init__(self):
        self.sizes = sorted((r[RANGE], r["n"]) for r in self.spark.read.parquet(f"{self.path}/directory").collect())  # one row a range
        self.total = sum(n for _, n in self.sizes)

    def page(self, number: int, per_page: int = 50, order: str = "id") -> DataFrame:
        """The rows of a page (200 at most) with total and pages, largest keys first."""
        per_page = min(per_page, 200)
        first, before, ranges, skipped = (number - 1) * per_page, 0, [], 0
        for no, n in self.sizes:
            if before < first + per_page and before + n > first:
                skipped = before if not ranges else skipped
                ranges.append(no)
            before += n
        rows = self.spark.read.parquet(f"{self.path}/rows")
        rows = rows.filter(F.col(RANGE).isin(ranges or [-1])).drop(RANGE)
        shown = rows.orderBy(F.desc(order)).offset(max(0, first - skipped)).limit(per_page)
        return shown.withColumns({"total": F.lit(self.total).cast("long"), "pages": F.lit(-(-self.total // per_page)).cast("long")})
