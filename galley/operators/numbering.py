"""Numbers for all rows of a table in the order of any columns, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered_by(df: DataFrame, order: list[str], name: str = "n", parts: int = 32, sample: int = 2048) -> DataFrame:
    """df with the 1-based place of each row: ranks inside ranges of the order plus the sizes of the ranges before.

    Ranges are cut at rows of a sample that a hash picks (`sample` rows reach the driver), so they depend on values alone and both passes agree.
    """
    picked = df.select(*order).orderBy(F.xxhash64(*order)).limit(sample).orderBy(*order).collect()
    cuts = {tuple(picked[i * len(picked) // parts]) for i in range(1, parts)} if picked else set()
    types = {c: df.schema[c].dataType for c in order}
    as_row = lambda cut: F.struct(*[F.lit(x).cast(types[c]).alias(c) for c, x in zip(order, cut)])
    part = sum((F.when(F.struct(*order) >= as_row(cut), 1).otherwise(0) for cut in cuts), F.lit(0))
    ranged = df.withColumn("_part", part)
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # at most `parts` rows
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return ranked.join(F.broadcast(before), "_part").withColumn(name, F.col("_r") + F.col("_before")).drop("_part", "_r", "_before")


def sum_before(counts: DataFrame, key: str, n: str, name: str, block: int = 4096) -> DataFrame:
    """counts (one row a key, key and n) with the sum of n over all smaller keys: sums inside blocks of keys plus those of the blocks before."""
    ranked = numbered_by(counts, [key], "_i").withColumn("_block", F.floor((F.col("_i") - 1) / block))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = ranked.groupBy("_block").agg(F.sum(n).alias("_n")).select("_block", F.coalesce(F.sum("_n").over(earlier(Window.orderBy("_block"))), F.lit(0)).alias("_upto"))
    inside = ranked.withColumn("_in", F.coalesce(F.sum(n).over(earlier(Window.partitionBy("_block").orderBy(key))), F.lit(0)))
    return inside.join(blocks, "_block").withColumn(name, F.col("_upto") + F.col("_in")).drop("_i", "_block", "_upto", "_in")
