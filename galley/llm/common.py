"""What the operators of this subpackage share: the shared folder, written tables, bounded Arrow batches, Bloom filters."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch sent to a Python worker; a longer single row makes a batch of its own.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own where none is set, in local mode only."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = f"file://{tempfile.mkdtemp(prefix='galley-')}"
        spark.sparkContext.setCheckpointDir(place)
        place = spark.sparkContext.getCheckpointDir() or place
    return place.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder; what is written there is deleted when the driver's process ends."""
    path = f"{shared_dir(spark)}/galley/{name}-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def delete():
        try:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        except Exception:  # the JVM has ended already
            pass

    atexit.register(delete)
    return path


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """df written as Parquet in the shared folder and read back: its lineage ends there and losing executors loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches are bounded by bytes, since texts differ in length by four orders of magnitude."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Keys that hold this share of the rows are hot: there are 1,000 of them at most.
HOT_SHARE = 1000


def join_hot(rows: DataFrame, dim: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows (stored, or read from a table) joined with dim, which has one row a key: hot keys, HOT_SHARE at most, by a broadcast, the others by a shuffle. Null keys match each other.

    how: inner, or left to keep rows whose key is not in dim.
    """
    _key = fresh_name([*rows.columns, *dim.columns], "_key")
    sizes = rows.groupBy(F.col(key).alias(_key)).agg(F.count("*").alias("_n"))
    hot = sizes.filter(F.col("_n") * HOT_SHARE >= rows.count()).select(_key)
    same, right = F.col(key).eqNullSafe(F.col(_key)), dim.withColumnRenamed(key, _key)
    of_hot = F.broadcast(right.join(F.broadcast(hot.withColumnRenamed(_key, "_hot")), F.col(_key).eqNullSafe(F.col("_hot")), "left_semi"))
    # An inner join with of_hot picks the hot rows itself.
    often = rows.join(of_hot, same) if how == "inner" else rows.join(F.broadcast(hot), same, "left_semi").join(of_hot, same, how)
    seldom = rows.join(F.broadcast(hot), same, "left_anti").join(right, same, how)
    return often.drop(_key).unionByName(seldom.drop(_key))


def fresh_name(taken: list[str], name: str) -> str:
    """A column name that clashes with none of those taken, whatever their case."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name


#: Bits of a Bloom filter, the same for any number of keys: 8 MB.
BLOOM_BITS = 1 << 26


def bloom_filter(hashes: DataFrame, bits: int = BLOOM_BITS) -> np.ndarray:
    """The words of a filter of the 64-bit hashes in the only column of hashes; bits / 64 rows at most reach the driver."""
    h = hashes.toDF("h")
    spots = F.explode(F.array(*[F.expr(f"((h & 4294967295) + {i} * (shiftrightunsigned(h, 32) | 1)) & {bits - 1}") for i in range(4)]))
    word, bit = F.expr("cast(shiftright(spot, 6) AS int)"), F.expr("bit_or(shiftleft(1L, cast(spot & 63 AS int)))")
    rows = h.select(spots.alias("spot")).groupBy(word.alias("word")).agg(bit.alias("bits")).toPandas()
    words = np.zeros(bits >> 6, np.uint64)
    words[rows["word"].to_numpy().astype(np.int64)] = rows["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return words


def in_bloom(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (signed 64 bits) the filter may hold."""
    found, a, b = np.ones(len(hashes), bool), hashes & 0xFFFFFFFF, (hashes >> 32) & 0xFFFFFFFF | 1
    for i in range(4):
        at = (a + i * b) & (len(words) * 64 - 1)
        found &= (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
    return found
