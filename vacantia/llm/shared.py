"""Intermediate tables in the cluster's shared folder, and filters of a fixed size."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of an Arrow batch where the session leaves Spark's default: documents are long, and a batch is held by the JVM and by Python.
BATCH_ROWS = 1000


def modest_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts to a few MB, unless the session sets their size."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


#: Least and most bits of a filter, as powers of 2: 32 MB at most.
FILTER_BITS = (18, 28)


class Scratch:
    """Tables of one run, written as Parquet under the checkpoint folder so that lost executors cost no recomputation.

    The folder is spark.checkpoint.dir, or the warehouse where that is unset: both are shared by driver and executors.
    """

    def __init__(self, spark: SparkSession):
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
        modest_batches(spark)
        self.spark, self.path = spark, f"{base.rstrip('/')}/stage-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


    def release(self) -> None:
        """Let the driver find out which shuffles nothing refers to any more, so that executors delete their files now and not at its next collection."""
        self.spark._jvm.System.gc()


def own_names(df: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, each with as many underscores in front as it takes to differ from df's columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return tuple(out)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """rows with the columns of their group: a left join on `key` (nulls are a group too), where one group may hold a large part of all rows.

    groups: one row for each key, with its number of rows in `size`. Groups of a hundredth of all rows or more, of which there are a hundred at most, are
    broadcast; all others are joined by a shuffle, in which each key has less than a hundredth.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    (other,) = own_names(rows, f"{key}_of")
    named = groups.withColumnRenamed(key, other)
    hot = named.where(F.col(size) * 100 >= total)
    hot = rows.sparkSession.createDataFrame(hot.collect(), hot.schema)
    (is_hot,) = own_names(rows, "is_hot")
    marked = rows.join(F.broadcast(hot.withColumn(is_hot, F.lit(True))), F.col(key).eqNullSafe(F.col(other)), "left")
    joined = marked.where(F.col(is_hot)).drop(other, is_hot)
    rest = marked.where(F.col(is_hot).isNull()).select(*rows.columns)
    rest = rest.join(named.where(F.col(size) * 100 < total), F.col(key).eqNullSafe(F.col(other)), "left").drop(other)
    return joined.unionByName(rest.select(*joined.columns))


def bit_filter(df: DataFrame, key: Column, bits: int | None = None) -> np.ndarray:
    """Bitmap of 2**bits bits over the keys' low bits, by default 8 to 16 for each row of df within FILTER_BITS.

    It passes all keys of df and, the more of it is set, others too: what it passes still has to be joined.
    """
    if bits is None:
        bits = min(max((8 * df.count()).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    low = key.bitwiseAND(F.lit((1 << bits) - 1))
    rows = df.select(F.shiftright(low, 6).alias("slot"), F.expr("1L").alias("one"), low.bitwiseAND(F.lit(63)).cast("int").alias("bit")).groupBy("slot").agg(F.expr("bit_or(shiftleft(one, bit))").alias("word")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[rows["slot"].to_numpy()] = rows["word"].to_numpy().view(np.uint64)
    return words


def passes(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which 64-bit keys a bit_filter lets through."""
    low = keys.astype(np.uint64) & np.uint64(len(words) * 64 - 1)
    return (words[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) != 0
