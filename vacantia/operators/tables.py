"""Intermediate tables in the cluster's shared folder, for work that goes in rounds."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the warehouse where that is unset."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


class Rounds:
    """Tables of one computation, written as Parquet: they cut the lineage, and lost executors cost no recomputation of earlier rounds."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def judged_once(df: DataFrame, inputs: tuple[str, ...], judge: Callable[[DataFrame], DataFrame], most: int = 50_000) -> DataFrame:
    """judge(df), where judge adds columns that depend on the texts `inputs` alone (null as empty): once for each different combination of these, if there are about `most` at most, else row by row.

    Verdicts are found again by two 64-bit hashes of the texts, so that the broadcast holds no texts.
    """
    texts = [F.coalesce(F.col(c), F.lit("")) for c in inputs]
    keys = {"_key": F.xxhash64(*texts), "_other": F.xxhash64(F.lit(1), *texts)}
    if df.select(F.approx_count_distinct(keys["_key"])).first()[0] > most:
        return judge(df)
    judged = judge(df.select(*[t.alias(c) for c, t in zip(inputs, texts, strict=True)]).distinct())
    new = [c for c in judged.columns if c not in inputs]
    verdicts = judged.select(*[k.alias(n) for n, k in keys.items()], *new)
    return df.withColumns(keys).join(F.broadcast(verdicts), list(keys)).select(*df.columns, *new)
