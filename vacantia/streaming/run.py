"""Running a stream over what is there, into a table in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from vacantia.operators.tables import shared_base


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or the warehouse where that is unset."""
    return f"{shared_base(spark)}/stream-{uuid.uuid4().hex}"


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start within keep their state in RocksDB, which transformWithState needs; the session's own setting comes back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All rows that the stream emits for the input that is there now."""
    spark = stream.sparkSession
    path = shared_folder(spark)

    def batch(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/out/batch={n}")

    with state_in_rocksdb(spark):  # a query takes the session's settings when it starts
        query = stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out/*")
