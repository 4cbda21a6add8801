import glob
import os
from datetime import timedelta

from pyspark.sql import functions as F

import __spark_entry__ as entry
from vacantia.streaming import events as ev


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_name_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.oracle_sql()) > 40


def test_streams_equal_their_batch_twins(spark):
    q, sf = entry.queries(), "/root/testdata/sf0.001"
    rows = lambda name, *cols: sorted(map(tuple, q[name](spark, sf).select(*cols).collect()))
    assert rows("stream_cooldown", "user_id", "event_id") == rows("cooldown_accepted", "user_id", "event_id")
    tried = {r[0] for r in rows("stream_outbox", "job_id")}
    assert rows("stream_outbox", "job_id", "status", "attempts") == [r for r in rows("outbox_final", "job_id", "status", "attempts") if r[0] in tried]


def test_other_streams_equal_batch_forms(spark):
    q, sf = entry.queries(), "/root/testdata/sf0.001"
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    newest = e.agg(F.max("ts")).first()[0]
    seen = newest - timedelta(minutes=1)
    # A window is sent when the watermark has passed its end.
    batch = ev.stream_rate(e, 3600, 600, 2, "user_id").where(F.col("start") + F.expr("interval 1 hour") <= F.lit(seen))
    assert sorted(map(tuple, q["stream_rate"](spark, sf).collect())) == sorted(map(tuple, batch.collect())) != []
    # One batch holds all runs, so only each source's last silence is left.
    last = e.groupBy((F.col("user_id") % 40).alias("connector_id")).agg(F.max("ts").alias("last_run_at")).where(F.col("last_run_at") + F.expr("interval 50 minutes") <= F.lit(seen))
    assert sorted(map(tuple, q["stream_stale"](spark, sf).collect())) == sorted(map(tuple, last.collect())) != []
    latest = e.groupBy("user_id").agg(F.max("ts").alias("last_seen_at"), F.min("ts").alias("first_seen_at"))
    got = q["stream_inventory"](spark, sf)
    assert sorted(r.listing_id for r in got.collect()) == sorted(r.user_id for r in latest.collect())
    assert sorted((r.listing_id, r.last_seen_at) for r in got.collect()) == sorted((r.user_id, r.last_seen_at) for r in latest.collect())


def test_no_llm_import_outside():
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for path in glob.glob(f"{here}/vacantia/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert "vacantia.llm" not in open(path).read()
