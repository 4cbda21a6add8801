"""Streaming forms of the event queries, run over the events table. Their batch twins have the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.plans import result_queries
from vacantia.plans.result_queries import _TRIES
from vacantia.streaming import events as ev
from vacantia.streaming import state as st
from vacantia.streaming.run import run_available, shared_folder
from vacantia.streaming.store import KeyedStore, Merge, table_store


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def stream_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_available(ev.stream_cooldown(events(spark, sf_dir).select("user_id", "ts", "event_id"), 86400))


def stream_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    tries = events(spark, sf_dir).where("event_type <> 'view'").selectExpr("user_id as job_id", "ts", "event_id as attempt_id", f"{_TRIES} as outcome")
    return run_available(ev.stream_outbox(tries), "update")


def stream_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_available(ev.stream_rate(events(spark, sf_dir), 3600, 600, 2, "user_id"))


def stream_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_available(ev.stream_stale(events(spark, sf_dir).selectExpr("user_id % 40 as connector_id", "ts"), 50))


def stream_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory after all batches: one row for each listing (here: user), its latest event as its metadata."""
    seen = events(spark, sf_dir).selectExpr("user_id as listing_id", "md5(event_type) as metadata_hash", "'queued' as hydration_status", "cast(null as timestamp) as hydrated_at", "ts as first_seen_at", "ts as last_seen_at")
    folder = shared_folder(spark)
    schema = "listing_id long, metadata_hash string, hydration_status string, hydrated_at timestamp, first_seen_at timestamp, last_seen_at timestamp"
    store = KeyedStore(spark, f"{folder}/inventory", schema, ["listing_id"], Merge(("last_seen_at",), ("first_seen_at",), ("last_seen_at",)))
    ev.stream_inventory(seen, store, f"{folder}/state").awaitTermination()
    return store.rows()


def stream_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events over the limit, of the hours that the watermark has closed."""
    return run_available(st.stream_violations(events(spark, sf_dir), 3600, 2, "user_id")).select("event_id", "user_id", "in_window")


def stream_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = events(spark, sf_dir).where("ts <= timestamp'2024-01-20'").selectExpr("user_id as job_id", "ts", "event_id as check_id", "event_type as verdict")
    return st.fresh_at(run_available(st.stream_fresh(checks, 30), "update"), F.expr("timestamp'2024-01-20'"))


def stream_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs as their observations make them, kept up to date by a stream: the store holds each job's newest state."""
    said = "case when event_id % 4 = 0 then '' else concat('title ', event_type, event_id % 97) end"
    obs = events(spark, sf_dir).selectExpr("user_id as job_id", "event_id as obs_id", "event_type in ('click', 'signup') as is_official", "ts as verified_at", f"{said} as title", "case when event_type = 'signup' then concat('place ', event_id % 31) end as location")
    folder = shared_folder(spark)
    store = KeyedStore(spark, f"{folder}/jobs", "job_id long, title string, location string, verified_at timestamp, batch long", ["job_id"], Merge(("batch",)))
    merged = st.merge_observations(obs, "job_id", ("title", "location"))
    merged.writeStream.outputMode("update").foreachBatch(lambda df, n: store.upsert(df.withColumn("batch", F.lit(n).cast("long")), n)).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return store.rows().drop("batch")


def stored_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs as they are told again and again, in three batches and the second twice, in a keyed store: the last word on each."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    told = e.selectExpr("event_id % 3000 as run_id", "concat('c', user_id) as connector_id", "'watch' as run_type", "event_type as status", "user_id as reported_total", "event_id as listings_discovered", "0L as backlog", "cast(null as string) as error_text", "cast(ts as timestamp) as started_at", "cast(ts as timestamp) + make_interval(0, 0, 0, 0, 0, 0, event_id % 7) as finished_at")
    store = table_store(spark, shared_folder(spark), "runs")
    for n, k in enumerate((2, 0, 0, 1)):
        store.upsert(told.where(f"event_id % 3 = {k}"), n)
    return store.rows().select("run_id", "connector_id", "status", "listings_discovered", "started_at", "finished_at")


QUERIES = {f.__name__: f for f in (stream_cooldown, stream_fresh, stream_inventory, stream_observations, stream_outbox, stream_rate, stream_stale, stream_violations, stored_runs)}
_WATERMARK = "(SELECT max(epoch_us(ts)) - 60000000 FROM events)"
ORACLE_SQL: dict[str, str] = {
    "stream_cooldown": result_queries.ORACLE_SQL["cooldown_accepted"],
    "stream_fresh": result_queries.ORACLE_SQL["fresh_status"],
    # One batch holds all rows, so that each job that was tried is sent once, and of each source its last silence.
    "stream_outbox": f"SELECT * FROM ({result_queries.ORACLE_SQL['outbox_final']}) o WHERE job_id IN (SELECT user_id FROM events WHERE event_type <> 'view')",
    "stream_stale": f"SELECT user_id % 40 AS connector_id, max(ts) AS last_run_at FROM events GROUP BY 1 HAVING epoch_us(max(ts)) + 3000000000 <= {_WATERMARK}",
    "stream_inventory": "SELECT user_id AS listing_id, md5(arg_max(event_type, concat(CAST(ts AS VARCHAR), md5(event_type)))) AS metadata_hash, 'queued' AS hydration_status, CAST(NULL AS TIMESTAMP) AS hydrated_at, min(ts) AS first_seen_at, max(ts) AS last_seen_at FROM events GROUP BY user_id",
    "stream_violations": f"SELECT v.event_id, v.user_id, v.in_window FROM ({result_queries.ORACLE_SQL['rate_violations']}) v JOIN events e USING (event_id) WHERE (epoch_us(e.ts) // 3600000000 + 1) * 3600000000 <= {_WATERMARK}",
    "stream_observations": """WITH o AS (SELECT user_id AS job_id, event_id, ts, event_type IN ('click', 'signup') AS official, CASE WHEN event_id % 4 = 0 THEN '' ELSE concat('title ', event_type, event_id % 97) END AS title, CASE WHEN event_type = 'signup' THEN concat('place ', event_id % 31) ELSE '' END AS location, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
 SELECT job_id, coalesce(arg_max(title, n) FILTER (WHERE official AND title <> ''), arg_min(title, n) FILTER (WHERE NOT official AND title <> ''), '') AS title, coalesce(arg_max(location, n) FILTER (WHERE official AND location <> ''), arg_min(location, n) FILTER (WHERE NOT official AND location <> ''), '') AS location, max(ts) FILTER (WHERE official) AS verified_at FROM o GROUP BY job_id""",
    "stored_runs": "WITH t AS (SELECT event_id % 3000 AS run_id, concat('c', user_id) AS connector_id, event_type AS status, event_id AS listings_discovered, ts AS started_at, ts + to_seconds(CAST(event_id % 7 AS INTEGER)) AS finished_at, event_id FROM events), r AS (SELECT *, min(started_at) OVER (PARTITION BY run_id) AS first_at, row_number() OVER (PARTITION BY run_id ORDER BY finished_at DESC, event_id DESC) AS n FROM t) SELECT run_id, connector_id, status, listings_discovered, first_at AS started_at, finished_at FROM r WHERE n = 1",
}
