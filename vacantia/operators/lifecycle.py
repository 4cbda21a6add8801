"""Snapshots over time: carrying state, misses, closure, backlog, queues of sightings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def apply_snapshot(prev: DataFrame, snap: DataFrame, keys: list[str], hash_col: str = "metadata_hash") -> DataFrame:
    """Rows of the new snapshot with hydration_status and hydrated_at: kept where the hash is unchanged, queued and emptied where it changed or is new.

    prev: keys, hash, hydration_status, hydrated_at. first_seen comes from prev where it has the key.
    """
    old = prev.select(*keys, F.col(hash_col).alias("_hash"), F.col("hydration_status").alias("_status"), F.col("hydrated_at").alias("_at"), F.col("first_seen_at").alias("_first"))
    same = F.col(hash_col).eqNullSafe(F.col("_hash")) & F.col("_status").isNotNull()
    joined = snap.join(old, keys, "left")
    return joined.withColumns({"hydration_status": F.when(same, F.col("_status")).otherwise("queued"), "hydrated_at": F.when(same, F.col("_at")), "first_seen_at": F.coalesce("_first", "first_seen_at")}).drop("_hash", "_status", "_at", "_first")


def deactivate_missing(prev: DataFrame, snap: DataFrame, keys: list[str], source: str, complete: DataFrame) -> DataFrame:
    """prev with active false for rows of a source with a complete snapshot (`complete` lists them) that the snapshot lacks."""
    seen = snap.select(*keys).distinct().withColumn("_seen", F.lit(True))
    done = complete.select(source).distinct().withColumn("_done", F.lit(True))
    gone = F.col("_done").isNotNull() & F.col("_seen").isNull()
    return prev.join(seen, keys, "left").join(done, source, "left").withColumn("active", F.when(gone, False).otherwise(F.col("active"))).drop("_seen", "_done")


def miss_counts(sightings: DataFrame, runs: DataFrame, source: str = "connector_id", listing: str = "listing_id", run: str = "run_no", limit: int = 2) -> DataFrame:
    """For each listing the complete reconcile runs since its last sighting (`limit` at most) and whether it is still active.

    runs: source, run, complete. Sightings in any run reset; only complete runs count as misses. Runs may be of any number: each different last run of a source is placed among the source's
    complete runs once, and listings take the count of their last run.
    """
    done = runs.where("complete").select(source, run).distinct()
    last = sightings.groupBy(source, listing).agg(F.max(run).alias("last_run"))
    asked = last.select(source, "last_run").distinct()
    # Points of runs come after the question at the same place, so that they are not among those after it.
    points = asked.select(source, F.col("last_run").alias("_at"), F.lit(0).alias("_ran")).unionByName(done.select(source, F.col(run).alias("_at"), F.lit(1).alias("_ran")))
    upto = F.sum("_ran").over(Window.partitionBy(source).orderBy("_at", F.desc("_ran")))
    after = points.select(source, F.col("_at").alias("last_run"), (F.sum("_ran").over(Window.partitionBy(source)) - upto).alias("_after"), "_ran").where("_ran = 0").drop("_ran")
    missed = F.least("_after", F.lit(limit)).cast("int")
    return last.join(after, [source, "last_run"]).select(source, listing, "last_run", missed.alias("misses")).withColumn("active", F.col("misses") < limit)


def complete_connectors(runs: DataFrame, run_id: Column | None = None) -> DataFrame:
    """Connectors (connector_id) that a complete reconcile run allows to close listings: that of the run asked for, or their last reconcile run. runs: run_id, connector_id, run_type, status, finished_at."""
    reconciled = runs.where("run_type = 'reconcile'")
    if run_id is not None:
        return reconciled.where((F.col("run_id") == run_id) & (F.col("status") == "complete")).select("connector_id").distinct()
    last = reconciled.groupBy("connector_id").agg(F.max_by("status", F.struct("finished_at", "run_id")).alias("status"))
    return last.where("status = 'complete'").select("connector_id")


def reconcile_lifecycle(sources: DataFrame, inventory: DataFrame, jobs: DataFrame, connector: Column | str | DataFrame, now: Column) -> DataFrame:
    """jobs with closed_at after complete runs: sources inherit the inventory's state; a job that a connector with such a run shows closes without any active source, and any job with one reopens.

    connector: one that has had a complete run, or a table of them (complete_connectors); others change nothing. A source without a row in the inventory stays as it is.
    sources: job_id, connector_id, listing_id, active. inventory: connector_id, listing_id, active. jobs: job_id, closed_at.
    """
    state = inventory.select("connector_id", "listing_id", F.col("active").alias("_now"))
    if isinstance(connector, DataFrame):
        marked = sources.join(connector.select("connector_id").distinct().withColumn("_ran", F.lit(True)), "connector_id", "left").withColumn("_ran", F.coalesce("_ran", F.lit(False)))
    else:
        marked = sources.withColumn("_ran", F.col("connector_id") == (F.lit(connector) if isinstance(connector, str) else connector))
    own = marked.join(state, ["connector_id", "listing_id"], "left").withColumn("active", F.when(F.col("_ran"), F.coalesce("_now", "active")).otherwise(F.col("active")))
    by_job = own.groupBy("job_id").agg(F.bool_or("active").alias("_open"), F.bool_or("_ran").alias("_shown"))
    closed = F.when(F.col("_open"), F.lit(None).cast("timestamp")).when(F.coalesce("_shown", F.lit(False)), F.coalesce("closed_at", now)).otherwise(F.col("closed_at"))
    return jobs.join(by_job, "job_id", "left").withColumn("closed_at", closed).drop("_open", "_shown")


def backlog(inventory: DataFrame) -> DataFrame:
    return inventory.where("active").groupBy("connector_id", "hydration_status").agg(F.count("*").alias("n"))


def retain_last(df: DataFrame, keys: list[str], n: int, order: list[Column]) -> DataFrame:
    """The last n rows of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
