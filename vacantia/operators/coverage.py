"""Completeness and freshness of sources, from run rows.

Run columns: run_id, connector_id, run_type (watch, reconcile, hydrate), status, finished_at, counts, error_text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.functions.names import company_key
from vacantia.functions.wordlists import HEALTH

#: How far the details of a source's postings are, best first.
HYDRATION = ("complete", "backlog", "degraded")


def reconcile_snapshot(pages: DataFrame, listings: DataFrame, policy: DataFrame) -> DataFrame:
    """Status of each snapshot: distinct listings against the advertised total, pages fetched against expected.

    pages: connector_id, page_no, expected_pages, advertised_total, ok. listings: connector_id, listing_id. policy: connector_id, check_total, empty_is_anomalous.
    """
    got = pages.groupBy("connector_id").agg(F.count_if("ok").alias("pages_fetched"), F.max("expected_pages").alias("pages_expected"), F.max("advertised_total").alias("reported_total"))
    found = listings.groupBy("connector_id").agg(F.count_distinct("listing_id").alias("listings_discovered"))
    x = got.join(found, "connector_id", "left").join(policy, "connector_id", "left").fillna(0, ["listings_discovered"]).fillna(True, ["check_total", "empty_is_anomalous"])
    reasons = F.array_compact(F.array(
        F.when(F.expr("pages_fetched = 0"), "no_pages"),
        F.when(F.expr("pages_fetched < pages_expected"), "missing_pages"),
        F.when(F.expr("check_total and listings_discovered <> reported_total"), "total_mismatch"),
        F.when(F.expr("empty_is_anomalous and listings_discovered = 0"), "empty"),
    ))
    status = F.when(F.expr("pages_fetched = 0"), "failed").when(F.expr("empty_is_anomalous and listings_discovered = 0"), "anomalous").when(F.size(reasons) > 0, "partial").otherwise("complete")
    return x.select("connector_id", "pages_fetched", "pages_expected", "reported_total", "listings_discovered", status.alias("status"), reasons.alias("reasons"))


def run_summary(runs: DataFrame) -> DataFrame:
    """Totals of all runs: sources checked, jobs found, errors, unsupported."""
    return runs.agg(F.count_distinct("connector_id").alias("sources_checked"), F.coalesce(F.sum("listings_discovered"), F.lit(0)).alias("jobs_found"), F.count_if(F.col("status") == "failed").alias("errors"), F.count_if(F.col("status") == "unsupported").alias("unsupported"))


def run_diagnostic(selected: DataFrame, due: DataFrame, fetched: DataFrame, created: DataFrame) -> DataFrame:
    """Counts of each stage's rows by run_id; hydration is complete when nothing that was due is left."""
    count = lambda df, name: df.groupBy("run_id").agg(F.count("*").alias(name))
    urls = fetched.groupBy("run_id").agg(F.count("*").alias("details_fetched"), F.count_if(F.coalesce("apply_url", F.lit("")) != "").alias("apply_urls_resolved"))
    x = count(selected, "candidates_selected").join(count(due, "details_due"), "run_id", "left").join(urls, "run_id", "left").join(count(created, "jobs_created"), "run_id", "left").fillna(0)
    left = F.greatest(F.col("details_due") - F.col("details_fetched"), F.lit(0))
    return x.withColumn("details_backlogged", left).withColumn("hydration_status", F.when(left == 0, "complete").otherwise("partial"))


def coverage(runs: DataFrame) -> DataFrame:
    """One row for each connector: its latest run, latest complete watch and reconcile, progress, and the first bad run's errors."""
    order = F.struct("finished_at", "run_id")
    latest = lambda c, test=None: F.max_by(c, order if test is None else F.when(test, order))
    done = lambda kind: (F.col("run_type") == kind) & (F.col("status") == "complete")
    bad = (F.col("status") != "complete") & F.col("error_text").isNotNull()
    return runs.groupBy("connector_id").agg(
        latest("status").alias("latest_status"),
        F.max(F.when(done("watch"), F.col("finished_at"))).alias("last_complete_watch_at"),
        F.max(F.when(done("reconcile"), F.col("finished_at"))).alias("last_complete_reconcile_at"),
        latest("reported_total").alias("reported_total"),
        latest("listings_discovered").alias("listings_discovered"),
        latest("backlog").alias("candidate_backlog"),
        latest("status", F.col("run_type") == "watch").alias("watch_status"),
        latest("status", F.col("run_type") == "reconcile").alias("reconcile_status"),
        latest(F.greatest(F.col("details_fetched") - F.col("apply_urls_resolved"), F.lit(0)), F.col("run_type") == "reconcile").alias("unresolved_apply_urls"),
        F.substring(latest("error_text", bad), 1, 500).alias("anomaly_summary"),
    )


def coverage_with_registry(runs: DataFrame, registry: DataFrame) -> DataFrame:
    """Every registered source, with its coverage or not_checked."""
    return registry.join(coverage(runs), "connector_id", "left").withColumn("latest_status", F.coalesce("latest_status", F.lit("not_checked")))


def audit_coverage(cov: DataFrame, noisy: DataFrame | None = None) -> DataFrame:
    """(severity, connector_id, finding): bad status, nothing stored, under 80 % stored, backlog; noisy: connector_id of feed rows with noise titles."""
    stored, total = F.col("listings_discovered"), F.col("reported_total")
    tests = (("error", ~F.col("latest_status").isin("complete", "partial"), "bad_status"), ("error", (stored == 0) & (total > 0), "nothing_stored"), ("warning", (stored > 0) & (stored < 0.8 * total), "under_stored"), ("warning", F.col("candidate_backlog") > 0, "backlog"))
    found = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(severity).alias("severity"), F.lit(name).alias("finding"))) for severity, test, name in tests]))
    out = cov.select("connector_id", F.explode(found).alias("x")).select("x.severity", "connector_id", "x.finding")
    return out if noisy is None else out.union(noisy.select(F.lit("warning"), "connector_id", F.lit("noise_in_feed")).distinct())


def freshness_failures(cov: DataFrame, now: Column, hours: int = 6) -> DataFrame:
    """(connector_id, finding): latest run not complete, degraded, no complete reconcile within the hours, unresolved apply URLs."""
    late = F.col("last_complete_reconcile_at").isNull() | (F.col("last_complete_reconcile_at") < now - F.make_dt_interval(hours=F.lit(hours)))
    tests = ((F.col("latest_status") != "complete", "not_complete"), (F.col("latest_status").isin("failed", "anomalous"), "degraded"), (late, "stale_reconcile"), (F.coalesce("unresolved_apply_urls", F.lit(0)) > 0, "unresolved_apply_urls"))
    return cov.select("connector_id", F.explode(F.array_compact(F.array(*[F.when(t, F.lit(n)) for t, n in tests]))).alias("finding"))


def worst(status: Column) -> Column:
    """Aggregate: the worst health of a group."""
    rank = F.coalesce(F.create_map(*[x for k, s in enumerate(HEALTH) for x in (F.lit(s), F.lit(k))])[status], F.lit(4))
    return F.max_by(status, rank)


def job_health(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """For each job the worst status and newest run of its connectors, its newest verification, and one light."""
    by = runs.groupBy("connector_id").agg(worst(F.col("status")).alias("health"), F.max("finished_at").alias("snapshot_at"))
    x = sources.join(by, "connector_id", "left").groupBy("job_id").agg(worst(F.col("health")).alias("health"), F.max("snapshot_at").alias("snapshot_at"), F.max("verified_at").alias("newest_verification_at")).fillna("unknown", ["health"])
    return x.withColumn("light", F.when(F.col("health") == "complete", "green").when(F.col("health").isin("partial", "unknown"), "amber").otherwise("red"))


def rank_sources(sources: DataFrame) -> DataFrame:
    """Adds source_rank: official first, then newest verified."""
    return sources.withColumn("source_rank", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("is_official"), F.desc_nulls_last("verified_at"), "source_id")))


def presented_health(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """For each job (of any of its sources): watch_fresh_at and reconcile_fresh_at, the newest complete runs of its connectors, its worst health, and newest_verified_at of its active sources."""
    complete = lambda kind: F.max(F.when((F.col("run_type") == kind) & (F.col("status") == "complete"), F.col("finished_at")))
    by = runs.groupBy("connector_id").agg(worst(F.col("status")).alias("_health"), complete("watch").alias("_watch"), complete("reconcile").alias("_reconcile"))
    verified = F.max(F.when(F.col("active"), F.col("verified_at"))).alias("newest_verified_at")
    of_job = sources.groupBy("job_id", "connector_id").agg(verified)
    x = of_job.join(by, "connector_id", "left").groupBy("job_id")
    return x.agg(F.max("_watch").alias("watch_fresh_at"), F.max("_reconcile").alias("reconcile_fresh_at"), worst(F.col("_health")).alias("health"), F.max("newest_verified_at").alias("newest_verified_at")).fillna("unknown", ["health"])


def snapshot_at(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: the newest time among the runs of the connectors that sources show, and the sources' verifications."""
    ran = runs.join(sources.where("active").select("connector_id").distinct(), "connector_id", "left_semi").select(F.col("finished_at").alias("at"))
    return ran.unionByName(sources.where("active").select(F.col("verified_at").alias("at"))).agg(F.max("at").alias("snapshot_at"))


def present_jobs(jobs: DataFrame, sources: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Classified jobs with their active sources (an array in rank order), evidence labels and a year range; with runs, also presented_health (sources then have connector_id)."""
    ranked = rank_sources(sources.where("active"))
    nested = ranked.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("source_rank", "source_id", "is_official", "verified_at", "apply_url"))).alias("sources"))
    number = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")
    years = F.when(F.expr("minimum_years is not null and maximum_years is not null"), F.concat(number("minimum_years"), F.lit("-"), number("maximum_years"), F.lit(" years"))).when(F.col("maximum_years").isNotNull(), F.concat(F.lit("Up to "), number("maximum_years"), F.lit(" years"))).otherwise("Entry-level experience wording")
    labels = F.array_compact(F.array(F.when(F.col("location_status") == "india", "India location"), F.when(F.col("domain_status") == "exact", "Finance relevance confirmed").when(F.col("domain_status") == "likely", "Finance relevance likely"), F.when(F.col("experience_status") == "zero_to_two", years).when(F.col("experience_status") == "ambiguous", "Experience requirement unclear")))
    shown = jobs.join(nested, "job_id", "left").withColumns({"evidence": F.slice(labels, 1, 3), "sources": F.coalesce("sources", F.array())})
    return shown if runs is None else shown.join(presented_health(sources, runs), "job_id", "left").fillna("unknown", ["health"])


def company_directory(catalog: DataFrame, roles: DataFrame, cov: DataFrame) -> DataFrame:
    """Catalog companies with their roles and best source: by status, then hydration, then id. Spellings of a company are one (company_key).

    catalog: name, segment; roles: company; cov: company, connector_id, latest_status, latest_hydration_status (complete, backlog, degraded).
    """
    order = lambda names, c: F.coalesce(F.create_map(*[x for k, s in enumerate(names) for x in (F.lit(s), F.lit(k))])[F.col(c)], F.lit(9))
    rank = F.struct(order(HEALTH, "latest_status"), order(HYDRATION, "latest_hydration_status"), "connector_id")
    count = roles.groupBy(company_key(F.col("company")).alias("_key")).agg(F.count("*").alias("roles"))
    best = cov.groupBy(company_key(F.col("company")).alias("_key")).agg(F.min_by(F.struct("connector_id", "latest_status"), rank).alias("_best"))
    named = catalog.withColumn("_key", company_key(F.col("name")))
    return named.join(count, "_key", "left").join(best, "_key", "left").select("name", "segment", F.coalesce("roles", F.lit(0).cast("long")).alias("roles"), F.col("_best.connector_id").alias("best_connector"), F.coalesce("_best.latest_status", F.lit("not_checked")).alias("best_status"))


def segment_counts(directory: DataFrame) -> DataFrame:
    return directory.groupBy("segment").agg(F.count("*").alias("companies"), F.count_if(F.col("roles") > 0).alias("with_roles"))


def coverage_without_roles(cov: DataFrame, feed: DataFrame) -> DataFrame:
    """Covered companies that have no role in the feed."""
    return cov.where("latest_status = 'complete'").select("company").distinct().join(feed.select("company").distinct(), "company", "left_anti")
