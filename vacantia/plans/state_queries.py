"""Queries on snapshots, lifecycle, linking and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.operators import coverage as cov
from vacantia.operators import lifecycle as life
from vacantia.operators import linking as link
from vacantia.plans.inputs import POSTINGS, RUNS, SIGHTINGS, postings, runs, sightings

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_PREV = f"SELECT posting_id, md5(title) AS metadata_hash, CASE WHEN posting_id % 3 = 0 THEN 'hydrated' ELSE 'queued' END AS hydration_status, hydrated_at, first_seen_at FROM ({POSTINGS}) p WHERE posting_id % 5 <> 0"
_NOW = f"SELECT posting_id, CASE WHEN posting_id % 4 = 1 THEN md5(location) ELSE md5(title) END AS metadata_hash, first_seen_at + INTERVAL 1 DAY AS first_seen_at FROM ({POSTINGS}) p WHERE posting_id % 7 <> 0"


@query(f"SELECT n.posting_id, CASE WHEN n.metadata_hash = p.metadata_hash THEN p.hydration_status ELSE 'queued' END AS hydration_status, CASE WHEN n.metadata_hash = p.metadata_hash THEN p.hydrated_at END AS hydrated_at, coalesce(p.first_seen_at, n.first_seen_at) AS first_seen_at FROM ({_NOW}) n LEFT JOIN ({_PREV}) p USING (posting_id)")
def snapshot_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = postings(spark, sf_dir)
    prev = p.where("posting_id % 5 <> 0").selectExpr("posting_id", "md5(title) metadata_hash", "case when posting_id % 3 = 0 then 'hydrated' else 'queued' end hydration_status", "hydrated_at", "first_seen_at")
    now = p.where("posting_id % 7 <> 0").selectExpr("posting_id", "case when posting_id % 4 = 1 then md5(location) else md5(title) end metadata_hash", "first_seen_at + interval 1 day first_seen_at")
    return life.apply_snapshot(prev, now, ["posting_id"]).select("posting_id", "hydration_status", "hydrated_at", "first_seen_at")


_COMPLETE = "(run_no + connector_id) % 3 <> 0"


@query(f"WITH s AS ({SIGHTINGS}), r AS (SELECT DISTINCT connector_id, run_no FROM s WHERE {_COMPLETE}), l AS (SELECT connector_id, listing_id, max(run_no) AS last_run FROM s GROUP BY ALL) SELECT l.connector_id, listing_id, last_run, CAST(least(count(r.run_no), 2) AS INTEGER) AS misses, count(r.run_no) < 2 AS active FROM l LEFT JOIN r ON r.connector_id = l.connector_id AND r.run_no > l.last_run GROUP BY ALL")
def miss_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sightings(spark, sf_dir)
    return life.miss_counts(s, s.select("connector_id", "run_no").distinct().withColumn("complete", F.expr(_COMPLETE)))


@query(f"WITH s AS (SELECT DISTINCT connector_id, listing_id, listing_id % 500 AS job_id, (listing_id + connector_id) % 4 <> 0 AS active FROM ({SIGHTINGS}) x), o AS (SELECT job_id, bool_or(CASE WHEN connector_id = 3 THEN listing_id % 2 = 0 ELSE active END) AS open, bool_or(connector_id = 3) AS shown FROM s GROUP BY job_id) SELECT job_id, CASE WHEN open THEN NULL WHEN shown THEN coalesce(CASE WHEN job_id % 5 = 0 THEN TIMESTAMP '2020-01-01' END, TIMESTAMP '2026-08-01') ELSE CASE WHEN job_id % 5 = 0 THEN TIMESTAMP '2020-01-01' END END AS closed_at FROM o")
def lifecycle_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sightings(spark, sf_dir).selectExpr("connector_id", "listing_id", "listing_id % 500 as job_id", "(listing_id + connector_id) % 4 <> 0 as active").distinct()
    inventory = s.select("connector_id", "listing_id", F.expr("listing_id % 2 = 0").alias("active")).distinct()
    jobs = s.selectExpr("job_id", "case when job_id % 5 = 0 then timestamp'2020-01-01' end as closed_at").distinct()
    return life.reconcile_lifecycle(s, inventory, jobs, F.lit(3), F.expr("timestamp'2026-08-01'")).select("job_id", "closed_at")


# Inventories of two thirds of the listings; connectors whose last reconcile run wasn't complete close nothing.
@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY connector_id ORDER BY finished_at DESC, run_id DESC) AS n FROM ({RUNS}) x WHERE run_type = 'reconcile'), c AS (SELECT connector_id FROM r WHERE n = 1 AND status = 'complete'),
 s AS (SELECT DISTINCT connector_id, listing_id, listing_id % 500 AS job_id, (listing_id + connector_id) % 9 = 0 AS active FROM ({SIGHTINGS}) x),
 o AS (SELECT job_id, bool_or(CASE WHEN c.connector_id IS NOT NULL AND listing_id % 3 <> 0 THEN listing_id % 17 = 1 ELSE active END) AS open, bool_or(c.connector_id IS NOT NULL) AS shown FROM s LEFT JOIN c USING (connector_id) GROUP BY job_id)
 SELECT job_id, CASE WHEN open THEN NULL WHEN shown THEN TIMESTAMP '2026-08-01' END AS closed_at FROM o""")
def lifecycle_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sightings(spark, sf_dir).selectExpr("connector_id", "listing_id", "listing_id % 500 as job_id", "(listing_id + connector_id) % 9 = 0 as active").distinct()
    inventory = s.where("listing_id % 3 <> 0").select("connector_id", "listing_id", F.expr("listing_id % 17 = 1").alias("active")).distinct()
    jobs = s.selectExpr("job_id", "cast(null as timestamp) as closed_at").distinct()
    return life.reconcile_lifecycle(s, inventory, jobs, life.complete_connectors(runs(spark, sf_dir)), F.expr("timestamp'2026-08-01'")).select("job_id", "closed_at")


@query(f"SELECT connector_id, CASE WHEN posting_id % 3 = 0 THEN 'hydrated' ELSE 'queued' END AS hydration_status, count(*) AS n FROM ({POSTINGS}) p WHERE active GROUP BY ALL")
def backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return life.backlog(postings(spark, sf_dir).withColumn("hydration_status", F.expr("case when posting_id % 3 = 0 then 'hydrated' else 'queued' end")))


@query(f"WITH c AS (SELECT DISTINCT connector_id FROM ({SIGHTINGS}) x WHERE connector_id % 2 = 0), p AS (SELECT DISTINCT connector_id, listing_id FROM ({SIGHTINGS}) x), n AS (SELECT DISTINCT connector_id, listing_id FROM ({SIGHTINGS}) x WHERE run_no % 4 = 0) SELECT p.connector_id, p.listing_id, NOT (c.connector_id IS NOT NULL AND n.listing_id IS NULL) AS active FROM p LEFT JOIN c USING (connector_id) LEFT JOIN n ON n.connector_id = p.connector_id AND n.listing_id = p.listing_id")
def deactivated(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sightings(spark, sf_dir)
    prev = s.select("connector_id", "listing_id").distinct().withColumn("active", F.lit(True))
    return life.deactivate_missing(prev, s.where("run_no % 4 = 0"), ["connector_id", "listing_id"], "connector_id", s.where("connector_id % 2 = 0").select("connector_id")).select("connector_id", "listing_id", "active")


_URL = "concat('https://jobs.example.com/', CAST({c} AS VARCHAR), '/', CAST({o} % 1000 AS VARCHAR), '?id=', CAST({o} % 7 AS VARCHAR))"
_OBS = f"SELECT posting_id AS obs_id, company, CASE WHEN posting_id % 3 = 0 THEN concat('E', CAST(posting_id % 800 AS VARCHAR)) END AS employer_job_id, title, location, posted_at, lower(regexp_replace(replace(detail_url, '/?utm_source=x&', '?'), '#top', '')) AS url FROM ({POSTINGS}) p WHERE posting_id % 2 = 0"
_JOBS = f"SELECT posting_id AS job_id, company, CASE WHEN posting_id % 4 = 3 THEN concat('E', CAST((posting_id + 1) % 800 AS VARCHAR)) END AS employer_job_id, title, location, posted_at, lower(regexp_replace(replace(detail_url, '/?utm_source=x&', '?'), '#top', '')) AS url FROM ({POSTINGS}) p WHERE posting_id % 2 = 1"
_LINK = f"""WITH o AS ({_OBS}), j AS ({_JOBS}), u AS (SELECT obs_id, bool_or(o.employer_job_id IS NOT NULL AND j.employer_job_id IS NOT NULL AND o.employer_job_id <> j.employer_job_id) AS clash, count(DISTINCT job_id) AS n, min(job_id) AS job FROM o JOIN j ON o.company = j.company AND o.url = j.url GROUP BY obs_id),
 i AS (SELECT obs_id, min(job_id) AS job FROM o JOIN j ON o.company = j.company AND o.employer_job_id = j.employer_job_id GROUP BY obs_id),
 f AS (SELECT obs_id, count(*) AS n, min(job_id) AS job FROM o JOIN j ON o.company = j.company AND o.title = j.title AND o.location = j.location AND CAST(o.posted_at AS DATE) = CAST(j.posted_at AS DATE) GROUP BY obs_id)
 SELECT o.obs_id, CASE WHEN clash THEN 'conflict' WHEN i.job IS NOT NULL THEN 'linked' WHEN u.n = 1 THEN 'linked' WHEN u.n > 1 THEN 'conflict' WHEN f.n = 1 THEN 'linked' WHEN f.n > 1 THEN 'conflict' ELSE 'pending' END AS link_status,
 CASE WHEN clash THEN NULL WHEN i.job IS NOT NULL THEN i.job WHEN u.n = 1 THEN u.job WHEN u.n > 1 THEN NULL WHEN f.n = 1 THEN f.job END AS job_id,
 CASE WHEN clash THEN NULL WHEN i.job IS NOT NULL THEN 'employer_job_id' WHEN u.n = 1 THEN 'official_url' WHEN u.n > 1 THEN NULL WHEN f.n = 1 THEN 'fingerprint' END AS matched_by
 FROM o LEFT JOIN u USING (obs_id) LEFT JOIN i USING (obs_id) LEFT JOIN f USING (obs_id)"""


def _linkable(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = postings(spark, sf_dir)
    fields = ["company", "title", "location", "posted_at", "detail_url", "'' as apply_url"]
    obs = p.where("posting_id % 2 = 0").selectExpr("posting_id as obs_id", "case when posting_id % 3 = 0 then concat('E', posting_id % 800) end as employer_job_id", *fields)
    jobs = p.where("posting_id % 2 = 1").selectExpr("posting_id as job_id", "case when posting_id % 4 = 3 then concat('E', (posting_id + 1) % 800) end as employer_job_id", *fields)
    return obs, jobs


@query(_LINK)
def linked_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link.link_observations(*_linkable(spark, sf_dir)).select("obs_id", "link_status", "job_id", "matched_by")


_J3 = f"SELECT posting_id AS job_id, title, CASE WHEN posting_id % 3 = 0 THEN '' ELSE location END AS location, description, category, posted_at AS verified_at FROM ({POSTINGS}) p"
_O3 = f"SELECT posting_id AS job_id, posting_id % 2 = 0 AS is_official, posted_at + CASE WHEN posting_id % 5 = 0 THEN INTERVAL (-1) DAY ELSE INTERVAL 1 DAY END AS told_at, concat('New ', title) AS title, 'Pune, India' AS location, '' AS description, 'Finance' AS category FROM ({POSTINGS}) p WHERE posting_id % 7 <> 0"


def _merged(c: str) -> str:
    return f"CASE WHEN is_official IS NULL THEN j.{c} WHEN is_official AND told_at >= verified_at THEN coalesce(nullif(o.{c}, ''), j.{c}) ELSE coalesce(nullif(j.{c}, ''), o.{c}) END AS {c}"


@query(f"SELECT job_id, {', '.join(map(_merged, ('title', 'location', 'description', 'category')))}, CASE WHEN is_official AND told_at >= verified_at THEN told_at ELSE verified_at END AS verified_at FROM ({_J3}) j LEFT JOIN ({_O3}) o USING (job_id)")
def merged_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = postings(spark, sf_dir)
    jobs = p.selectExpr("posting_id as job_id", "title", "case when posting_id % 3 = 0 then '' else location end as location", "description", "category", "posted_at as verified_at")
    obs = p.where("posting_id % 7 <> 0").selectExpr("posting_id as job_id", "posting_id % 2 = 0 as is_official", "posted_at + case when posting_id % 5 = 0 then interval '-1' day else interval '1' day end as verified_at", "concat('New ', title) as title", "'Pune, India' as location", "'' as description", "'Finance' as category")
    return link.merge_canonical(jobs, obs)


@query(f"WITH r AS ({_OBS}), j AS ({_JOBS}), b AS (SELECT company, url, min(job_id) AS job_id FROM j GROUP BY ALL), k AS (SELECT b.*, p.title FROM b JOIN j p USING (job_id)) SELECT obs_id AS role_id, k.job_id, r.company, r.title FROM r LEFT JOIN k ON r.company = k.company AND r.url = k.url UNION ALL SELECT NULL, k.job_id, k.company, k.title FROM k WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.company = k.company AND r.url = k.url)")
def feed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs, jobs = _linkable(spark, sf_dir)
    return link.merge_feed(obs.withColumnRenamed("obs_id", "role_id"), jobs).select("role_id", "job_id", "company", "title")


_FIRST = lambda c, test="true": f"arg_max({c}, rn) FILTER (WHERE {test})"
_COV = f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY finished_at, run_id) AS rn FROM ({RUNS}) x), c AS (SELECT connector_id, {_FIRST('status')} AS latest_status, max(finished_at) FILTER (WHERE run_type = 'watch' AND status = 'complete') AS last_complete_watch_at, max(finished_at) FILTER (WHERE run_type = 'reconcile' AND status = 'complete') AS last_complete_reconcile_at,
 {_FIRST('reported_total')} AS reported_total, {_FIRST('listings_discovered')} AS listings_discovered, {_FIRST('backlog')} AS candidate_backlog, {_FIRST('status', "run_type = 'watch'")} AS watch_status, {_FIRST('status', "run_type = 'reconcile'")} AS reconcile_status, {_FIRST('greatest(details_fetched - apply_urls_resolved, 0)', "run_type = 'reconcile'")} AS unresolved_apply_urls, {_FIRST('error_text', "status <> 'complete' AND error_text IS NOT NULL")} AS anomaly_summary FROM r GROUP BY connector_id)"""


@query(_COV + " SELECT * FROM c")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.coverage(runs(spark, sf_dir))


@query(_COV + ", g AS (SELECT DISTINCT s_suppkey % 60 AS connector_id FROM supplier) SELECT g.connector_id, coalesce(latest_status, 'not_checked') AS latest_status, last_complete_reconcile_at, candidate_backlog FROM g LEFT JOIN c USING (connector_id)")
def coverage_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey % 60 as connector_id").distinct()
    return cov.coverage_with_registry(runs(spark, sf_dir), registry).select("connector_id", "latest_status", "last_complete_reconcile_at", "candidate_backlog")


@query(_COV + " SELECT 'error' AS severity, connector_id, 'bad_status' AS finding FROM c WHERE latest_status NOT IN ('complete', 'partial') UNION ALL SELECT 'error', connector_id, 'nothing_stored' FROM c WHERE listings_discovered = 0 AND reported_total > 0 UNION ALL SELECT 'warning', connector_id, 'under_stored' FROM c WHERE listings_discovered > 0 AND listings_discovered < 0.8 * reported_total UNION ALL SELECT 'warning', connector_id, 'backlog' FROM c WHERE candidate_backlog > 0")
def audit_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.audit_coverage(cov.coverage(runs(spark, sf_dir)))


_WHEN = "TIMESTAMP '2024-01-30 00:00:00'"


@query(_COV + f" SELECT connector_id, 'not_complete' AS finding FROM c WHERE latest_status <> 'complete' UNION ALL SELECT connector_id, 'degraded' FROM c WHERE latest_status IN ('failed', 'anomalous') UNION ALL SELECT connector_id, 'stale_reconcile' FROM c WHERE last_complete_reconcile_at IS NULL OR last_complete_reconcile_at < {_WHEN} - INTERVAL 6 HOUR UNION ALL SELECT connector_id, 'unresolved_apply_urls' FROM c WHERE unresolved_apply_urls > 0")
def freshness_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.freshness_failures(cov.coverage(runs(spark, sf_dir)), F.expr(_WHEN))


@query(f"SELECT count(DISTINCT connector_id) AS sources_checked, CAST(sum(listings_discovered) AS BIGINT) AS jobs_found, count(*) FILTER (WHERE status = 'failed') AS errors, count(*) FILTER (WHERE status = 'unsupported') AS unsupported FROM ({RUNS}) r")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.run_summary(runs(spark, sf_dir))


_RANK = "CASE status WHEN 'complete' THEN 0 WHEN 'partial' THEN 1 WHEN 'unsupported' THEN 2 WHEN 'anomalous' THEN 3 ELSE 4 END"


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sightings(spark, sf_dir).selectExpr("listing_id % 700 as job_id", "connector_id * 2 as connector_id", "concat(listing_id, '-', connector_id, '-', run_no) as source_id", "listing_id % 3 = 0 as is_official", "seen_at as verified_at")


@query(f"WITH b AS (SELECT connector_id, max({_RANK}) AS h, max(finished_at) AS done_at FROM ({RUNS}) r GROUP BY ALL), s AS (SELECT listing_id % 700 AS job_id, connector_id * 2 AS connector_id, seen_at FROM ({SIGHTINGS}) x), j AS (SELECT job_id, max(h) AS h, max(done_at) AS snapshot_at, max(seen_at) AS newest_verification_at FROM s LEFT JOIN b USING (connector_id) GROUP BY job_id) SELECT job_id, CASE h WHEN 0 THEN 'complete' WHEN 1 THEN 'partial' WHEN 2 THEN 'unsupported' WHEN 3 THEN 'anomalous' WHEN 4 THEN 'failed' ELSE 'unknown' END AS health, snapshot_at, newest_verification_at, CASE WHEN h = 0 THEN 'green' WHEN h IS NULL OR h = 1 THEN 'amber' ELSE 'red' END AS light FROM j")
def job_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.job_health(_sources(spark, sf_dir), runs(spark, sf_dir))


@query(f"SELECT listing_id % 700 AS job_id, concat(CAST(listing_id AS VARCHAR), '-', CAST(connector_id AS VARCHAR), '-', CAST(run_no AS VARCHAR)) AS source_id, CAST(row_number() OVER (PARTITION BY listing_id % 700 ORDER BY listing_id % 3 = 0 DESC, seen_at DESC, concat(CAST(listing_id AS VARCHAR), '-', CAST(connector_id AS VARCHAR), '-', CAST(run_no AS VARCHAR))) AS INTEGER) AS source_rank FROM ({SIGHTINGS}) x")
def source_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.rank_sources(_sources(spark, sf_dir)).select("job_id", "source_id", "source_rank")


@query(f"WITH s AS ({SIGHTINGS}), g AS (SELECT connector_id, count(DISTINCT run_no) AS pages_fetched, max(run_no) - min(run_no) + 1 AS pages_expected, max(listing_id) AS reported_total, count(DISTINCT listing_id) AS listings_discovered FROM s GROUP BY ALL) SELECT connector_id, listings_discovered, CASE WHEN pages_fetched < pages_expected OR (connector_id % 2 = 0 AND listings_discovered <> reported_total) THEN 'partial' ELSE 'complete' END AS status FROM g")
def snapshot_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sightings(spark, sf_dir)
    span = s.groupBy("connector_id").agg((F.max("run_no") - F.min("run_no") + 1).alias("expected_pages"), F.max("listing_id").alias("advertised_total"))
    pages = s.select("connector_id", F.col("run_no").alias("page_no")).distinct().join(span, "connector_id").withColumn("ok", F.lit(True))
    policy = s.select("connector_id").distinct().selectExpr("connector_id", "connector_id % 2 = 0 as check_total", "true as empty_is_anomalous")
    return cov.reconcile_snapshot(pages, s, policy).select("connector_id", "listings_discovered", "status")


_HYDRATION = "CASE WHEN candidate_backlog = 0 THEN 'complete' WHEN candidate_backlog < 3 THEN 'backlog' ELSE 'degraded' END"
_NAME = "CASE n_nationkey WHEN 0 THEN 'JPMorgan Chase' WHEN 1 THEN 'PwC SDC' ELSE concat('COMPANY-', CAST(n_nationkey + 5 AS VARCHAR(10))) END"
_EMPLOYER = "CASE {k} WHEN 0 THEN 'J.P. Morgan' WHEN 1 THEN 'pwc' ELSE concat('Company ', CAST({k} AS VARCHAR(10))) END"
_SAME = "CASE WHEN regexp_replace(lower({v}), '[^a-z0-9]', '', 'g') = 'jpmorganchase' THEN 'jpmorgan' WHEN regexp_replace(lower({v}), '[^a-z0-9]', '', 'g') = 'pwcsdc' THEN 'pwc' ELSE regexp_replace(lower({v}), '[^a-z0-9]', '', 'g') END"
_CATALOG = f"SELECT {_NAME} AS name, CASE n_regionkey WHEN 0 THEN 'Banks' WHEN 1 THEN 'Ratings' ELSE 'Other' END AS segment FROM nation"
_DIRECTORY = _COV + f", k AS ({_CATALOG}), o AS (SELECT company, count(*) AS roles FROM (SELECT {_SAME.format(v=_EMPLOYER.format(k='(posting_id % 25)'))} AS company FROM ({POSTINGS}) y WHERE active) p GROUP BY ALL), z AS (SELECT {_SAME.format(v=_EMPLOYER.format(k='(connector_id % 20)'))} AS company, connector_id, latest_status, row_number() OVER (PARTITION BY connector_id % 20 ORDER BY CASE latest_status WHEN 'complete' THEN 0 WHEN 'partial' THEN 1 WHEN 'unsupported' THEN 2 WHEN 'anomalous' THEN 3 WHEN 'failed' THEN 4 ELSE 9 END, {_HYDRATION}, connector_id) AS n FROM c), d AS (SELECT name, segment, coalesce(roles, 0) AS roles, z.connector_id AS best_connector, coalesce(z.latest_status, 'not_checked') AS best_status FROM k LEFT JOIN o ON o.company = {_SAME.format(v='name')} LEFT JOIN z ON z.company = {_SAME.format(v='name')} AND n = 1)"


def _directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = lambda e: e.replace("VARCHAR(10)", "STRING")
    catalog = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr(f"{said(_NAME)} as name", "case n_regionkey when 0 then 'Banks' when 1 then 'Ratings' else 'Other' end as segment")
    roles = postings(spark, sf_dir).where("active").selectExpr(f"{said(_EMPLOYER.format(k='(posting_id % 25)'))} as company")
    sources = cov.coverage(runs(spark, sf_dir)).selectExpr("*", f"{said(_EMPLOYER.format(k='(connector_id % 20)'))} as company", f"{_HYDRATION} as latest_hydration_status")
    return cov.company_directory(catalog, roles, sources)


@query(_DIRECTORY + " SELECT * FROM d")
def company_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _directory(spark, sf_dir)


@query(_DIRECTORY + " SELECT segment, count(*) AS companies, count(*) FILTER (WHERE roles > 0) AS with_roles FROM d GROUP BY segment")
def segment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.segment_counts(_directory(spark, sf_dir))


@query(_COV + f" SELECT DISTINCT concat('Company ', CAST(connector_id AS VARCHAR)) AS company FROM c WHERE latest_status = 'complete' AND concat('Company ', CAST(connector_id AS VARCHAR)) NOT IN (SELECT company FROM ({POSTINGS}) p)")
def coverage_without_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.coverage_without_roles(cov.coverage(runs(spark, sf_dir)).withColumn("company", F.expr("concat('Company ', connector_id)")), postings(spark, sf_dir))


_HOSTS = "SELECT company, detail_url, CASE WHEN k IS NOT NULL THEN concat('c', CAST(k AS VARCHAR), '.example.org') WHEN posting_id % 3 = 0 THEN NULL ELSE 'jobs.example.com' END AS employer_domain, posting_id FROM"


@query(f"{_HOSTS} ({POSTINGS}) p LEFT JOIN (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 10) n ON company = concat('Company ', CAST(k AS VARCHAR))".replace("SELECT company, detail_url, ", "SELECT "))
def employer_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_nationkey < 10").selectExpr("concat('Company ', n_nationkey) as name", "concat('https://www.c', n_nationkey, '.example.org/careers') as url")
    jobs = postings(spark, sf_dir).withColumn("detail_url", F.expr("case when posting_id % 3 = 0 then 'https://in.linkedin.com/jobs/1' else detail_url end"))
    return link.employer_domain(jobs, catalog).select("posting_id", "employer_domain")


@query(f"WITH s AS (SELECT listing_id % 700 AS job_id, connector_id, listing_id, run_no, listing_id % 3 = 0 AS official, seen_at FROM ({SIGHTINGS}) x WHERE run_no % 2 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY official DESC, seen_at DESC, concat(CAST(listing_id AS VARCHAR), '-', CAST(connector_id AS VARCHAR), '-', CAST(run_no AS VARCHAR))) AS n FROM s), f AS (SELECT job_id, concat(CAST(listing_id AS VARCHAR), '-', CAST(connector_id AS VARCHAR), '-', CAST(run_no AS VARCHAR)) AS first_source FROM r WHERE n = 1), c AS (SELECT job_id, count(*) AS n_sources FROM s GROUP BY ALL) SELECT j.job_id, coalesce(n_sources, 0) AS n_sources, first_source, 'India location,Finance relevance confirmed,' || CASE WHEN j.job_id % 2 = 0 THEN '0-2 years' ELSE 'Up to 1.5 years' END AS evidence FROM (SELECT DISTINCT listing_id % 700 AS job_id FROM ({SIGHTINGS}) z) j LEFT JOIN f USING (job_id) LEFT JOIN c USING (job_id)")
def presented_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = sightings(spark, sf_dir).selectExpr("listing_id % 700 as job_id", "concat(listing_id, '-', connector_id, '-', run_no) as source_id", "listing_id % 3 = 0 as is_official", "seen_at as verified_at", "'' as apply_url", "run_no % 2 = 0 as active")
    jobs = sources.selectExpr("job_id", "'india' as location_status", "'exact' as domain_status", "'zero_to_two' as experience_status", "case when job_id % 2 = 0 then 0.0D end as minimum_years", "case when job_id % 2 = 0 then 2.0D else 1.5D end as maximum_years").distinct()
    return cov.present_jobs(jobs, sources).select("job_id", F.size("sources").cast("long").alias("n_sources"), F.try_element_at("sources", F.lit(1))["source_id"].alias("first_source"), F.array_join("evidence", ",").alias("evidence"))


_WORST = "CASE max(CASE status WHEN 'failed' THEN 4 WHEN 'anomalous' THEN 3 WHEN 'partial' THEN 2 WHEN 'complete' THEN 1 ELSE 0 END) WHEN 4 THEN 'failed' WHEN 3 THEN 'anomalous' WHEN 2 THEN 'partial' WHEN 1 THEN 'complete' ELSE 'unknown' END"


@query(f"""WITH s AS (SELECT listing_id % 700 AS job_id, connector_id * 2 + listing_id % 2 AS connector_id, run_no % 2 = 0 AS active, seen_at FROM ({SIGHTINGS}) x), j AS (SELECT DISTINCT job_id, connector_id FROM s), v AS (SELECT job_id, max(seen_at) FILTER (WHERE active) AS newest_verified_at FROM s GROUP BY job_id),
 h AS (SELECT job_id, max(finished_at) FILTER (WHERE run_type = 'watch' AND status = 'complete') AS watch_fresh_at, max(finished_at) FILTER (WHERE run_type = 'reconcile' AND status = 'complete') AS reconcile_fresh_at, {_WORST} AS health FROM j LEFT JOIN ({RUNS}) r USING (connector_id) GROUP BY job_id)
 SELECT * FROM h JOIN v USING (job_id)""")
def presented_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = sightings(spark, sf_dir).selectExpr("listing_id % 700 as job_id", "connector_id * 2 + listing_id % 2 as connector_id", "seen_at as verified_at", "run_no % 2 = 0 as active")
    return cov.presented_health(sources, runs(spark, sf_dir))


@query(f"WITH RECURSIVE o AS ({_OBS}), k AS (SELECT obs_id, concat(company, 'i', employer_job_id) AS key FROM o WHERE employer_job_id IS NOT NULL UNION ALL SELECT obs_id, concat(company, 'u', url) FROM o UNION ALL SELECT obs_id, concat(company, 'f', title, '|', location, '|', CAST(CAST(posted_at AS DATE) AS VARCHAR)) FROM o), h AS (SELECT obs_id AS a, min(obs_id) OVER (PARTITION BY key) AS b FROM k), e AS (SELECT DISTINCT a, b FROM h WHERE a <> b UNION SELECT DISTINCT b, a FROM h WHERE a <> b), r AS (SELECT obs_id, obs_id AS m FROM o UNION SELECT r.obs_id, e.b FROM r JOIN e ON e.a = r.m) SELECT obs_id, min(m) AS new_job FROM r GROUP BY obs_id")
def new_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link.group_pending(_linkable(spark, sf_dir)[0])
