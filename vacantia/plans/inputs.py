"""Postings, sightings, runs, profiles and results derived from the given tables by arithmetic that both engines share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TITLES = ("Financial Data Analyst", "Tax Analyst 2", "Credit Portfolio Officer", "Controller - Analyst", "Analyst, Risk Management", "Technology Risk Analyst", "Data Engineer - Financial Services", "Tele caller - Associate", "Voice Over Artist", "All positions in Financial Operations", "Software Engineer", "Analyst", "Graduate Trainee")
LOCATIONS = ("Bengaluru, India", "Mumbai, India", "Remote - APAC", "London, United Kingdom", "", "Pune, India", "Singapore")
EXPERIENCE = ("0-2 years experience", "up to 24 months of experience", "2+ years of experience", "Minimum 3 years of experience", "1-3 years of relevant experience", "0-2 years in analytics and minimum 4 years in banking", "Freshers may apply", "3-8 years preferred", "2 years preferred", "mid-level finance professional", "")
CATEGORIES = ("Finance", "Technology", "Risk Management", "", "Operations")
DESCRIPTIONS = ("Prepare valuation models and reconciliation reports.", "A leader in the financial services industry.", "Join a friendly team.")


def dealt(table: DataFrame, key: str) -> DataFrame:
    """Rows by key over four tasks a core: texts that are derived from a narrow table are far larger than its file, whose few row groups would make as few tasks."""
    return table.repartition(4 * table.sparkSession.sparkContext.defaultParallelism, key)


def pick(items: tuple[str, ...], index: str) -> str:
    """SQL for items[index]."""
    whens = " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(items))
    return f"(CASE {index} {whens} END)"


_POSTINGS = {
    "posting_id": "o_orderkey",
    "connector_id": "o_orderkey % 6",
    "company": "concat('Company ', CAST(o_custkey % 25 AS VARCHAR(10)))",
    "title": pick(TITLES, "o_orderkey % 13"),
    "location": pick(LOCATIONS, "o_orderkey % 7"),
    "category": pick(CATEGORIES, "o_orderkey % 5"),
    "department": pick(("Analytics", ""), "o_orderkey % 2"),
    "description": pick(DESCRIPTIONS, "o_orderkey % 3"),
    "experience_text": pick(EXPERIENCE, "o_orderkey % 11"),
    "posted_at": "o_orderdate",
    "first_seen_at": "o_orderdate",
    "last_seen_at": "o_orderdate",
    "hydrated_at": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate END",
    "active": "o_orderkey % 9 <> 0",
    "detail_url": "concat('https://jobs.example.com/', CAST(o_custkey % 25 AS VARCHAR(10)), '/', CAST(o_orderkey % 1000 AS VARCHAR(10)), '/?utm_source=x&id=', CAST(o_orderkey % 7 AS VARCHAR(10)), '#top')",
}


def _derive(spark: SparkSession, sf_dir: str, table: str, columns: dict[str, str]) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*[f"{e.replace('VARCHAR(10)', 'STRING')} AS {c}" for c, e in columns.items()])


def _sql(table: str, columns: dict[str, str]) -> str:
    return f"SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {table}"


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, "orders", _POSTINGS)


POSTINGS = _sql("orders", _POSTINGS)

_RUNS = {
    "run_id": "event_id",
    "connector_id": "user_id % 40",
    "run_type": pick(("watch", "reconcile"), "event_id % 2"),
    "status": "CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'partial' WHEN 'signup' THEN 'anomalous' ELSE 'complete' END",
    "finished_at": "ts",
    "reported_total": "event_id % 90",
    "listings_discovered": "event_id % 83",
    "details_due": "event_id % 17",
    "details_fetched": "event_id % 13",
    "apply_urls_resolved": "event_id % 11",
    "backlog": "event_id % 5",
    "error_text": "CASE WHEN event_type IN ('error', 'signup') THEN concat('failure ', CAST(event_id % 7 AS VARCHAR(10))) END",
}


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, "events", _RUNS)


RUNS = _sql("events", _RUNS)

_SIGHTINGS = {"connector_id": "l_suppkey % 20", "listing_id": "l_partkey", "run_no": "CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INTEGER)", "seen_at": "l_shipdate"}


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, "lineitem", _SIGHTINGS)


SIGHTINGS = _sql("lineitem", _SIGHTINGS)

_FIRST, _LAST = ("Ana", "Ben", "Chi", "Dev", "Eva", "Fay", "Gus"), ("Moss", "Reed", "Silva", "Tan", "Ueda")
_NAME = (pick(tuple(x.lower() for x in _FIRST), "c_custkey % 7"), pick(tuple(x.lower() for x in _LAST), "c_custkey % 5"))
_FORMS = ("concat({0}, '.', {1})", "concat({0}, {1})", "concat(substring({0}, 1, 1), {1})", "concat({0}, '_', {1})", "{0}", "concat('x', {1}, '9')")
_OUTREACH = {
    "contact_id": "c_custkey",
    "name": f"concat({pick(_FIRST, 'c_custkey % 7')}, ' ', {pick(_LAST, 'c_custkey % 5')})",
    "email": "concat(CASE c_custkey % 6 " + " ".join(f"WHEN {k} THEN {f.format(*_NAME)}" for k, f in enumerate(_FORMS)) + " END, '@d', CAST(c_nationkey % 9 AS VARCHAR(10)), '.example.com')",
    "result": pick(("delivered", "bounced", "replied"), "c_custkey % 3"),
    "sent_no": "c_custkey",
}


def outreach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, "customer", _OUTREACH)


OUTREACH = _sql("customer", _OUTREACH)
