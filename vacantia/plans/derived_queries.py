"""Queries on inputs that are derived from the given tables: boards, structured data, feeds by score, details, letters of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.functions import urls
from vacantia.functions import wordlists as w
from vacantia.operators import classify as c
from vacantia.operators import contacts as ct
from vacantia.operators import coverage as cov
from vacantia.operators import matching as mt
from vacantia.plans import result_queries as rq
from vacantia.plans.inputs import POSTINGS, postings
from vacantia.plans.page_queries import _TITLE, pages
from vacantia.plans.postings_queries import _CLASSIFIED, _FEED, _NOISE, m
from vacantia.sources import extract as x
from vacantia.streaming import events as ev

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_FEED_ROWS = f"({_CLASSIFIED}{_FEED} SELECT * FROM f)"


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.job_feed(c.classify_postings(postings(spark, sf_dir)))


@query(f"WITH fd AS {_FEED_ROWS}, sc AS (SELECT posting_id, max(score) AS score FROM ({rq._SCORES} SELECT * FROM k) z GROUP BY 1) SELECT posting_id, score, CAST(row_number() OVER (ORDER BY score DESC NULLS LAST, posted_at DESC NULLS LAST, company, posting_id) AS INTEGER) AS score_rank FROM fd LEFT JOIN sc USING (posting_id)")
def feed_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = rq._scored(spark, sf_dir).groupBy("posting_id").agg(F.max("score").alias("score"))
    return c.by_score(feed(spark, sf_dir), best).select("posting_id", "score", "score_rank")


@query(f"""SELECT 'role' AS origin, CAST(posting_id AS VARCHAR) AS item, title, company FROM {_FEED_ROWS} r
 UNION ALL SELECT 'portal', md5(concat_ws('|', 'portal', detail_url)), title, company FROM ({POSTINGS}) p WHERE {m('location', w.INDIA)} AND NOT {_NOISE} AND {m('title', w.DOMAIN_METADATA)}
 UNION ALL SELECT 'imported', CAST(page_id AS VARCHAR), {_TITLE}, NULL FROM pages""")
def whole_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = feed(spark, sf_dir).selectExpr("cast(posting_id as string) as item", "title", "company")
    portal = ct.filter_portal(postings(spark, sf_dir)).selectExpr("portal_id as item", "title", "company")
    imported = x.extract_page_records(pages(spark, sf_dir)).selectExpr("cast(page_id as string) as item", "title")
    return c.whole_feed(roles, portal, imported).select("origin", "item", "title", "company")


# Boards: a page for each connector and hundred of listings; connectors 0 to 2 answer in JSON, 3 to 5 in HTML.
_PAGE = "cast(posting_id div 100 as int)"
_HOME = f"(location = '' OR {m('location', w.INDIA)})"


def json_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = "named_struct('id', cast(posting_id as string), 'name', title, 'at', nullif(location, ''), 'meta', named_struct('group', category, 'url', detail_url))"
    rows = postings(spark, sf_dir).where("connector_id < 3").selectExpr("connector_id", f"{_PAGE} as page_no", f"{item} as item")
    good = rows.groupBy("connector_id", "page_no").agg(F.to_json(F.struct(F.struct(F.collect_list("item").alias("jobs")).alias("data"))).alias("body"))
    broken = good.select("connector_id", (F.col("page_no") + 1_000_000).alias("page_no"), F.expr("substring(body, 1, length(body) - 3)").alias("body"))
    return good.unionByName(broken).withColumn("connector_id", F.col("connector_id").cast("string"))


_JSON_PATHS = {"items": "$.data.jobs", "source_external_id": "$.id", "title": "$.name", "location": "$.at", "category": "$.meta.group", "detail_url": "$.meta.url"}


@query(f"SELECT CAST(connector_id AS VARCHAR) AS connector_id, CAST(posting_id AS VARCHAR) AS source_external_id, title, nullif(location, '') AS location, detail_url FROM ({POSTINGS}) p WHERE connector_id < 3 AND {_HOME}")
def json_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.extract_json_listings(json_boards(spark, sf_dir), {str(k): _JSON_PATHS for k in range(3)}).select("connector_id", "source_external_id", "title", "location", "detail_url")


def html_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = "concat('<li class=\"job\" data-id=\"', posting_id, '\"><a href=\"', detail_url, '\"><b>', replace(title, '&', '&amp;'), '</b></a> <i>', location, '</i></li>')"
    rows = postings(spark, sf_dir).where("connector_id >= 3").selectExpr("cast(connector_id as string) as connector_id", f"{_PAGE} as page_no", f"{card} as card")
    return rows.groupBy("connector_id", "page_no").agg(F.concat(F.lit("<html><ul>"), F.array_join(F.collect_list("card"), "\n"), F.lit("</ul></html>")).alias("body"))


_CARD = {"card": r"(?s)<li class=\"job\".*?</li>", "source_external_id": r'data-id=\"([^\"]+)\"', "title": r"<b>(.*?)</b>", "location": r"<i>(.*?)</i>", "detail_url": r'href=\"([^\"]+)\"'}


@query(f"SELECT CAST(connector_id AS VARCHAR) AS connector_id, CAST(posting_id AS VARCHAR) AS source_external_id, title, nullif(location, '') AS location, detail_url FROM ({POSTINGS}) p WHERE connector_id >= 3")
def html_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = {"start": "<li class=\"job\"", **{k: v for k, v in _CARD.items() if k != "card"}}
    return x.extract_html_listings(html_boards(spark, sf_dir), {"3": _CARD, "4": starts, "5": _CARD}).select("connector_id", "source_external_id", "title", "location", "detail_url")


@query(f"SELECT posting_id, title FROM ({POSTINGS}) p WHERE posting_id % 4 < 3")
def jsonld_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings as structured data in pages: plain, in an array, in a graph of arrays of graphs; every fourth block is broken."""
    node = "to_json(named_struct('@type', 'JobPosting', 'title', title, 'id', posting_id))"
    other = '{"@type":"Organization","name":"x"}'
    block = f"case posting_id % 4 when 0 then {node} when 1 then concat('[{other},', {node}, ']') when 2 then concat('{{\"@graph\":[[{{\"@graph\":[[', {node}, ']]}}],{other}]}}') else concat('{{', {node}) end"
    source = postings(spark, sf_dir).selectExpr("posting_id", f"concat('<html><script type=\"application/ld+json\">', {block}, '</script></html>') as html")
    return x.extract_jsonld(source).select("posting_id", F.get_json_object("node", "$.title").alias("title"))


_LINKS = "concat(text, chr(10), CASE doc_id % 4 WHEN 0 THEN concat('- [Analyst ', CAST(doc_id AS VARCHAR(20)), '](https://x.example/', CAST(doc_id AS VARCHAR(20)), ') Pune') WHEN 1 THEN concat('[Clerk](https://x.example/c', CAST(doc_id AS VARCHAR(20)), ')', chr(10), 'Mumbai office') WHEN 2 THEN '[Home](https://x.example/) Delhi' ELSE '[Analyst](https://x.example/) Oslo' END)"


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat('Analyst ', CAST(doc_id AS VARCHAR)) ELSE 'Clerk' END AS title, concat('https://x.example/', CASE doc_id % 4 WHEN 1 THEN 'c' ELSE '' END, CAST(doc_id AS VARCHAR)) AS link, CASE doc_id % 4 WHEN 0 THEN 'Pune' ELSE 'Mumbai' END AS place FROM documents WHERE doc_id % 4 < 2")
def markdown_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.expr(_LINKS.replace("VARCHAR(20)", "STRING")).alias("text"))
    return x.extract_markdown_links(docs)


@query(f"SELECT posting_id, CASE WHEN title = 'Analyst' OR description LIKE 'Join%' THEN 'rejected' ELSE 'observed' END AS verdict, CASE WHEN title = 'Analyst' AND description LIKE 'Join%' THEN 'title,description' WHEN title = 'Analyst' THEN 'title' WHEN description LIKE 'Join%' THEN 'description' ELSE '' END AS missing FROM ({POSTINGS}) p")
def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = postings(spark, sf_dir)
    listings = p.selectExpr("connector_id", "posting_id as source_external_id", "nullif(title, 'Analyst') as title", "detail_url")
    details = p.where("description not like 'Join%'").selectExpr("connector_id", "posting_id as source_external_id", "description", "cast(null as string) as apply_url")
    good, bad = x.build_observations(listings, details)
    rows = good.select("source_external_id", F.lit("observed").alias("verdict"), F.lit("").alias("missing")).unionByName(bad.select("source_external_id", F.lit("rejected").alias("verdict"), F.array_join("missing", ",").alias("missing")))
    return rows.withColumnRenamed("source_external_id", "posting_id")


@query(f"SELECT posting_id, CASE posting_id % 3 WHEN 0 THEN detail_url WHEN 1 THEN concat('https://apply.example.com/', CAST(posting_id AS VARCHAR)) END AS apply_url FROM ({POSTINGS}) p")
def apply_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    offered = F.expr("case posting_id % 3 when 0 then 'https://a.example.com/careers/' when 1 then concat('https://apply.example.com/', posting_id) else '' end")
    return postings(spark, sf_dir).select("posting_id", urls.pick_apply_url(offered, F.expr("case posting_id % 3 when 0 then detail_url else 'https://a.example.com/jobs' end")).alias("apply_url"))


@query("SELECT event_id % 500 AS run_id, count(*) AS candidates_selected, count(*) FILTER (WHERE event_id % 3 > 0) AS details_due, count(*) FILTER (WHERE event_id % 3 > 0 AND event_id % 7 > 0) AS details_fetched, count(*) FILTER (WHERE event_id % 3 > 0 AND event_id % 7 > 2) AS apply_urls_resolved, count(*) FILTER (WHERE event_id % 11 = 0) AS jobs_created, count(*) FILTER (WHERE event_id % 3 > 0 AND event_id % 7 = 0) AS details_backlogged, CASE WHEN count(*) FILTER (WHERE event_id % 3 > 0 AND event_id % 7 = 0) = 0 THEN 'complete' ELSE 'partial' END AS hydration_status FROM events GROUP BY 1")
def run_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id % 500 as run_id", "event_id", "case when event_id % 7 > 2 then 'u' else '' end as apply_url")
    return cov.run_diagnostic(e, e.where("event_id % 3 > 0"), e.where("event_id % 3 > 0 and event_id % 7 > 0"), e.where("event_id % 11 = 0"))


@query(f"WITH o AS ({rq.ORACLE_SQL['outbox_final'].replace("<> 'view'", "<> 'view' AND ts < TIMESTAMP '2024-01-03'")}), j AS (SELECT user_id AS job_id, min(ts) AS enqueued_at FROM events WHERE ts < TIMESTAMP '2024-01-03' GROUP BY 1) SELECT job_id FROM o JOIN j USING (job_id) WHERE status = 'pending' ORDER BY enqueued_at, job_id LIMIT 10")
def outbox_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What waits as of the third day: jobs and attempts until then."""
    e = rq._events(spark, sf_dir).where("ts < timestamp'2024-01-03'")
    attempts = e.where("event_type <> 'view'").selectExpr("user_id as job_id", "ts", "event_id as attempt_id", f"{rq._TRIES} as outcome")
    return ev.drain(ev.outbox_final(e.selectExpr("user_id as job_id", "ts as at"), attempts)).select("job_id")


@query("WITH w AS (SELECT event_id, epoch_us(ts) AS us FROM events) SELECT event_id, n AS in_window FROM (SELECT event_id, count(*) OVER (ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS n FROM w) z WHERE n > 16")
def rate_violations_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.rate_violations(rq._events(spark, sf_dir), 3600, 16).select("event_id", "in_window")


@query(f"SELECT profile_id, pos FROM (SELECT profile_id, string_split(text, chr(10)) AS l, CAST(unnest(generate_series(0, 6)) AS INTEGER) AS pos FROM ({rq.PROFILES}) p) z WHERE NOT (pos = 4 AND profile_id % 2 = 0 AND l[4] <> l[5])")
def tailored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers, skills and proven lines of each profile; the last line of experience is proven in every second."""
    lines = mt.profile_lines(rq.profiles(spark, sf_dir))
    return mt.tailor_profile(lines, lines.where("pos = 3 or profile_id % 2 = 1 and pos = 4").select("profile_id", "line_id"))[0].select("profile_id", "pos")
