"""Queries on pages and documents: text, links, platforms, records, liveness, lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.operators import matching as mt
from vacantia.sources import extract as x

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


_TEXT = r"regexp_replace(regexp_replace({h}, '(?is)<script\b.*?</script>|<style\b.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')"
for _e, _s in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _TEXT = f"replace({_TEXT}, '{_e}', '{_s}')"
_TEXT = rf"trim(regexp_replace({_TEXT}, '\s+', ' ', 'g'))"


@query(f"SELECT page_id, length(substring(t, 1, 20000)) AS n_chars, md5(substring(t, 1, 20000)) AS text_md5 FROM (SELECT page_id, {_TEXT.format(h='html')} AS t FROM pages) p")
def page_text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.pages_to_text(pages(spark, sf_dir)).select("page_id", F.length("page_text").cast("long").alias("n_chars"), F.md5("page_text").alias("text_md5"))


@query(r"""WITH s AS (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u FROM pages), k AS (SELECT page_id, regexp_replace(regexp_replace(u, '\?.*$', ''), '/+$', '') AS path, list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(split_part(p, '=', 1), '(?i)^(?:utm_|source$|src$|ref$|trk$)')) AS q FROM s)
 SELECT page_id, lower(concat(path, CASE WHEN regexp_matches(path, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]+$') THEN '/' ELSE '' END, CASE WHEN len(q) > 0 THEN concat('?', array_to_string(q, '&')) ELSE '' END)) AS canonical_url FROM k""")
def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.canonical_pages(pages(spark, sf_dir)).select("page_id", "canonical_url")


@query("""WITH l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref="([^"#]+)"', 1)) AS link FROM pages) SELECT page_id, link, 'anchor' AS method FROM l""")
def links_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.discover_links(pages(spark, sf_dir)).where("method = 'anchor'")


_PLATFORM = "CASE " + " ".join(f"WHEN contains(lower(concat_ws(' ', html, url)), '{w}') THEN '{n}'" for w, n in x.PLATFORMS) + " ELSE 'Unknown' END"


@query(f"SELECT {_PLATFORM} AS platform, count(*) AS n FROM pages GROUP BY 1")
def platform_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.detect_platform(pages(spark, sf_dir)).groupBy("platform").agg(F.count("*").alias("n"))


_TITLE = r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
for _e, _s in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _TITLE = f"replace({_TITLE}, '{_e}', '{_s}')"
_TITLE = rf"trim(regexp_replace({_TITLE}, '\s+', ' ', 'g'))"

# Every fourth page each: structured data, meta tags, only a title, only an address.
_LD = """concat('<script type="application/ld+json">{"@graph":[{"@type":"JobPosting","title":"Role ', CAST(page_id AS VARCHAR(20)), '","hiringOrganization":{"name":"77-12 Acme Bank of the West Private Limited"},"jobLocation":{"address":{"addressLocality":"', CASE WHEN page_id % 8 = 0 THEN '111442-IND-PUNE-BLK B3' ELSE 'Oslo,, IN' END, '"}},"datePosted":"2024-05-01"}]}</script>', html)"""
_TAGS = """concat('<meta property="og:title" content="Meta &amp; ', CAST(page_id AS VARCHAR(20)), '"><meta name="description" content="About it"><meta property="og:site_name" content="Globex International Holding"><meta name="location" content="Delhi NCR">', html)"""
_VARIED = f"CASE page_id % 4 WHEN 0 THEN {_LD} WHEN 1 THEN {_TAGS} WHEN 2 THEN concat('<title>Credit Analyst | Acme Careers</title>', html) ELSE '<p>nothing</p>' END"
_HOST = r"regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\.', '')"


@query(rf"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS u, {_HOST} AS host FROM pages),
 c AS (SELECT *, regexp_extract(u, '[^/]/+([^/]+)$', 1) AS leaf, list_filter(string_split(host, '.'), lambda x: length(x) > 2 AND x NOT IN ('www', 'com', 'jobs'))[1] AS label, regexp_extract(u, '^[a-z]+://[^/]*/+([^/]+)', 1) AS seg FROM p),
 e AS (SELECT *, list_filter([CASE page_id % 4 WHEN 0 THEN 'Acme Bank of the West' WHEN 1 THEN 'Globex International' END, CASE WHEN length(seg) > 2 THEN replace(seg, '-', ' ') END, replace(label, '-', ' ')], lambda v: v IS NOT NULL AND length(v) >= 3) AS names FROM c)
 SELECT page_id, CASE page_id % 4 WHEN 0 THEN concat('Role ', CAST(page_id AS VARCHAR)) WHEN 1 THEN concat('Meta & ', CAST(page_id AS VARCHAR)) WHEN 2 THEN 'Credit Analyst' ELSE coalesce(nullif(trim(regexp_replace(regexp_replace(replace(leaf, '-', ' '), '\.html?$', ' '), '\b[0-9]{{3,}}\b', '')), ''), 'Role listing') END AS title,
 list_filter(names, lambda v: length(v) = list_max(list_transform(names, lambda y: length(y))))[1] AS company, CASE page_id % 4 WHEN 0 THEN CASE WHEN page_id % 8 = 0 THEN 'Pune, India' ELSE 'Oslo,' END WHEN 1 THEN 'Delhi, India' ELSE '' END AS location,
 CASE WHEN page_id % 4 = 0 THEN DATE '2024-05-01' END AS posted_at, CASE page_id % 4 WHEN 0 THEN 'jsonld' WHEN 1 THEN 'meta' WHEN 2 THEN 'title' ELSE 'url' END AS source, CASE page_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, host FROM e""")
def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    varied = pages(spark, sf_dir).withColumn("html", F.expr(_VARIED.replace("VARCHAR(20)", "STRING")))
    return x.extract_page_records(varied)


_CODE = "CASE page_id % 5 WHEN 0 THEN 404 WHEN 1 THEN 500 ELSE 200 END"


@query(f"""WITH t AS (SELECT page_id, {_CODE} AS code, {_TEXT.format(h='substring(html, 1, 150000)')} AS t, regexp_extract(substring(html, 1, 150000), '(?i)<title[^>]*>([^<]*)</title>', 1) AS title, url FROM pages) SELECT page_id, CASE WHEN code = 404 THEN 'closed' WHEN code <> 200 THEN 'unknown' WHEN page_id % 7 = 0 THEN 'open' WHEN regexp_matches(concat(title, ' ', substring(t, 1, 2500)), '{x.CLOSED}') THEN 'closed' WHEN length(t) < 200 OR regexp_matches(url, '(?i)/(?:careers|jobs|work-with-us|search|index[.]html)/?$') THEN 'unknown' ELSE 'open' END AS verdict FROM t""")
def liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    crawl = pages(spark, sf_dir).selectExpr("page_id", f"{_CODE} as http_status", "url as final_url", "html as body", "case when page_id % 7 = 0 then 'application/json' else 'text/html' end as content_type")
    return x.posting_liveness(crawl).select("page_id", "verdict")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.profile_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")


_NORMAL = r"trim(regexp_replace(lower({v}), '[^a-z0-9+#.&%/-]+', ' ', 'g'))"
_LINES = rf"SELECT doc_id, line FROM (SELECT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '[ \t]+', ' ', 'g')) AS line FROM documents) l WHERE line <> ''"


@query(f"WITH l AS ({_LINES}), k AS (SELECT DISTINCT md5({_NORMAL.format(v='line')}) AS line_id, doc_id FROM l), n AS (SELECT line_id, count(*) AS docs FROM k GROUP BY ALL) SELECT * FROM n WHERE docs > 1")
def shared_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.shared_lines(_lines(spark, sf_dir), "doc_id").withColumnRenamed("profiles", "docs")


@query(f"WITH l AS ({_LINES}), b AS (SELECT DISTINCT {_NORMAL.format(v='line')} AS n FROM (SELECT trim(regexp_replace(unnest(string_split(text, chr(10))), '[ \\t]+', ' ', 'g')) AS line FROM benchmark) z WHERE line <> '') SELECT doc_id, count(*) AS unverified FROM l WHERE {_NORMAL.format(v='line')} NOT IN (SELECT n FROM b) GROUP BY doc_id")
def claims_unverified(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = mt.profile_lines(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text")
    return mt.verify_claims(_lines(spark, sf_dir), source).groupBy("doc_id").agg(F.count("*").alias("unverified"))


@query(f"WITH l AS ({_LINES}), k AS (SELECT DISTINCT doc_id, md5({_NORMAL.format(v='line')}) AS line_id FROM l), a AS (SELECT doc_id - doc_id % 2 AS pair, line_id FROM k WHERE doc_id % 2 = 0), b AS (SELECT doc_id - doc_id % 2 AS pair, line_id FROM k WHERE doc_id % 2 = 1) SELECT coalesce(a.pair, b.pair) AS pair, CASE WHEN b.line_id IS NULL THEN 'removed' WHEN a.line_id IS NULL THEN 'added' ELSE 'kept' END AS change, count(*) AS n FROM a FULL JOIN b ON a.pair = b.pair AND a.line_id = b.line_id GROUP BY ALL")
def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = _lines(spark, sf_dir).withColumn("pair", F.expr("doc_id - doc_id % 2"))
    return mt.diff_versions(pair.where("doc_id % 2 = 0"), pair.where("doc_id % 2 = 1"), "pair").groupBy("pair", "change").agg(F.count("*").alias("n"))
