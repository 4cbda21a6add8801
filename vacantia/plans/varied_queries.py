"""Queries whose inputs are varied so that every branch of an operator is reached; the SQL computes what is expected from the same inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.operators import classify as c
from vacantia.operators import matching as mt
from vacantia.plans.inputs import POSTINGS, dealt, pick, postings
from vacantia.plans.page_queries import pages
from vacantia.plans.postings_queries import _CLASSIFIED
from vacantia.plans.result_queries import _NORM, PROFILES, _list, profiles
from vacantia.sources import extract as x

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


_NL = "chr(10)"
_HEADINGS = ("Professional Summary", "Work experience:", "## Education", "Key skills", "Projects", "Certifications", "Awards |")
_SAID = ("Built models for 3 clients with Excel and SQL", "Reduced costs by 12%", "Wrote minutes", "Led 4 projects and managed credit risk", "Valuation and budgeting in Power BI")
_REACHED = ("a@x.com", "+91 98765 43210", "linkedin.com/in/a and b@y.org", "no contact")
_PARTS = ("'Ana Moss'", pick(_REACHED, "c_custkey % 4"), pick(_HEADINGS, "c_custkey % 7"), pick(_SAID, "c_custkey % 5"), pick(_SAID, "c_custkey % 3"), pick(_HEADINGS, "c_custkey % 6"), pick(_SAID, "(c_custkey + 2) % 5"), pick(_HEADINGS, "(c_custkey + 4) % 7"), pick(_SAID, "(c_custkey + 4) % 5"))
_CV = "concat(" + f", {_NL}, ".join(_PARTS) + ")"
_HEAD = r"trim(regexp_replace(regexp_replace(line, '^#+\s*', ''), '[:|]+$', ''))"
_SECTION = "CASE " + " ".join(f"WHEN regexp_matches({_HEAD}, '{p}') THEN '{s}'" for s, p in mt.SECTIONS) + " END"
_LINES = f"""v AS (SELECT c_custkey AS profile_id, {_CV} AS text FROM customer), l AS (SELECT profile_id, CAST(generate_subscripts(string_split(text, {_NL}), 1) - 1 AS INTEGER) AS pos, unnest(string_split(text, {_NL})) AS line FROM v),
 n AS (SELECT *, {_SECTION} AS heading FROM l), s AS (SELECT profile_id, pos, line, coalesce(last_value(heading IGNORE NULLS) OVER (PARTITION BY profile_id ORDER BY pos), 'other') AS section FROM n)"""


def varied_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"), "c_custkey").selectExpr("c_custkey as profile_id", f"{_CV} as text")


@query(f"WITH {_LINES} SELECT profile_id, pos, line, section FROM s")
def sections_varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.assign_sections(mt.profile_lines(varied_profiles(spark, sf_dir))).select("profile_id", "pos", "line", "section")


_SCORES = ("words", "sections", "section_score", "content_score", "evidence_score", "contact_score", "ats_score", "score")


@query(f"""WITH {_LINES}, b AS (SELECT profile_id, count(DISTINCT section) FILTER (WHERE section <> 'other') AS sections, count(*) FILTER (WHERE regexp_matches(line, '{mt.ACTION}')) AS actions, count(*) FILTER (WHERE regexp_matches(line, '{mt.QUANTIFIED}')) AS quantified, bool_or(section = 'skills') AS has_skills, bool_or(section IN ('experience', 'projects')) AS has_work FROM s GROUP BY 1),
 o AS (SELECT profile_id, len(string_split({_NORM.format(v='text')}, ' ')) AS words, len({_list('text')}) AS n, CASE WHEN contains(text, '@') THEN 7 ELSE 0 END + CASE WHEN contains(text, '+91') THEN 5 ELSE 0 END + CASE WHEN contains(text, 'linkedin.com/') THEN 3 ELSE 0 END AS contact_score FROM v),
 k AS (SELECT profile_id, words, sections, least(25, floor(sections / 4 * 25 + 0.5)) AS section_score, least(25, floor(least(words / 450, 1) * 25 + 0.5)) AS content_score, least(20, floor(least(actions, 8) / 8 * 12 + least(quantified, 4) / 4 * 8 + 0.5)) AS evidence_score, contact_score, CASE WHEN n > 2 THEN 7 WHEN n > 0 THEN 4 ELSE 0 END + CASE WHEN has_skills THEN 4 ELSE 0 END + CASE WHEN has_work THEN 4 ELSE 0 END AS ats_score FROM o JOIN b USING (profile_id)),
 t AS (SELECT *, least(100, section_score + content_score + evidence_score + contact_score + ats_score) AS score FROM k) SELECT profile_id, {', '.join(f'CAST({p} AS BIGINT) AS {p}' for p in _SCORES)} FROM t""")
def profile_scores_varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.score_profiles(varied_profiles(spark, sf_dir)).select("profile_id", *[F.col(p).cast("long").alias(p) for p in _SCORES])


_ASKED = ("- Must have 3-5 years of work with Excel and SQL", "Responsible for audit and reporting", "Minimum of 2 to 4 years in valuation", "* Bachelor of commerce preferred, knowledge of Power BI", "A friendly team", "At least 6+ years, MBA or CFA", "Must have 3-5 years of work with excel and SQL")
_DUTIES = "concat(" + f", {_NL}, ".join(["description", pick(_ASKED, "posting_id % 7"), pick(_ASKED, "(posting_id + 1) % 5"), pick(_ASKED, "(posting_id + 3) % 6"), pick(_ASKED, "posting_id % 2")]) + ")"
_BARE = r"substring(trim(regexp_replace(line, '^[•*\-–—0-9.)]+\s*', '')), 1, 220)"
_MUST = r"(?i)\b(?:must|required|minimum)\b"
_YEARS = r"(?i)\b((?:minimum of |at least )?[0-9]+(?:\.[0-9]+)?\s*(?:-|to)\s*[0-9]+(?:\.[0-9]+)?\s*years?\b|\b[0-9]+(?:\.[0-9]+)?\+\s*years?)\b"
_SCHOOL = r"(?i)\b(MBA|PGDM|bachelor[^,.;\n]*|master[^,.;\n]*|CFA|CA|CPA|FRM|degree[^,.;\n]*)\b"


@query(f"""WITH p AS (SELECT posting_id, title, location, {_DUTIES} AS d FROM ({POSTINGS}) z), t AS (SELECT *, concat(title, {_NL}, d) AS text FROM p),
 k AS (SELECT posting_id, {_list('text', ('finance', 'tools', 'business'))} AS skills FROM t),
 a AS (SELECT posting_id, 1000 + generate_subscripts(skills, 1) AS pos, unnest(skills) AS label, 'skill' AS type, 'signal' AS priority FROM k),
 l AS (SELECT posting_id, generate_subscripts(string_split(d, {_NL}), 1) AS n, unnest(string_split(d, {_NL})) AS line FROM t), q AS (SELECT posting_id, n, {_BARE} AS label FROM l),
 u AS (SELECT posting_id, 2000 + row_number() OVER (PARTITION BY posting_id ORDER BY n) AS pos, label, CASE WHEN regexp_matches(label, '{_MUST}') THEN 'requirement' ELSE 'responsibility' END AS type, CASE WHEN regexp_matches(label, '{_MUST}') THEN 'required' ELSE 'preferred' END AS priority FROM q WHERE length(label) > 12 AND regexp_matches(label, '{mt.CUE}')),
 e AS (SELECT * FROM a UNION ALL SELECT * FROM u WHERE pos <= 2008 UNION ALL SELECT posting_id, 3001, regexp_extract(text, '{_YEARS}', 1), 'experience', 'required' FROM t UNION ALL SELECT posting_id, 3002, regexp_extract(text, '{_SCHOOL}', 1), 'education', 'required' FROM t UNION ALL SELECT posting_id, 3003, location, 'location', 'context' FROM t),
 o AS (SELECT *, row_number() OVER (PARTITION BY posting_id, {_NORM.format(v='label')} ORDER BY pos) AS first FROM e WHERE label <> ''), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY posting_id ORDER BY pos) AS INTEGER) AS no FROM o WHERE first = 1) SELECT posting_id, no, label, type, priority FROM r WHERE no <= 20""")
def requirements_varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = postings(spark, sf_dir).withColumn("description", F.expr(_DUTIES))
    return mt.extract_requirements(jobs).select("posting_id", "no", "label", "type", "priority")


_LINKED = """concat(html, '<script>var a = {"url":"https:\\/\\/x.example.com\\/j\\/', CAST(page_id % 50 AS VARCHAR(10)), '", "also":"https://y.example.com/k"}</script><loc> https://z.example.com/s/', CAST(page_id AS VARCHAR(10)), '</loc><loc>https://z.example.com/s/0</loc>')"""
_FIND = {"anchor": r"""(?i)<a\b[^>]*\bhref="([^"#]+)\"""", "script": r"""(?i)"(https?:\\?/\\?/[^"\s<>]+)"\s*[,}\]]""", "sitemap": r"(?i)<loc>\s*([^<\s]+)"}


@query(f"WITH p AS (SELECT page_id, {_LINKED} AS h FROM pages), l AS (" + " UNION ALL ".join(f"SELECT page_id, unnest(regexp_extract_all(h, '{p}', 1)) AS link, '{k}' AS method FROM p" for k, p in _FIND.items()) + ") SELECT page_id, link, min(method) AS method FROM l GROUP BY page_id, link")
def links_of_all_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = _LINKED.replace("VARCHAR(10)", "STRING").replace("\\", "\\\\")
    return x.discover_links(pages(spark, sf_dir).withColumn("html", F.expr(linked)))


_GIVEN = "posting_id % 3 <> 0 AND posting_id % 5 <> 0 AND posting_id % 100 >= 75 AND posting_id % 7 <> 0 AND posting_id % 11 <> 0"


@query(_CLASSIFIED + f" SELECT match_tier, CASE WHEN match_tier <> 'possible' THEN 'deterministic' WHEN {_GIVEN} THEN 'model' ELSE 'pending' END AS classification_method, count(*) AS n FROM t GROUP BY ALL")
def model_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model results on postings: of the right text, sure enough, with bounds in order and evidence that the posting has."""
    from vacantia.plans.result_queries import model_merge

    return model_merge(spark, sf_dir)


_NEW, _OLD = "posting_id % 4 = 1", "posting_id % 2 = 1 AND posting_id % 3 <> 0"


@query(_CLASSIFIED + f" SELECT posting_id, CASE WHEN match_tier <> 'possible' THEN domain_status WHEN {_NEW} THEN 'exact' WHEN {_OLD} THEN 'likely' ELSE domain_status END AS domain_status, CASE WHEN match_tier = 'possible' AND ({_NEW} OR {_OLD}) THEN 'zero_to_two' ELSE experience_status END AS experience_status, CASE WHEN match_tier <> 'possible' THEN 'deterministic' WHEN {_NEW} OR {_OLD} THEN 'model' ELSE 'pending' END AS classification_method FROM t")
def model_results_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fresh results go before cached ones of the present version; those of other versions don't count."""
    jobs = postings(spark, sf_dir).withColumn("description_hash", F.md5("description"))
    p = c.classify_texts(jobs)
    told = lambda domain, sure: ("posting_id", "description_hash", f"'{domain}' as domain_status", "'zero_to_two' as experience_status", "0.0D as minimum_years", "2.0D as maximum_years", f"{sure}D as confidence", "array(title) as evidence")
    cache = jobs.where("posting_id % 2 = 1").selectExpr(*told("likely", 0.99), "case when posting_id % 3 = 0 then 'v1' else 'v2' end as version")
    merged = mt.merge_model_results(p, jobs.where(_NEW).selectExpr(*told("exact", 0.8)), cache=cache, version="v2")
    return merged.select("posting_id", "domain_status", "experience_status", "classification_method")


# The headings of the profiles stand on lines 2 and 5; line 3 is proven everywhere and carried over, line 1 as part of the header. A proven line that the profile doesn't have is lost.
@query(f"WITH p AS (SELECT profile_id, string_split(text, chr(10)) AS l FROM ({PROFILES}) p), x AS (SELECT profile_id, md5({_NORM.format(v='l[4]')}) AS line_id FROM p UNION SELECT profile_id, md5(concat('gone ', CAST(profile_id AS VARCHAR))) FROM p WHERE profile_id % 3 = 0) SELECT x.profile_id, x.line_id FROM x JOIN p USING (profile_id) WHERE NOT list_contains(list_transform(l, lambda v: md5({_NORM.format(v='v')})), x.line_id)")
def tailored_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = mt.profile_lines(profiles(spark, sf_dir))
    gone = profiles(spark, sf_dir).where("profile_id % 3 = 0").select("profile_id", F.md5(F.concat(F.lit("gone "), F.col("profile_id").cast("string"))).alias("line_id"))
    proven = lines.where("pos = 3").select("profile_id", "line_id").union(gone)
    return mt.tailor_profile(lines, proven)[1]


ORACLE_SQL["model_merge"] = ORACLE_SQL["model_results"]
