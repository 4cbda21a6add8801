"""Queries on profiles, contacts, outcomes and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.operators import classify as c
from vacantia.operators import contacts as ct
from vacantia.operators import matching as mt
from vacantia.operators.tables import Rounds
from vacantia.plans.inputs import OUTREACH, POSTINGS, RUNS, dealt, outreach, pick, postings, runs
from vacantia.plans.postings_queries import _NOISE, m
from vacantia.functions import wordlists as w
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


_SKILL_LINES = ("Built Excel reports in 3 projects", "Managed credit risk reviews", "- Automated SQL reporting for 20 users", "Financial modelling and valuation", "Python and Power BI dashboards", "Led audit and reconciliation")
_PROFILE = "concat('Pat Example', chr(10), 'pat', CAST(c_custkey AS VARCHAR(10)), '@mail.example.com', chr(10), 'Experience', chr(10), " + pick(_SKILL_LINES, "c_custkey % 6") + ", chr(10), " + pick(_SKILL_LINES[::-1], "c_custkey % 5") + ", chr(10), 'Skills', chr(10), " + pick(("Excel, SQL", "Tableau", "communication", "R and VBA"), "c_custkey % 4") + ")"
PROFILES = f"SELECT c_custkey AS profile_id, {_PROFILE} AS text FROM customer"


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = dealt(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"), "c_custkey")
    return keys.selectExpr("c_custkey as profile_id", f"{_PROFILE.replace('VARCHAR(10)', 'STRING')} as text")


_NORM = r"trim(regexp_replace(lower({v}), '[^a-z0-9+#.&%/-]+', ' ', 'g'))"


def _has(value: str, term: str) -> str:
    variants = [v for v in (x.lower() for x in mt.TERM_ALIASES.get(term, (term,))) if len(v) > 1]
    return "(" + " OR ".join(f"contains(concat(' ', {_NORM.format(v=value)}, ' '), ' {v} ')" for v in variants) + ")" if variants else "false"


def _list(value: str, groups: tuple[str, ...] | None = None) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {_has(value, t)} THEN '{t}' END" for _, t, v in mt._terms(groups) if v) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT profile_id, array_to_string({_list('text')}, ',') AS skills FROM ({PROFILES}) p")
def skill_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.tag_skills(profiles(spark, sf_dir), F.col("text")).select("profile_id", F.array_join("skills", ",").alias("skills"))


@query(f"SELECT profile_id, pos, line, CASE WHEN pos < 2 THEN 'other' WHEN pos < 5 THEN 'experience' ELSE 'skills' END AS section FROM (SELECT profile_id, CAST(unnest(generate_series(0, 6)) AS INTEGER) AS pos, unnest(string_split(text, chr(10))) AS line FROM ({PROFILES}) p) l")
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.assign_sections(mt.profile_lines(profiles(spark, sf_dir))).select("profile_id", "pos", "line", "section")


_PARTS = ("words", "sections", "section_score", "content_score", "evidence_score", "contact_score", "ats_score", "score")


# Each profile has the headings of experience and skills, an e-mail address, and no phone.
@query(f"""WITH p AS ({PROFILES}), l AS (SELECT profile_id, unnest(string_split(text, chr(10))) AS line FROM p),
 b AS (SELECT profile_id, count(*) FILTER (WHERE regexp_matches(line, '{mt.ACTION}')) AS actions, count(*) FILTER (WHERE regexp_matches(line, '{mt.QUANTIFIED}')) AS quantified FROM l GROUP BY 1),
 o AS (SELECT profile_id, len(string_split({_NORM.format(v='text')}, ' ')) AS words, len({_list('text')}) AS n FROM p),
 s AS (SELECT profile_id, words, 2 AS sections, 13 AS section_score, least(25, floor(least(words / 450, 1) * 25 + 0.5)) AS content_score, least(20, floor(least(actions, 8) / 8 * 12 + least(quantified, 4) / 4 * 8 + 0.5)) AS evidence_score, 7 AS contact_score, CASE WHEN n > 2 THEN 15 WHEN n > 0 THEN 12 ELSE 8 END AS ats_score FROM o JOIN b USING (profile_id)),
 t AS (SELECT *, least(100, section_score + content_score + evidence_score + contact_score + ats_score) AS score FROM s) SELECT profile_id, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _PARTS)} FROM t""")
def profile_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.score_profiles(profiles(spark, sf_dir)).select("profile_id", *[F.col(c).cast("long").alias(c) for c in _PARTS])


_RTEXT = "concat(title, chr(10), description)"


@query(f"WITH p AS ({POSTINGS}), s AS (SELECT posting_id, unnest({_list(_RTEXT, ('finance', 'tools', 'business'))}) AS label FROM p), t AS (SELECT posting_id, label, 'skill' AS type FROM s UNION ALL SELECT posting_id, location, 'location' FROM p WHERE location <> '') SELECT * FROM t")
def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.extract_requirements(postings(spark, sf_dir)).select("posting_id", "label", "type")


def _scored(spark: SparkSession, sf_dir: str, jobs: DataFrame | None = None) -> DataFrame:
    """Each profile with its 20 likeliest active postings, scored."""
    jobs = postings(spark, sf_dir).where("active") if jobs is None else jobs
    people = profiles(spark, sf_dir)
    pairs = Rounds(spark, "pairs").write(mt.likely_pairs(mt.offered_sets(jobs, ("finance", "tools", "business")), mt.term_sets(people, "profile_id", F.col("text"))), "pairs")
    asked = mt.extract_requirements(jobs.join(pairs.select("posting_id").distinct(), "posting_id", "left_semi"))
    return mt.scored_pairs(pairs, asked, mt.profile_terms(mt.profile_lines(people)), jobs, people)


_PAIRS = f"""WITH p AS (SELECT *, {_list(_RTEXT, ('finance', 'tools', 'business'))} AS skills, {_list('title')} AS tt, len({_list(_RTEXT, ('finance',))}) > 0 AS fin FROM ({POSTINGS}) z WHERE active), q AS (SELECT profile_id, {_list('text')} AS terms, len({_list('text', ('finance',))}) > 0 AS has FROM ({PROFILES}) y),
 s AS (SELECT posting_id, unnest(skills) AS term FROM p), t AS (SELECT profile_id, unnest(terms) AS term FROM q), g AS (SELECT posting_id, profile_id, count(*) AS shared FROM s JOIN t USING (term) GROUP BY ALL),
 a AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY shared DESC, posting_id) <= 20)"""


@query(_PAIRS + " SELECT posting_id, profile_id, shared AS n FROM a")
def evidence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("posting_id", "profile_id", F.size("evidence").cast("long").alias("n"))


_SCORES = _PAIRS + """,
 x AS (SELECT posting_id, profile_id, shared, list_filter([shared / len(skills), CASE WHEN len(tt) > 0 THEN len(list_intersect(tt, terms)) / len(tt) END, CASE WHEN fin THEN CASE WHEN has THEN 1.0 ELSE 0.0 END END], lambda v: v IS NOT NULL) AS cover FROM a JOIN p USING (posting_id) JOIN q USING (profile_id)),
 k AS (SELECT posting_id, profile_id, shared, CAST(floor(list_sum(cover) / len(cover) * 100 + 0.5) AS INTEGER) AS score FROM x)"""


@query(_SCORES + " SELECT posting_id, profile_id, score FROM k")
def match_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("posting_id", "profile_id", "score")


_TOP = _SCORES + ", b AS (SELECT *, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY score DESC NULLS LAST, shared DESC, posting_id) AS INTEGER) AS match_rank FROM k)"


@query(_TOP + " SELECT posting_id, profile_id, score, match_rank FROM b WHERE match_rank <= 10")
def top_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.top_matches(_scored(spark, sf_dir)).select("posting_id", "profile_id", "score", "match_rank")


_LETTER = "concat(description, CASE posting_id % 4 WHEN 0 THEN ' A cover letter is optional.' WHEN 1 THEN ' Please include a motivation letter.' ELSE '' END)"


_PADDED = f"concat(' ', {_NORM.format(v=f'concat(title, chr(10), {_LETTER.replace("description,", "p.description,", 1)})')}, ' ')"
_FAMILY = "CASE " + " ".join("WHEN " + " OR ".join(f"contains({_PADDED}, ' {t} ')" for t in terms) + f" THEN '{label}'" for label, terms in mt.FAMILIES) + " ELSE 'finance / analyst' END"


@query(_TOP + f""", ln AS (SELECT profile_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM ({PROFILES}) y), lt AS (SELECT profile_id, pos, line, unnest({_list('line')}) AS term FROM ln), fp AS (SELECT profile_id, term, arg_min(line, pos) AS line FROM lt GROUP BY ALL),
 sk AS (SELECT posting_id, generate_subscripts(skills, 1) AS n, unnest(skills) AS term FROM p), ev AS (SELECT posting_id, profile_id, line, min(n) AS n FROM b JOIN sk USING (posting_id) JOIN fp USING (profile_id, term) WHERE match_rank <= 10 AND posting_id % 4 IN (0, 1) GROUP BY ALL),
 el AS (SELECT posting_id, profile_id, list(line ORDER BY n) AS l FROM ev GROUP BY ALL HAVING count(*) >= 2)
 SELECT posting_id, profile_id, concat('Dear Hiring Manager,', chr(10), chr(10), 'Please consider my application for the ', title, ' position at ', company, '. My profile contains documented evidence relevant to this ', {_FAMILY}, ' role.', chr(10), chr(10), 'Relevant evidence from my profile:', chr(10), array_to_string(list_transform(l[1:3], lambda e: CASE WHEN regexp_matches(e, '^[-*•▪‣]') THEN e ELSE concat('- ', e) END), chr(10)), chr(10), chr(10), 'Regards,', chr(10), '[Your name]') AS letter FROM el JOIN p USING (posting_id)""")
def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = postings(spark, sf_dir).where("active").withColumn("description", F.expr(_LETTER))
    return mt.draft_letters(mt.top_matches(_scored(spark, sf_dir, jobs)), jobs)


_WORDED = "concat(text, CASE doc_id % 5 WHEN 0 THEN concat(chr(10), 'A cover letter is required.') WHEN 1 THEN ' A covering letter is optional. Please submit your marks.' WHEN 2 THEN concat(chr(10), 'Your motivation letter tells us more.') WHEN 3 THEN concat(chr(10), 'Please attach a cover letter.') ELSE '' END)"
_SAID = "list_filter(regexp_split_to_array(replace(t, '.', concat('.', chr(10))), chr(10)), lambda v: regexp_matches(v, '(?i)cover letter|covering letter|motivation letter|letter of motivation'))[1]"


@query(f"SELECT doc_id, CASE WHEN trim(coalesce(t, '')) = '' THEN 'unknown' WHEN said IS NULL THEN 'not_mentioned' WHEN regexp_matches(said, '(?i)\\b(required|must|mandatory|please (submit|include|attach)|submit .*cover)') THEN 'required' WHEN regexp_matches(said, '(?i)\\boptional\\b') THEN 'optional' ELSE 'mentioned' END AS letter FROM (SELECT doc_id, t, {_SAID} AS said FROM (SELECT doc_id, {_WORDED} AS t FROM documents) d) z")
def letter_wording(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", mt.letter_requirement(F.expr(_WORDED)).alias("letter"))


_MX = "SELECT DISTINCT concat('d', CAST(c_nationkey % 9 AS VARCHAR), '.example.com') AS domain, c_nationkey % 9 AS k FROM customer WHERE c_nationkey % 9 <> 3"


@query(f"SELECT contact_id, CASE WHEN split_part(email, '@', 1) = 'info' THEN 'role_account' WHEN k IS NULL THEN 'unknown' WHEN k = 5 THEN 'domain_no_mx' ELSE 'accepts_mail' END AS verdict, CASE WHEN k IS NOT NULL AND k <> 5 THEN CASE k % 2 WHEN 0 THEN 'Google Workspace' ELSE 'Microsoft 365' END END AS provider FROM (SELECT contact_id, CASE WHEN contact_id % 10 = 0 THEN concat('info@', split_part(email, '@', 2)) ELSE email END AS email FROM ({OUTREACH}) o) c LEFT JOIN ({_MX}) m ON m.domain = split_part(email, '@', 2)".replace("THEN CASE k % 2", "AND split_part(email, '@', 1) <> 'info' THEN CASE k % 2"))
def contact_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    mx = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_nationkey % 9 <> 3").selectExpr("concat('d', c_nationkey % 9, '.example.com') as domain", "case when c_nationkey % 9 = 5 then array() when c_nationkey % 9 % 2 = 0 then array('aspmx.l.google.com') else array('x.mail.protection.outlook.com') end as hosts").distinct()
    people = outreach(spark, sf_dir).withColumn("email", F.expr("case when contact_id % 10 = 0 then concat('info@', split_part(email, '@', 2)) else email end"))
    return ct.verify_contacts(people, mx).select("contact_id", "verdict", "provider")


_PATTERN = "CASE contact_id % 6 WHEN 0 THEN '{first}.{last}' WHEN 1 THEN '{first}{last}' WHEN 2 THEN '{f}{last}' WHEN 3 THEN '{first}_{last}' END"
_LEARNT = f"WITH o AS ({OUTREACH}), l AS (SELECT split_part(email, '@', 2) AS domain, {_PATTERN} AS pattern FROM o WHERE result IN ('delivered', 'replied')), n AS (SELECT domain, pattern, count(*) AS n FROM l WHERE pattern IS NOT NULL GROUP BY ALL), r AS (SELECT *, CAST(floor(100 * n / sum(n) OVER (PARTITION BY domain) + 0.5) AS INTEGER) AS share, CAST(row_number() OVER (PARTITION BY domain ORDER BY n DESC, pattern) AS INTEGER) AS pattern_rank FROM n)"


@query(_LEARNT + " SELECT * FROM r")
def email_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.learn_patterns(outreach(spark, sf_dir))


@query(_LEARNT + ", b AS (SELECT * FROM r WHERE pattern_rank = 1) SELECT contact_id, concat(replace(replace(replace(pattern, '{first}', lower(split_part(name, ' ', 1))), '{last}', lower(split_part(name, ' ', 2))), '{f}', substring(lower(name), 1, 1)), '@', domain) AS email FROM o JOIN b ON domain = split_part(o.email, '@', 2)")
def email_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = outreach(spark, sf_dir).selectExpr("contact_id", "name", "split_part(email, '@', 2) as domain")
    return ct.suggest(people, ct.learn_patterns(outreach(spark, sf_dir))).select("contact_id", "email")


@query(f"SELECT split_part(email, '@', 2) AS domain, count(*) AS samples FROM ({OUTREACH}) o GROUP BY ALL")
def pattern_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.pattern_stats(outreach(spark, sf_dir)).select("domain", "samples")


@query(f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY split_part(email, '@', 2) ORDER BY sent_no DESC) AS n FROM ({OUTREACH}) o) SELECT contact_id FROM r WHERE n <= 200")
def retained_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vacantia.operators.lifecycle import retain_last

    return retain_last(outreach(spark, sf_dir).withColumn("domain", F.expr("split_part(email, '@', 2)")), ["domain"], 200, [F.desc("sent_no")]).select("contact_id")


@query("WITH q AS (SELECT unnest(['click', 'view', 'signup', 'purchase', 'error']) AS question_id, unnest([1, 2, 3, 4, 5]) AS position), a AS (SELECT DISTINCT user_id AS respondent, event_type AS question_id FROM events), r AS (SELECT DISTINCT respondent FROM a) SELECT r.respondent, CAST(count(a.question_id) AS INTEGER) AS answered, 5 AS total, CAST(floor(100 * count(a.question_id) / 5 + 0.5) AS INTEGER) AS percent FROM r CROSS JOIN q LEFT JOIN a ON a.respondent = r.respondent AND a.question_id = q.question_id GROUP BY ALL")
def survey_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    names = e.select("event_type").distinct()
    questions = names.selectExpr("event_type as question_id", "array_position(array('click', 'view', 'signup', 'purchase', 'error'), event_type) as position", "event_type as prompt", "event_type <> 'error' as recommended")
    return ct.survey_completion(e.selectExpr("user_id as respondent", "event_type as question_id", "array(event_type) as value"), questions).select("respondent", "answered", "total", "percent")


@query("WITH f AS (SELECT o_orderkey AS application_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INTEGER) END AS next_at FROM orders) SELECT application_id, CASE WHEN next_at IS NULL THEN 'none' WHEN next_at - DATE '1995-06-01' <= 0 THEN 'due' WHEN next_at - DATE '1995-06-01' <= 7 THEN 'soon' ELSE 'later' END AS due FROM f")
def followups_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey as application_id", "array(named_struct('at', date_add(to_date(o_orderdate), cast(o_orderkey % 5 as int)), 'sent', o_orderkey % 3 = 0), named_struct('at', date'1990-01-01', 'sent', true)) as follow_ups")
    return ct.followups_due(a, F.expr("date'1995-06-01'")).select("application_id", "due")


@query("WITH s AS (SELECT concat('https://posts.example.com/', CAST(event_id % 400 AS VARCHAR)) AS url, concat('Company ', CAST(user_id AS VARCHAR)) AS company, CASE WHEN event_id % 4 = 1 THEN 'referral' ELSE 'other' END AS type, ts AS seen, event_id FROM events WHERE event_id % 5 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seen DESC, company, type, CAST(event_id AS VARCHAR)) AS n FROM s) SELECT md5(url) AS signal_id, company, type FROM r WHERE n = 1")
def signals_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("concat(case when event_id % 5 = 0 then 'http' else 'https' end, '://posts.example.com/', event_id % 400) as url", "concat('Company ', user_id) as company", "case when event_id % 4 = 1 then 'referral' else 'chat' end as type", "cast(event_id as string) as note", "ts as at")
    return ct.clean_signals(s).select("signal_id", "company", "type")


@query(f"SELECT posting_id, md5(concat_ws('|', 'portal', detail_url)) AS portal_id FROM ({POSTINGS}) p WHERE {m('location', w.INDIA)} AND NOT {_NOISE} AND {m('title', w.DOMAIN_METADATA)}")
def portal_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.filter_portal(postings(spark, sf_dir)).select("posting_id", "portal_id")


@query(f"SELECT substring(concat_ws(':', CAST(connector_id AS VARCHAR), CAST(posting_id AS VARCHAR), detail_url), 1, 180) AS role_id, title, CASE WHEN location = '' THEN 'Location not listed' ELSE location END AS location, CASE WHEN category = '' THEN 'Uncategorised' ELSE category END AS category FROM ({POSTINGS}) p")
def role_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.role_catalog(postings(spark, sf_dir)).select("role_id", "title", "location", "category")


@query(f"SELECT posting_id FROM ({POSTINGS}) p WHERE DATE '1997-01-01' - CAST(posted_at AS DATE) <= 30")
def recent_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.recent(postings(spark, sf_dir), 30, F.expr("date'1997-01-01'")).select("posting_id")


@query()
def model_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = postings(spark, sf_dir)
    p = c.classify_texts(jobs).withColumn("description_hash", F.md5("description"))
    results = jobs.where("posting_id % 3 <> 0").selectExpr("posting_id", "case when posting_id % 5 = 0 then 'old' else md5(description) end as description_hash", "'exact' as domain_status", "'zero_to_two' as experience_status", "0.0D as minimum_years", "case when posting_id % 7 = 0 then -1.0D else 2.0D end as maximum_years", "posting_id % 100 / 100 as confidence", "array(case when posting_id % 11 = 0 then 'not said' else title end) as evidence")
    return mt.merge_model_results(p, results).groupBy("match_tier", "classification_method").agg(F.count("*").alias("n"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


@query("SELECT event_id, user_id, n AS in_window FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS n FROM events) e WHERE n > 2")
def rate_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.rate_violations(_events(spark, sf_dir), 3600, 2, "user_id").select("event_id", "user_id", "in_window")


@query("WITH RECURSIVE e AS (SELECT user_id, ts, event_id FROM events), a AS (SELECT user_id, min(ts) AS ts FROM e GROUP BY user_id UNION ALL SELECT user_id, ts FROM (SELECT e.user_id, min(e.ts) AS ts FROM e JOIN a ON a.user_id = e.user_id AND epoch_us(e.ts) - epoch_us(a.ts) >= 86400000000 GROUP BY e.user_id, a.ts) n) SELECT user_id, ts, min(event_id) AS event_id FROM e JOIN a USING (user_id, ts) GROUP BY ALL")
def cooldown_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.cooldown(_events(spark, sf_dir), 86400, "user_id")


@query(f"WITH x AS (SELECT DISTINCT s_suppkey % 60 AS connector_id FROM supplier), l AS (SELECT connector_id, max(finished_at) AS last_run_at FROM ({RUNS}) r GROUP BY ALL) SELECT connector_id, last_run_at FROM x LEFT JOIN l USING (connector_id) WHERE last_run_at IS NULL OR epoch_us(TIMESTAMP '2024-01-30') - epoch_us(last_run_at) > 3000000000")
def stale_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey % 60 as connector_id", "50 as max_minutes").distinct()
    return ev.stale_sources(runs(spark, sf_dir), expected, F.expr("timestamp'2024-01-30'"))


@query("WITH r AS (SELECT user_id AS job_id, event_type AS verdict, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE ts <= TIMESTAMP '2024-01-20') SELECT job_id, verdict, ts FROM r WHERE n = 1 AND epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts) <= 30 * 60000000")
def fresh_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = _events(spark, sf_dir).where("ts <= timestamp'2024-01-20'").selectExpr("user_id as job_id", "ts", "event_id as check_id", "event_type as verdict")
    return ev.fresh_status(checks, F.expr("timestamp'2024-01-20'"))


_TRIES = "CASE WHEN event_type = 'purchase' THEN 'ok' WHEN event_id % 29 = 0 THEN 'gone' ELSE 'error' END"


@query(f"""WITH RECURSIVE t AS (SELECT user_id AS job_id, epoch_us(ts) AS at, {_TRIES} AS outcome, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type <> 'view'),
 j AS (SELECT DISTINCT user_id AS job_id FROM events),
 r AS (SELECT job_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS last, 0 AS n, 'pending' AS status FROM j
 UNION ALL SELECT r.job_id, t.k, CASE WHEN r.last IS NULL OR t.at - r.last >= 300000000 THEN t.at ELSE r.last END, CASE WHEN r.last IS NULL OR t.at - r.last >= 300000000 THEN r.n + 1 ELSE r.n END,
 CASE WHEN NOT (r.last IS NULL OR t.at - r.last >= 300000000) THEN 'pending' WHEN t.outcome = 'ok' THEN 'sent' WHEN t.outcome = 'gone' OR r.n + 1 >= 5 THEN 'failed' ELSE 'pending' END
 FROM r JOIN t ON t.job_id = r.job_id AND t.k = r.k + 1 WHERE r.status = 'pending')
 SELECT job_id, arg_max(status, k) AS status, CAST(max(n) AS INTEGER) AS attempts FROM r GROUP BY job_id""")
def outbox_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    attempts = e.where("event_type <> 'view'").selectExpr("user_id as job_id", "ts", "event_id as attempt_id", f"{_TRIES} as outcome")
    return ev.outbox_final(e.selectExpr("user_id as job_id", "ts as at"), attempts).select("job_id", "status", "attempts")


@query(f'SELECT status, count(*) AS n FROM ({ORACLE_SQL["outbox_final"]}) z GROUP BY status')
def outbound_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.outbound_summary(outbox_final(spark, sf_dir))


@query("SELECT application_id, status, confidence, n FROM (SELECT o_orderkey AS application_id, CASE o_orderkey % 4 WHEN 0 THEN 'applied' WHEN 1 THEN 'offer' ELSE 'saved' END AS status, CAST(least(greatest(o_orderkey % 300 - 100, 0), 100) AS BIGINT) AS confidence, CAST(least(o_orderkey % 9 + 1, 6) AS INTEGER) AS n FROM orders) z")
def applications_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey as application_id", "case o_orderkey % 4 when 0 then 'applied' when 1 then 'offer' when 2 then 'lost?' end as status", "o_orderkey % 300 - 100 as confidence", "transform(sequence(1, cast(o_orderkey % 9 + 1 as int)), i -> named_struct('at', date_add(to_date(o_orderdate), i), 'sent', false)) as follow_ups")
    return ct.clean_applications(a).select("application_id", "status", F.col("confidence").cast("long").alias("confidence"), F.size("follow_ups").alias("n"))
