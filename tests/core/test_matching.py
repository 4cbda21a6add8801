import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from vacantia.functions import names
from vacantia.functions.urls import host
from vacantia.operators import classify, linking, matching
from vacantia.sources import extract
from vacantia.streaming import events



def test_likely_pairs_against_brute_force(spark):
    rnd = random.Random(2)
    words = list("abcdefgh")
    jobs = [(rnd.randrange(10**6) * 7 + i % 7, sorted(rnd.sample(words, rnd.choice([1, 2, 2, 3])))) for i in range(400)]
    people = [(i, sorted(rnd.sample(words, rnd.randrange(1, 6)))) for i in range(120)] + [(500, ["z"])]
    got = sorted(map(tuple, matching.likely_pairs(spark.createDataFrame(jobs, "posting_id long, terms array<string>"), spark.createDataFrame(people, "profile_id long, terms array<string>"), 6).collect()))
    want = []
    for p, terms in people:
        ranked = sorted((-len(set(terms) & set(t)), j) for j, t in jobs if set(terms) & set(t))[:6]
        want += [(p, j, -n) for n, j in ranked]
    assert got == sorted(want)


def test_threshold_join_looks_at_few_pairs(spark):
    """Common terms and rare ones: the best are found from the rare ones' lists."""
    rnd = random.Random(9)
    common, rare = [f"c{k}" for k in range(6)], [f"r{k}" for k in range(60)]
    terms = lambda: sorted({*rnd.sample(common, rnd.choice([2, 3, 4])), *rnd.sample(rare, rnd.choice([1, 2, 3]))})
    jobs, people = [(i, terms()) for i in range(1500)], [(i, terms()) for i in range(150)] + [(900, ["c0", "c1"]), (901, ["none"]), (902, ["c5", "none"])]
    shape = "long, terms array<string>"
    j, p = spark.createDataFrame(jobs, f"posting_id {shape}").repartition(4), spark.createDataFrame(people, f"profile_id {shape}")
    want = []
    for i, mine in people:
        ranked = sorted((-len(set(mine) & set(t)), k) for k, t in jobs if set(mine) & set(t))[:5]
        want += [(i, k, -n) for n, k in ranked]
    assert sorted(map(tuple, matching.likely_pairs(j, p, 5).collect())) == sorted(want)
    first, rest = matching.threshold_pairs(j, p, 5)
    looked = first.union(rest).select("ask", "offer")
    sharing = sum(len({tuple(t) for _, t in jobs if set(t) & set(m)}) for m in {tuple(m) for _, m in people})
    assert looked.count() == looked.distinct().count() < 0.4 * sharing


JOBS = [
    (1, "Credit Analyst", "Co", "Pune", "Must know Excel and SQL. \nMust have reporting and audit experience\nA cover letter is required."),
    (2, "Clerk", "Co", "", "Friendly team with Excel"),
    (3, "Analyst", "Co", "", "Excel, SQL and Tableau for audit"),
    (4, "Excel", "Co", "", None),
]
PEOPLE = [(1, "Ana\nExperience\n- Built Excel models\nSQL reporting for audit teams\nSkills\nExcel"), (2, "Ben\nSkills\nTableau"), (3, ""), (4, None), (5, "cooking")]


def scored(spark):
    jobs = spark.createDataFrame(JOBS, "posting_id long, title string, company string, location string, description string")
    people = spark.createDataFrame(PEOPLE, "profile_id long, text string")
    pairs = matching.likely_pairs(matching.term_sets(jobs, "posting_id", F.concat_ws("\n", "title", "description")), matching.term_sets(people, "profile_id", F.col("text")))
    return jobs, matching.scored_pairs(pairs, matching.extract_requirements(jobs), matching.profile_terms(matching.profile_lines(people)), jobs, people)


def test_scores_and_letters(spark):
    jobs, x = scored(spark)
    got = {(r.profile_id, r.posting_id): r for r in x.collect()}
    assert set(got) == {(1, 1), (1, 2), (1, 3), (1, 4), (2, 3)}
    first = {e.excerpt for e in got[1, 1].evidence if e.supported}
    assert first == {"- Built Excel models", "SQL reporting for audit teams"}
    assert got[1, 4].score is None and got[1, 2].score == 100 and got[2, 3].score < got[1, 3].score
    top = matching.top_matches(x, 2).where("profile_id = 1").collect()
    assert len(top) == 2 and all(r.score >= got[1, 3].score for r in top)
    letters = matching.draft_letters(x, jobs).collect()
    assert [(r.profile_id, r.posting_id) for r in letters] == [(1, 1)]
    assert "- SQL reporting for audit teams\n- Built Excel models" in letters[0].letter and letters[0].letter.startswith("Dear Hiring Manager")


def test_profiles_are_not_broadcast(spark, tmp_path):
    """However small the planner takes their file for, profiles and their proofs are joined by shuffle."""
    spark.createDataFrame(PEOPLE, "profile_id long, text string").write.parquet(str(tmp_path / "people"))
    spark.createDataFrame(JOBS, "posting_id long, title string, company string, location string, description string").write.parquet(str(tmp_path / "jobs"))
    jobs, people = spark.read.parquet(str(tmp_path / "jobs")), spark.read.parquet(str(tmp_path / "people"))
    pairs = spark.createDataFrame([(1, 1, 2)], "profile_id long, posting_id long, shared long")
    x = matching.scored_pairs(pairs, matching.extract_requirements(jobs), matching.profile_terms(matching.profile_lines(people)), jobs, people)
    joins = [line for line in x._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join [profile_id" in line]
    assert len(joins) == 2 and not any("Broadcast" in line for line in joins)


def test_terms_are_looked_for_once_a_text(spark):
    rnd = random.Random(6)
    texts = [("Excel", "SQL for audit"), ("Excel\nSQL", "for audit"), ("SQL", None), (None, None), ("Clerk", "tea"), ("Audit", "excel and sql")]
    rows = [(i, *rnd.choice(texts)) for i in rnd.sample(range(1000), 300)]
    jobs = spark.createDataFrame(rows, "posting_id long, title string, description string").repartition(5)
    people = spark.createDataFrame([(1, ["Excel", "SQL"]), (2, ["audit"]), (3, ["Tableau"])], "profile_id long, terms array<string>")
    every = matching.term_sets(jobs, "posting_id", F.concat_ws("\n", "title", "description"))
    few = matching.offered_sets(jobs, cheap=7)
    assert few.count() <= 7 * len(texts) < every.count()
    pairs = [sorted(map(tuple, matching.likely_pairs(sets, people, 7).collect())) for sets in (few, every)]
    assert pairs[0] == pairs[1] and len(pairs[0]) == 14


def test_feed_orders_and_unions(spark):
    feed = spark.createDataFrame([(1, "B", "2024-01-01"), (2, "A", "2024-01-01"), (3, "C", "2024-02-01"), (4, "D", None)], "posting_id long, company string, posted_at string")
    scores = spark.createDataFrame([(4, 10), (9, 99)], "posting_id long, score int")
    assert [r.posting_id for r in classify.by_score(feed, scores).orderBy("score_rank").collect()] == [4, 3, 2, 1]
    whole = classify.whole_feed(feed, feed.select("posting_id").limit(1), feed.selectExpr("company", "1 as page_id").limit(2))
    assert {r.origin: r["count"] for r in whole.groupBy("origin").count().collect()} == {"role": 4, "portal": 1, "imported": 2} and "page_id" in whole.columns


def test_structured_data_at_any_depth(spark):
    node = '{"@type":"JobPosting","title":"T%d"}'
    deep = node % 1
    for _ in range(6):
        deep = '[{"@graph":[' + deep + ',{"@type":"Person"}]}]'
    html = "".join(f'<script type="application/ld+json">{x}</script>' for x in (deep, node % 2, "{broken", '{"@type":["JobPosting","Thing"],"title":"T3"}'))
    got = extract.extract_jsonld(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id int, html string"))
    assert sorted(r.t for r in got.select(F.get_json_object("node", "$.title").alias("t")).collect()) == ["T1", "T2", "T3"]


def test_attempts_wait_five_minutes(spark):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    jobs = spark.createDataFrame([(k, at(0)) for k in range(1, 6)], "job_id int, at timestamp")
    tries = [(1, 0, "error"), (1, 3, "ok"), (1, 6, "error"), (2, 0, "error"), (2, 5, "ok"), (3, 0, "gone"), (3, 9, "ok"), *[(4, 5 * k, "error") for k in range(7)]]
    attempts = spark.createDataFrame([(j, at(m), i, o) for i, (j, m, o) in enumerate(tries)], "job_id int, ts timestamp, attempt_id int, outcome string")
    got = {r.job_id: (r.status, r.attempts) for r in events.outbox_final(jobs, attempts).collect()}
    assert got == {1: ("pending", 2), 2: ("sent", 2), 3: ("failed", 1), 4: ("failed", 5), 5: ("pending", 0)}


def test_rates_without_a_key(spark):
    rnd = random.Random(3)
    rows = [(i, datetime(2024, 1, 1) + timedelta(seconds=rnd.randrange(4000))) for i in range(400)]
    got = {r.event_id: r.in_window for r in events.rate_violations(spark.createDataFrame(rows, "event_id int, ts timestamp"), 300, 25).collect()}
    want = {i: n for i, t in rows if (n := sum(t - timedelta(seconds=300) < u <= t for _, u in rows)) > 25}
    assert got == want and want


def test_rates_of_dense_windows_by_running_counts(spark):
    """Frames that begin at a moving place are summed anew for each row; running counts aren't. Times may be equal or missing, keys too."""
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["a", "b", None]), rnd.choice([None, *[datetime(2024, 1, 1) + timedelta(seconds=rnd.randrange(900), microseconds=rnd.choice([0, 1]))] * 9])) for i in range(600)]
    table = spark.createDataFrame(rows, "event_id int, user_id string, ts timestamp")
    inside = lambda t, u: u == t if t is None or u is None else t - timedelta(seconds=300) < u <= t
    for key, same in ((None, lambda a, b: True), ("user_id", lambda a, b: a == b)):
        found = events.rate_violations(table, 300, 20, key)
        want = {i: n for i, k, t in rows if (n := sum(inside(t, u) for _, j, u in rows if same(k, j))) > 20}
        assert {r.event_id: r.in_window for r in found.collect()} == want and found.columns == [*table.columns, "in_window"]
        frames = found._jdf.queryExecution().optimizedPlan().toString().split("specifiedwindowframe(RangeFrame, ")[1:]
        assert frames and all(f.startswith("unboundedpreceding$()") for f in frames)


def test_model_results_and_cache(spark):
    row = "posting_id int, description_hash string, title string, experience_text string, description string, match_tier string, domain_status string, experience_status string, minimum_years double, maximum_years double"
    jobs = spark.createDataFrame([(k, "h", "Analyst", "", "text", tier, "likely", "ambiguous", None, None) for k, tier in ((1, "possible"), (2, "possible"), (3, "possible"), (4, "exact"), (5, "possible"))], row)
    result = "posting_id int, description_hash string, domain_status string, experience_status string, minimum_years double, maximum_years double, confidence double, evidence array<string>"
    results = spark.createDataFrame([(1, "h", "exact", "zero_to_two", 0.0, 2.0, 0.8, ["analyst"]), (1, "h", "unrelated", "over_two", 3.0, 4.0, 0.76, ["text"]), (2, "old", "exact", "zero_to_two", 0.0, 2.0, 0.9, ["text"]), (4, "h", "unrelated", "over_two", 3.0, 3.0, 0.9, []), (5, "h", "exact", "zero_to_two", 2.0, 1.0, 0.9, [])], result)
    cache = spark.createDataFrame([(1, "h", "unrelated", "over_two", 3.0, 4.0, 0.99, [], "v2"), (3, "h", "exact", "zero_to_two", 0.0, 1.0, 0.9, ["text"], "v2"), (2, "h", "exact", "zero_to_two", 0.0, 1.0, 0.9, [], "v1")], result + ", version string")
    got = {r.posting_id: (r.classification_method, r.domain_status, r.maximum_years) for r in matching.merge_model_results(jobs, results, cache=cache, version="v2").collect()}
    assert got == {1: ("model", "exact", 2.0), 2: ("pending", "likely", None), 3: ("model", "exact", 1.0), 4: ("deterministic", "likely", None), 5: ("pending", "likely", None)}


def test_one_observation_of_a_job(spark):
    jobs = spark.createDataFrame([(1, "old", "", "", "", datetime(2024, 1, 1))], "job_id int, title string, location string, description string, category string, verified_at timestamp")
    obs = spark.createDataFrame([(1, False, datetime(2024, 3, 1), "c", "x", "", ""), (1, True, datetime(2024, 1, 5), "a", "", "", ""), (1, True, datetime(2024, 2, 1), "b", "y", "", "")], "job_id int, is_official boolean, verified_at timestamp, title string, location string, description string, category string")
    got = linking.merge_canonical(jobs, obs).collect()
    assert [(r.title, r.location, r.verified_at) for r in got] == [("b", "y", datetime(2024, 2, 1))]


def test_names_of_employers_and_places(spark):
    df = spark.createDataFrame([("77-7777356 Default Company for India", "Wells Fargo Bank", "https://wf.wd1.myworkdayjobs.com/WellsFargoJobs/job/pune/1", "111442-IND-BENGALURU-INTL BLR"), (None, "", "https://jobs.acme.com/", None)], "legal string, site string, url string, place string")
    r = df.select(names.brand(F.col("site"), F.col("legal"), names.employer_from_path(F.col("url")), names.employer_from_host(host(F.col("url")))).alias("b"), names.clean_place(F.col("place")).alias("p"), names.place_from_path(F.col("url")).alias("u"), names.company_key(F.col("site")).alias("k")).collect()
    assert [tuple(x) for x in r] == [("Wells Fargo Bank", "Bengaluru, India", "pune, India", "wellsfargobank"), ("acme", "", "", "")]


def test_normal_of_ascii_and_other_texts(spark):
    texts = ["".join(map(chr, range(300))), "A\tB  c", "  ", "", None, "C++ & R/S-T #1 50% (x)_y", "İstanbul Kelvin", "a\u0000b"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9+#.&%/-]+", " "))
    assert df.where(~matching.normal(F.col("text")).eqNullSafe(plain)).count() == 0


def test_requirements_once_a_text_and_repeated_ids(spark):
    """Requirements are looked for once a text, without a window over all of them; rows that share a posting_id are one posting."""
    duties = "Must have 3-5 years of Excel and sql\nMust have 3-5 years of excel and SQL!\nknowledge of the Power  BI"
    rows = [(k, "Risk Analyst", duties, "Pune") for k in range(40)] + [(41, None, None, None), (42, "Audit", "", "!!"), (42, "Audit", "", "Goa"), (43, "Audit", None, "Goa"), (43, "Audit", None, "Goa")]
    jobs = spark.createDataFrame(rows, "posting_id long, title string, description string, location string")
    got = {}
    for r in matching.extract_requirements(jobs).orderBy("posting_id", "no").collect():
        got.setdefault(r.posting_id, []).append((r.no, r.label, r.type))
    want = [(1, "risk", "skill"), (2, "Excel", "skill"), (3, "SQL", "skill"), (4, "Power BI", "skill"), (5, "Must have 3-5 years of Excel and sql", "requirement"), (6, "knowledge of the Power  BI", "responsibility"), (7, "3-5 years", "experience"), (8, "Pune", "location")]
    assert [got[k] for k in range(40)] == [want] * 40
    assert got[42] == [(1, "audit", "skill"), (2, "!!", "location"), (3, "Goa", "location")] and got[43] == [(1, "audit", "skill"), (2, "Goa", "location")] and 41 not in got
    plan = matching.extract_requirements(jobs.where("posting_id < 40"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate [title" in plan
    assert "Aggregate [title" not in matching.judged_once(jobs, ("title",), lambda df: df.withColumn("n", F.length("title")), most=1)._jdf.queryExecution().optimizedPlan().toString()


def test_profile_scores_take_no_window_and_merge_repeated_ids(spark):
    """The lines of a profile are judged within its row; rows that share an id count each other's lines, and rows without id have none."""
    text = "Ana\nSkills:\nBuilt models for 3 clients\n## Projects\nReduced costs by 12%\n \nAwards |"
    people = spark.createDataFrame([(1, text), (2, "Ben"), (2, "Education\r\nLed 4 projects"), (None, text), (3, None), (4, text)], "profile_id long, text string")
    scores = matching.score_profiles(people)
    got = sorted((r.profile_id or 0, r.words, r.sections, r.section_score, r.evidence_score, r.ats_score) for r in scores.collect())
    assert got == [(0, 14, 0, 0, 0, 0), (1, 14, 3, 19, 5, 8), (2, 1, 1, 6, 4, 0), (2, 4, 1, 6, 4, 0), (3, 0, 0, 0, 0, 0), (4, 14, 3, 19, 5, 8)], got
    plan = matching.score_profiles(people.where("profile_id in (1, 4)"))._jdf.queryExecution().toString()
    assert "Window" not in plan and "Exchange" not in plan


def test_model_merge_classifies_each_text_once(spark):
    """The same verdicts as row by row, null texts as empty ones; no side of the join judges postings again."""
    from vacantia.plans import result_queries

    rnd = random.Random(4)
    texts = [(None, "", "Risk Analyst", "Tele caller"), (None, "", "Finance"), (None, "", "Prepare valuation models."), (None, "", "0-2 years experience", "3-8 years preferred"), (None, "", "Pune, India", "London")]
    rows = [(k, *[rnd.choice(t) for t in texts]) for k in range(300)]
    jobs = spark.createDataFrame(rows, "posting_id long, title string, category string, description string, experience_text string, location string")
    once, each = classify.classify_texts(jobs), classify.classify_postings(jobs)
    assert once.columns == each.columns and sorted(map(str, once.collect())) == sorted(map(str, each.collect()))
    plan = result_queries.model_merge(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate inline") == 3
