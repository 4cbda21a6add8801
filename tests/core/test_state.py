import random
from datetime import datetime

from pyspark.sql import functions as F

from vacantia.functions.urls import canonical_url, pick_apply_url
from vacantia.operators import contacts, coverage, lifecycle, linking, matching
from vacantia.sources import extract
from vacantia.streaming.store import KeyedStore, Merge

T = lambda d, h=0, m=0: datetime(2026, 8, d, h, m)


def test_urls(spark):
    rows = [("HTTPS://A.com/x//?utm_source=1&b=2&ref=z#f", "https://a.com/x?b=2"), ("https://a.com", "https://a.com/"), ("https://a.com/?SRC=1", "https://a.com/"), (" not a url/ ", "not a url")]
    got = spark.createDataFrame([(r[0],) for r in rows], "u string").select(canonical_url(F.col("u"))).collect()
    assert [r[0] for r in got] == [r[1] for r in rows]
    assert spark.createDataFrame([("https://a.com/jobs/", None, "https://a.com/jobs/7")], "a string, b string, c string").select(pick_apply_url(F.col("a"), F.col("b"), F.col("c"))).first()[0] == "https://a.com/jobs/7"


def test_snapshot_write_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", T(1), T(1)), (2, "b", T(1), T(1))], "k int, v string, first_seen_at timestamp, last_seen_at timestamp")
    store = KeyedStore(spark, str(tmp_path), "k int, v string, first_seen_at timestamp, last_seen_at timestamp", ["k"], Merge(("last_seen_at",), ("first_seen_at",), ("last_seen_at",)), buckets=2)
    new = spark.createDataFrame([(2, "B", T(3), T(3)), (3, "c", T(3), T(3))], rows.schema)
    want = [(1, "a", T(1), T(1)), (2, "B", T(1), T(3)), (3, "c", T(3), T(3))]
    store.upsert(rows, 0)
    store.upsert(new, 1)
    assert sorted(map(tuple, store.rows().collect())) == want
    store.upsert(new, 2)  # the same rows again, as a batch of their own
    assert sorted(map(tuple, store.rows().collect())) == want


def test_misses(spark):
    s = spark.createDataFrame([(1, 10, 1), (1, 11, 3), (1, 12, 4), (2, 20, 1)], "connector_id int, listing_id int, run_no int")
    r = spark.createDataFrame([(1, 2, True), (1, 3, False), (1, 4, True), (2, 2, False)], "connector_id int, run_no int, complete boolean")
    assert {x.listing_id: (x.misses, x.active) for x in lifecycle.miss_counts(s, r).collect()} == {10: (2, False), 11: (1, True), 12: (0, True), 20: (0, True)}


def test_linking(spark):
    job = "job_id int, company string, employer_job_id string, title string, location string, posted_at timestamp, detail_url string, apply_url string"
    jobs = spark.createDataFrame([(1, "A & B", "E1", "Analyst", "Pune", T(1), "https://x.com/1?utm_a=1", None), (2, "A and B", None, "Clerk", "Pune", T(2), "https://x.com/2", None), (3, "A and B", None, "Clerk", "Pune", T(2), "https://x.com/3", None), (4, "Other", "E1", "Analyst", "Pune", T(1), "https://x.com/1", None)], job)
    obs = spark.createDataFrame([(1, "a and b", "E1", "x", "y", None, "", ""), (2, "A&B", "E9", "x", "y", None, "https://x.com/1", ""), (3, "A&B", None, "x", "y", None, "https://X.com/2/", ""), (4, "A&B", None, "x", "y", None, "https://x.com/2", "https://x.com/3"), (5, "A&B", None, "CLERK", "Pune!", T(2), "", ""), (6, "A&B", None, "analyst", "pune", T(1), None, None), (7, "A&B", None, "nothing", "", None, None, None)], job.replace("job_id int", "obs_id int"))
    got = {r.obs_id: (r.link_status, r.job_id, r.matched_by) for r in linking.link_observations(obs, jobs).collect()}
    assert got == {1: ("linked", 1, "employer_job_id"), 2: ("conflict", None, None), 3: ("linked", 2, "official_url"), 4: ("conflict", None, None), 5: ("conflict", None, None), 6: ("linked", 1, "fingerprint"), 7: ("pending", None, None)}
    shared = spark.createDataFrame([("https://x.com/2",)], "url string")
    assert {r.obs_id: r.link_status for r in linking.link_observations(obs, jobs, shared).collect()}[3] == "pending"


def test_extraction(spark):
    raw = "connector_id string, page_no int, url string, body string"
    body = '{"jobs": [{"id": 1, "t": "Analyst", "u": "https://a/1", "loc": "Pune, India"}, {"id": 1, "t": "Again", "u": "https://a/1", "loc": "Pune, India"}, {"id": 2, "t": "", "u": "x", "loc": "Pune"}, {"id": 3, "t": "Chef", "u": "https://a/3", "loc": "Paris"}]}'
    df = spark.createDataFrame([("g", 1, "u", body), ("g", 2, "u", "not json")], raw)
    got = extract.extract_json_listings(df, {"g": {"items": "$.jobs", "source_external_id": "$.id", "title": "$.t", "detail_url": "$.u", "location": "$.loc"}}).collect()
    assert [(r.source_external_id, r.title) for r in got] == [("1", "Analyst")]
    html = "<li class=card data-id='7'><a href='/j/7'>Tax &amp; Audit</a></li><li class=card data-id='8'><a href='/j/8'>Clerk</a></li>"
    h = extract.extract_html_listings(spark.createDataFrame([("h", 1, "u", html)], raw), {"h": {"card": "(?s)<li class=card.*?</li>", "source_external_id": "data-id='([^']*)'", "title": "<a[^>]*>(.*?)</a>", "detail_url": "href='([^']*)'"}})
    assert {(r.source_external_id, r.title) for r in h.collect()} == {("7", "Tax & Audit"), ("8", "Clerk")}
    ld = "<script type='application/ld+json'>{\"@graph\": [{\"@type\": \"JobPosting\", \"title\": \"A\"}, {\"@type\": \"Person\"}]}</script><script type='application/ld+json'>{bad</script><script type='application/ld+json'>[{\"@type\": [\"JobPosting\"], \"title\": \"B\"}]</script>"
    pages = spark.createDataFrame([(1, "https://x.com/jobs/tax-analyst", ld), (2, "https://x.com/jobs/tax-analyst", "<title> T </title>"), (3, "https://x.com/jobs/tax-analyst.html", None)], "page_id int, url string, html string")
    assert extract.extract_jsonld(pages).count() == 2
    assert {r.page_id: (r.title, r.source, r.confidence) for r in extract.extract_page_records(pages).collect()} == {1: ("A", "jsonld", "high"), 2: ("T", "title", "low"), 3: ("tax analyst", "url", "low")}
    md = spark.createDataFrame([(1, "[Home](/h) India\n[Tax Analyst](/t)\nPune\n[Other](/o)\nParis")], "doc_id int, text string")
    assert [(r.title, r.link, r.place) for r in extract.extract_markdown_links(md).collect()] == [("Tax Analyst", "/t", "Pune")]
    live = spark.createDataFrame([(404, "u", "", None), (200, "u", "x" * 300, "application/json"), (200, "https://a.com/j/1", "<title>Position has been closed</title>" + "y " * 300, "text/html"), (200, "https://a.com/j/1", "hi", None), (200, "https://a.com/jobs/", "y " * 300, None), (200, "https://a.com/j/1", "y " * 300, None), (None, "u", "", None), (403, "u", "", None)], "http_status int, final_url string, body string, content_type string")
    assert [r.verdict for r in extract.posting_liveness(live).collect()] == ["closed", "open", "closed", "unknown", "unknown", "open", "unknown", "unknown"]


def test_contacts(spark):
    people = spark.createDataFrame([("info@a.com",), ("x@yopmail.com",), ("bad@",), ("joe@a.com",), ("joe@none.com",), ("joe@empty.com",)], "email string")
    mx = spark.createDataFrame([("a.com", ["aspmx.l.google.com"]), ("empty.com", [])], "domain string, hosts array<string>")
    got = {r.email: (r.verdict, r.provider) for r in contacts.verify_contacts(people, mx).collect()}
    assert got == {"info@a.com": ("role_account", None), "x@yopmail.com": ("disposable", None), "bad@": ("invalid_format", None), "joe@a.com": ("accepts_mail", "Google Workspace"), "joe@none.com": ("unknown", None), "joe@empty.com": ("domain_no_mx", None)}
    forms = [("Ana Moss", "ana.moss@x.com", "{first}.{last}"), ("Ana Moss", "amoss@x.com", "{f}{last}"), ("Ana Moss", "ana_m@x.com", "{first}_{l}"), ("Ana Moss", "ana.b.moss@x.com", "{first}.b.{last}"), ("Ana Moss", "ana.moss_x@x.com", None), ("Ana", "ana@x.com", None), ("Ana Moss Jr.", "ana.moss@x.com", None), ("Ana Moss", "other@x.com", None)]
    df = spark.createDataFrame([(n, e) for n, e, _ in forms], "name string, email string").select(contacts.address_pattern(F.col("name"), F.col("email")))
    assert [r[0] for r in df.collect()] == [f[2] for f in forms]


def test_profiles(spark):
    text = "Ana Moss\nExperience\n- Built Excel models for 3 clients\nSkills\nExcel, R"
    lines = matching.assign_sections(matching.profile_lines(spark.createDataFrame([(1, text), (2, None)], "profile_id int, text string")))
    assert [(r.line.split()[0], r.section) for r in lines.orderBy("pos").collect()] == [("Ana", "other"), ("Experience", "experience"), ("-", "experience"), ("Skills", "skills"), ("Excel,", "skills")]
    proven = lines.where("line like '- Built%'").select("profile_id", "line_id")
    kept, lost = matching.tailor_profile(lines.select("profile_id", "pos", "line", "line_id"), proven)
    assert kept.count() == 5 and lost.count() == 0
    assert spark.createDataFrame([("Excel & R, financial modelling",)], "t string").select(matching.terms_in(F.col("t"))).first()[0] == ["financial modeling", "Excel"]
    draft = matching.profile_lines(spark.createDataFrame([(1, "Dear Hiring Manager,\nBuilt Excel models for 3 clients\nWon a prize")], "profile_id int, text string"))
    assert [r.line for r in matching.verify_claims(draft, lines).collect()] == ["Won a prize"]


def test_coverage_and_diagnostics(spark):
    rows = [(1, 1, "watch", "complete", T(1), None), (2, 1, "reconcile", "failed", T(2), "boom"), (3, 2, "reconcile", "complete", T(2), None)]
    runs = spark.createDataFrame([(*r, 10, 5, 3, 2, 1, 0) for r in rows], "run_id int, connector_id int, run_type string, status string, finished_at timestamp, error_text string, reported_total int, listings_discovered int, details_due int, details_fetched int, apply_urls_resolved int, backlog int")
    got = {r.connector_id: (r.latest_status, r.last_complete_watch_at, r.anomaly_summary) for r in coverage.coverage(runs).collect()}
    assert got == {1: ("failed", T(1), "boom"), 2: ("complete", None, None)}
    n = lambda k: spark.createDataFrame([(1, "u" if i % 2 else "") for i in range(k)], "run_id int, apply_url string")
    d = coverage.run_diagnostic(n(5), n(4), n(3), n(1)).first()
    assert (d.candidates_selected, d.details_due, d.details_fetched, d.details_backlogged, d.apply_urls_resolved, d.jobs_created, d.hydration_status) == (5, 4, 3, 1, 1, 1, "partial")


def test_observations_and_signals(spark):
    listings = spark.createDataFrame([("a", "1", "Analyst", "https://x/1"), ("a", "2", "Clerk", "https://x/2"), ("a", "3", "", "https://x/3")], "connector_id string, source_external_id string, title string, detail_url string")
    details = spark.createDataFrame([("a", "1", "text", None), ("a", "2", "  ", None), ("a", "3", "text", None)], "connector_id string, source_external_id string, description string, apply_url string")
    good, bad = extract.build_observations(listings, details)
    assert [r.source_external_id for r in good.collect()] == ["1"]
    assert {r.source_external_id: list(r.missing) for r in bad.collect()} == {"2": ["description"], "3": ["title"]}
    signals = contacts.clean_signals(spark.createDataFrame([("https://a", "Co", "odd", None, T(1)), ("https://a", "Co", "event", "n", T(2)), ("http://b", "Co", "event", "n", T(2)), ("https://c", " ", "event", "n", T(2))], "url string, company string, type string, note string, at timestamp"))
    assert [(r.url, r.type, r.at) for r in signals.collect()] == [("https://a", "event", T(2))]
    assert [(r.status, r.verified) for r in contacts.signals_to_applications(signals).collect()] == [("saved", False)]


def test_pending_groups_and_feed_merge(spark):
    obs = spark.createDataFrame([(1, "A", "E1", "x", "p", T(1), "https://x.com/1", ""), (2, "A", "E1", "y", "q", T(2), "https://x.com/2", ""), (3, "A", None, "z", "r", T(3), "https://x.com/2/", ""), (4, "B", "E1", "x", "p", T(1), "https://x.com/1", "")], "obs_id int, company string, employer_job_id string, title string, location string, posted_at timestamp, detail_url string, apply_url string")
    assert {r.obs_id: r.new_job for r in linking.group_pending(obs).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_pending_chains_of_any_length(spark):
    schema = "obs_id int, company string, employer_job_id string, title string, location string, posted_at timestamp, detail_url string, apply_url string"
    chain = [(1 + 7 * i % 41, "A", None, f"t{i}", "p", T(1), f"https://x.com/{i}", f"https://x.com/{i + 1}") for i in range(41)]
    alone = [(100, "A", None, "other", "p", T(1), "https://x.com/other", ""), (101, "B", None, "t1", "p", T(1), "https://x.com/1", "")]
    got = {r.obs_id: r.new_job for r in linking.group_pending(spark.createDataFrame(chain + alone, schema)).collect()}
    assert got == {**{i: 1 for i in range(1, 42)}, 100: 100, 101: 101}
    assert linking.group_pending(spark.createDataFrame([], schema)).count() == 0


def test_lifecycle(spark):
    sources = spark.createDataFrame([(1, "c", "a", True), (2, "c", "b", True), (3, "d", "x", False), (4, "d", "y", True)], "job_id int, connector_id string, listing_id string, active boolean")
    inventory = spark.createDataFrame([("c", "a", True)], "connector_id string, listing_id string, active boolean")
    jobs = spark.createDataFrame([(1, T(1)), (2, None), (3, None), (4, T(1)), (5, T(1))], "job_id int, closed_at timestamp")
    got = {r.job_id: r.closed_at for r in lifecycle.reconcile_lifecycle(sources, inventory, jobs, "c", F.lit(T(9))).collect()}
    # The second job's source has no row in the inventory and stays as it is.
    assert got == {1: None, 2: None, 3: None, 4: None, 5: T(1)}
    gone = spark.createDataFrame([("c", "a", True), ("c", "b", False), ("d", "y", False)], inventory.schema)
    runs = spark.createDataFrame([(1, "c", "reconcile", "complete", T(8)), (2, "d", "reconcile", "complete", T(7)), (3, "d", "reconcile", "partial", T(8)), (4, "d", "watch", "complete", T(9))], "run_id int, connector_id string, run_type string, status string, finished_at timestamp")
    close = lambda connectors: {r.job_id: r.closed_at for r in lifecycle.reconcile_lifecycle(sources, gone, jobs, connectors, F.lit(T(9))).collect()}
    assert close(lifecycle.complete_connectors(runs)) == {1: None, 2: T(9), 3: None, 4: None, 5: T(1)}  # the last run of d was partial
    assert close(lifecycle.complete_connectors(runs, F.lit(2))) == {1: None, 2: None, 3: T(9), 4: T(1), 5: T(1)}
    assert close(lifecycle.complete_connectors(runs, F.lit(3))) == close(lifecycle.complete_connectors(runs, F.lit(4))) == {1: None, 2: None, 3: None, 4: None, 5: T(1)}


def test_misses_against_brute_force(spark):
    r = random.Random(1)
    seen = [(r.randrange(4), r.randrange(30), r.randrange(40)) for _ in range(300)]
    runs = [(c, k, r.random() < 0.3) for c in range(5) for k in range(45) if r.random() < 0.8]
    got = lifecycle.miss_counts(spark.createDataFrame(seen, "connector_id int, listing_id int, run_no int"), spark.createDataFrame(runs + runs[:20], "connector_id int, run_no int, complete boolean"), limit=5)
    last = {}
    for c, l, k in seen:
        last[c, l] = max(last.get((c, l), -1), k)
    want = {(c, l, k, min(5, len({n for d, n, full in runs if d == c and full and n > k}))) for (c, l), k in last.items()}
    assert {tuple(x)[:4] for x in got.collect()} == want and all(x.active == (x.misses < 5) for x in got.collect())


def test_presented_health(spark):
    sources = spark.createDataFrame([(1, "s1", "c", True, T(3), "", True), (1, "s2", "d", False, T(5), "", False), (2, "s3", "e", False, None, "", True)], "job_id int, source_id string, connector_id string, is_official boolean, verified_at timestamp, apply_url string, active boolean")
    runs = spark.createDataFrame([("c", "watch", "complete", T(1)), ("c", "watch", "partial", T(6)), ("d", "reconcile", "complete", T(2)), ("x", "watch", "failed", T(9))], "connector_id string, run_type string, status string, finished_at timestamp")
    jobs = spark.createDataFrame([(1,), (2,), (3,)], "job_id int").selectExpr("job_id", "'india' location_status", "'exact' domain_status", "'zero_to_two' experience_status", "0.0D minimum_years", "2.0D maximum_years")
    got = {r.job_id: (r.watch_fresh_at, r.reconcile_fresh_at, r.health, r.newest_verified_at, len(r.sources)) for r in coverage.present_jobs(jobs, sources, runs).collect()}
    assert got == {1: (T(1), T(2), "partial", T(3), 1), 2: (None, None, "unknown", None, 1), 3: (None, None, "unknown", None, 0)}
    assert coverage.snapshot_at(sources, runs).first()[0] == T(6)


def test_boards_of_many_connectors_are_read_once(spark):
    raw = spark.createDataFrame([(f"c{k}", 1, "u", f'{{"j{k}": [{{"id": {k}, "t": "T{k}", "u": "https://a/{k}"}}]}}') for k in range(60)] + [("none", 1, "u", "{}")], "connector_id string, page_no int, url string, body string")
    mapping = {f"c{k}": {"items": f"$.j{k}", "source_external_id": "$.id", "title": "$.t", "detail_url": "$.u"} for k in range(55)} | {"bad": {"title": "$.t"}}
    got = extract.extract_json_listings(raw, mapping)
    assert {r.title for r in got.collect()} == {f"T{k}" for k in range(55)} and got.first().category is None
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and len(plan) < 20_000


def test_groups_of_pending_have_a_node_for_a_key(spark, few_partitions, monkeypatch):
    """The rounds link the least observations of shared keys: many observations of few keys, and alone ones, add no nodes."""
    rnd, seen = random.Random(6), []
    rows = [(k, "Co", f"E{rnd.randrange(12)}" if k % 3 else None, f"T{rnd.randrange(400)}", "", None, f"https://x.example.com/{rnd.randrange(30)}" if k % 5 else "", "") for k in range(600)] + [(None, "Co", "E1", "T", "", None, "", "")]
    obs = spark.createDataFrame(rows, "obs_id long, company string, employer_job_id string, title string, location string, posted_at timestamp, detail_url string, apply_url string")
    plain = linking.components
    monkeypatch.setattr(linking, "components", lambda edges, *rest: seen.append(edges.selectExpr("u as x").union(edges.selectExpr("v")).distinct().count()) or plain(edges, *rest))
    got = {r.obs_id: r.new_job for r in linking.group_pending(obs).collect()}
    root, by = list(range(600)), {}
    for r in rows[:600]:
        for key in (("e", r[2]) if r[2] else None, ("t", r[3]), ("u", r[6]) if r[6] else None):
            by.setdefault(key, []).append(r[0]) if key else None
    find = lambda k: k if root[k] == k else find(root[k])
    for ids in by.values():
        for a in ids[1:]:
            x, y = sorted((find(ids[0]), find(a)))
            root[y] = x
    assert got == {k: find(k) for k in range(600)}
    shared = sum(len(ids) > 1 for ids in by.values())
    assert seen and seen[0] <= shared < 300
