"""Entity resolution: observations to jobs, merging of fields, merging of feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.functions.urls import canonical_url, host, normal_text
from vacantia.operators.graph import components, with_least
from vacantia.operators.tables import Rounds


def link_observations(obs: DataFrame, jobs: DataFrame, shared_urls: DataFrame | None = None) -> DataFrame:
    """obs with link_status (linked, conflict, pending), job_id and matched_by, within a company, in this order: a job with the same URL and another
    employer id is a conflict; the employer id; one job with a URL (several: conflict); one job with title, place and day (several: conflict).

    obs: obs_id, company, employer_job_id, title, location, posted_at, detail_url, apply_url. jobs: job_id and the same fields.
    shared_urls (url): bundle URLs that identify no job.
    """
    company = normal_text(F.col("company")).alias("_company")
    urls = F.explode(F.array_distinct(F.array_compact(F.array(*[F.when(F.col(c) != "", canonical_url(F.col(c))) for c in ("detail_url", "apply_url")])))).alias("_url")
    left, right = obs.select("obs_id", company, "employer_job_id", urls), jobs.select(F.col("job_id").alias("_job"), company, F.col("employer_job_id").alias("_job_employer_id"), urls)
    if shared_urls is not None:
        left = left.join(shared_urls.select(canonical_url(F.col("url")).alias("_url")).distinct(), "_url", "left_anti")
    clash = F.col("employer_job_id").isNotNull() & F.col("_job_employer_id").isNotNull() & (F.col("employer_job_id") != F.col("_job_employer_id"))
    by_url = left.join(right, ["_company", "_url"]).groupBy("obs_id").agg(F.bool_or(clash).alias("_clash"), F.count_distinct("_job").alias("_n_url"), F.min("_job").alias("_job_url"))
    ids = jobs.where("employer_job_id is not null").groupBy(company, "employer_job_id").agg(F.min("job_id").alias("_job_id"))
    by_id = obs.select("obs_id", company, "employer_job_id").join(ids, ["_company", "employer_job_id"]).select("obs_id", "_job_id")
    print_ = [company, normal_text(F.col("title")).alias("_title"), normal_text(F.col("location")).alias("_place"), F.coalesce(F.to_date("posted_at").cast("string"), F.lit("")).alias("_day")]
    marks = jobs.select("job_id", *print_).groupBy("_company", "_title", "_place", "_day").agg(F.count("*").alias("_n_print"), F.min("job_id").alias("_job_print"))
    by_print = obs.select("obs_id", *print_).join(marks, ["_company", "_title", "_place", "_day"]).select("obs_id", "_n_print", "_job_print")
    all_ = obs.join(by_url, "obs_id", "left").join(by_id, "obs_id", "left").join(by_print, "obs_id", "left")
    cases = (("_clash", "conflict", None, None), ("_job_id is not null", "linked", "_job_id", "employer_job_id"), ("_n_url = 1", "linked", "_job_url", "official_url"), ("_n_url > 1", "conflict", None, None), ("_n_print = 1", "linked", "_job_print", "fingerprint"), ("_n_print > 1", "conflict", None, None))
    case = lambda k, last: "case " + " ".join(f"when {c[0]} then {last(c[k])}" for c in cases) + " end"
    quoted, plain = (lambda x: "null" if x is None else f"'{x}'"), (lambda x: "null" if x is None else x)
    return all_.select(*[obs[c] for c in obs.columns], F.coalesce(F.expr(case(1, quoted)), F.lit("pending")).alias("link_status"), F.expr(case(2, plain)).alias("job_id"), F.expr(case(3, quoted)).alias("matched_by"))


def group_pending(pending: DataFrame) -> DataFrame:
    """(obs_id, new_job): observations that no job matches, grouped by shared employer id, URL or title, place and day within a company; new_job is the smallest
    obs_id that any number of steps over shared keys reaches.
    """
    company = normal_text(F.col("company"))
    mark = lambda kind, *parts: F.md5(F.concat_ws("|", company, F.lit(kind), *parts))
    day = F.coalesce(F.to_date("posted_at").cast("string"), F.lit(""))
    keys = F.array_compact(F.array(F.when(F.col("employer_job_id").isNotNull(), mark("id", F.col("employer_job_id"))), *[F.when(F.col(c) != "", mark("url", canonical_url(F.col(c)))) for c in ("detail_url", "apply_url")], mark("print", normal_text(F.col("title")), normal_text(F.col("location")), day)))
    tables = Rounds(pending.sparkSession, "pending")
    held = tables.write(pending.where("obs_id is not null").select(F.explode(F.array_distinct(keys)).alias("u"), F.col("obs_id").alias("v")), "held")
    # A key that very many hold is looked up, not joined, so that no task has all its rows.
    least = with_least(held, held.count(), shared=True).groupBy("v").agg(F.min("m").alias("r"), F.collect_set("m").alias("ms"))
    # Keys of one observation link nothing. An observation hangs on the least r of its keys' least ones and links these: the rounds have a node for a key, not for an observation.
    leaves = tables.write(least, "leaves")
    roots = tables.write(components(leaves.select(F.col("r").alias("u"), F.explode("ms").alias("v")), tables, "roots").toDF("r", "root").where("root is not null"), "found")
    grouped = _rooted(leaves.select(F.col("v").alias("obs_id"), "r"), roots)
    return pending.select("obs_id").where("obs_id is not null").distinct().join(grouped, "obs_id", "left").select("obs_id", F.coalesce("new_job", "obs_id").alias("new_job"))


def _rooted(leaves: DataFrame, roots: DataFrame) -> DataFrame:
    """leaves (obs_id, r) with new_job: the root of r, or r. Roots of an r that a hundredth of the leaves or more hang on are looked up in a constant, all others joined."""
    hubs = [x.r for x in leaves.groupBy("r").count().where(F.col("count") * 100 >= leaves.count()).collect()]  # a hundred at most
    of_hub = {h: h for h in hubs} | {x.r: x.root for x in roots.where(F.col("r").isin(hubs)).collect()}
    is_hub = F.col("r").isin(hubs)
    rest = leaves.where(~is_hub).join(roots.where(~is_hub), "r", "left").select("obs_id", F.coalesce("root", "r").alias("new_job"))
    if not hubs:
        return rest
    kind = leaves.schema["r"].dataType
    known = F.create_map(*[F.lit(v).cast(kind) for pair in of_hub.items() for v in pair])
    return rest.unionByName(leaves.where(is_hub).select("obs_id", F.element_at(known, F.col("r")).alias("new_job")))


def merge_canonical(jobs: DataFrame, obs: DataFrame) -> DataFrame:
    """jobs with the fields of their linked observation (job_id, is_official, verified_at, fields): an official one that is not older replaces what it has, any other only fills gaps.

    Of several observations of a job the official ones come first, then the newest, then the first by its fields.
    """
    fields = ("title", "location", "description", "category")
    one = F.struct("is_official", F.col("verified_at").alias("_at"), *[F.col(c).alias(f"_{c}") for c in fields])
    new = obs.groupBy("job_id").agg(F.max_by(one, F.struct(F.coalesce("is_official", F.lit(False)), "verified_at", *fields)).alias("_one")).select("job_id", "_one.*")
    replace = F.expr("is_official and (verified_at is null or _at >= verified_at)")
    joined = jobs.join(new, "job_id", "left")
    said = lambda c: F.nullif(F.col(c), F.lit(""))
    chosen = {c: F.when(F.col("is_official").isNull(), F.col(c)).when(replace, F.coalesce(said(f"_{c}"), said(c), F.lit(""))).otherwise(F.coalesce(said(c), said(f"_{c}"), F.lit(""))) for c in fields}
    return joined.select(*[chosen[c].alias(c) if c in chosen else F.when(replace, F.col("_at")).otherwise(F.col(c)).alias(c) if c == "verified_at" else F.col(c) for c in jobs.columns])


def merge_feed(inventory: DataFrame, jobs: DataFrame) -> DataFrame:
    """The inventory's roles, enriched by the job with the same company and URL, then the jobs that no role matches, one of each URL."""
    key = [normal_text(F.col("company")).alias("_company"), canonical_url(F.col("detail_url")).alias("_url")]
    best = jobs.select("job_id", "company", "title", "detail_url", *key).groupBy("_company", "_url").agg(F.min_by(F.struct("job_id", "company", "title", "detail_url"), "job_id").alias("j"))
    roles = inventory.select("role_id", "company", "title", "detail_url", *key)
    enriched = roles.join(best, ["_company", "_url"], "left").select("role_id", F.col("j.job_id").alias("job_id"), "company", F.coalesce(F.nullif("title", F.lit("")), "j.title").alias("title"), "detail_url")
    rest = best.join(roles.select("_company", "_url").distinct(), ["_company", "_url"], "left_anti").select(F.lit(None).cast(inventory.schema["role_id"].dataType).alias("role_id"), "j.job_id", "j.company", "j.title", "j.detail_url")
    return enriched.union(rest)


def employer_domain(jobs: DataFrame, catalog: DataFrame, portals: tuple[str, ...] = ("linkedin.com", "naukri.com", "indeed.com", "foundit.in")) -> DataFrame:
    """jobs with employer_domain: the catalog's host for the company, else the posting's own unless that is a portal's."""
    own = host(F.col("detail_url"))
    portal = F.coalesce(own, F.lit("")).rlike("(?:^|\\.)(?:" + "|".join(p.replace(".", "\\.") for p in portals) + ")$")
    known = catalog.select(normal_text(F.col("name")).alias("_company"), host(F.col("url")).alias("_host")).groupBy("_company").agg(F.min("_host").alias("_host"))
    return jobs.withColumn("_company", normal_text(F.col("company"))).join(known, "_company", "left").withColumn("employer_domain", F.coalesce("_host", F.when(~portal, own))).drop("_company", "_host")
