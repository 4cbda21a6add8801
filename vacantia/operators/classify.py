"""Classification of postings: place, field, experience, tier, noise, candidates, exclusions. Native expressions only.

Input columns: title, location, category, department, description, experience_text (strings; null as empty).

Verdicts are added as the one row of an inlined struct: the optimiser keeps such a column whole, so that a filter on a verdict doesn't repeat its
patterns, and pushes filters on earlier columns below it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.functions import wordlists as w
from vacantia.functions.experience import experience_band
from vacantia.operators.tables import judged_once


def text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def first(value: Column, pattern: str) -> Column:
    """The first match, or null."""
    found = F.regexp_extract(value, "(?i)(" + pattern.removeprefix("(?i)") + ")", 1)
    return F.when(found != "", found)


def added(df: DataFrame, struct: Column) -> DataFrame:
    """df and the struct's fields."""
    return df.select(*df.columns, F.inline(F.array(struct)))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def spaced(title: Column) -> Column:
    """Titles often join parts with underscores, which hide word ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(title, "_", " "), r"\s+", " "))


def classify_location(df: DataFrame) -> DataFrame:
    """Adds location_status (india, uncertain, not_india) and location_evidence."""
    place = text("location")

    def judged(f: Column) -> Column:
        status = F.when(f["home"].isNotNull(), "india").when(f["vague"], "uncertain").when(f["other"].isNotNull(), "not_india").otherwise("uncertain")
        return F.struct(status.alias("location_status"), F.when(f["home"].isNotNull(), f["home"]).when(~f["vague"], f["other"]).alias("location_evidence"))

    facts = F.struct(first(place, w.INDIA).alias("home"), first(place, w.OTHER_COUNTRY).alias("other"), (place.rlike(w.UNCERTAIN_REGION) | (F.trim(place) == "")).alias("vague"))
    return added(df, once(facts, judged))


def domain(title: Column, category: Column, description: Column) -> Column:
    """(domain_status: exact, likely or unrelated; domain_evidence). What decides early is tested first."""
    verdict = lambda status, evidence: F.struct(F.lit(status).alias("domain_status"), evidence.alias("domain_evidence"))
    unrelated = verdict("unrelated", F.array().cast("array<string>"))
    found = lambda value: F.array_distinct(F.array_compact(F.array(*[first(value, p) for p in w.CONCEPTS])))
    about = F.concat_ws(" ", title, category)
    out = F.concat_ws(" ", title, description).rlike(w.GENERAL_APPLICATION) | title.rlike(w.OTHER_FIELD_TITLE)

    def by_text(rest: Column) -> Column:
        likely = lambda: once(first(F.concat_ws(" ", about, rest), w.LIKELY), lambda x: F.when(x.isNotNull(), verdict("likely", F.array(x))).otherwise(unrelated))
        return once(found(rest), lambda told: F.when(F.size(told) > 0, verdict("exact", told)).otherwise(likely()))

    told = lambda: F.when(category.rlike(w.OTHER_FIELD_CATEGORY), unrelated).otherwise(once(F.regexp_replace(description, w.EMPLOYER_BOILERPLATE, ""), by_text))
    return F.when(out, unrelated).otherwise(once(found(about), lambda said: F.when(F.size(said) > 0, verdict("exact", said)).otherwise(told())))


def classify_domain(df: DataFrame) -> DataFrame:
    """Adds domain_status and domain_evidence."""
    return added(df, domain(text("title"), text("category"), text("description")))


def extract_experience(df: DataFrame) -> DataFrame:
    """Adds experience_status, minimum_years, maximum_years, experience_evidence."""
    band = experience_band(F.concat_ws("\n", text("experience_text"), text("description")))
    return added(df, band.cast("struct<experience_status:string,minimum_years:double,maximum_years:double,experience_evidence:array<string>>"))


def compose_tier(df: DataFrame) -> DataFrame:
    """Adds match_tier (exact, possible, not_targeted) from the three statuses."""
    place, field, years = F.col("location_status"), F.col("domain_status"), F.col("experience_status")
    off = (place == "not_india") | (field == "unrelated") | (years == "over_two")
    return df.withColumn("match_tier", F.when(off, "not_targeted").when((place == "india") & (field == "exact") & (years == "zero_to_two"), "exact").otherwise("possible"))


def classify_postings(df: DataFrame) -> DataFrame:
    """All four classifications."""
    return compose_tier(extract_experience(classify_domain(classify_location(df))))


def classify_texts(df: DataFrame) -> DataFrame:
    """classify_postings, once for each different combination of texts where these are few; for tables, as the texts are counted first."""
    return judged_once(df, ("title", "category", "description", "experience_text", "location"), classify_postings)


def other_field(title: Column) -> Column:
    return spaced(title).rlike(w.OTHER_FIELD_TITLE) | spaced(title).rlike(w.NOISE_TITLE)


def noise(title: Column) -> Column:
    """Titles of another field, of senior roles, or that are no titles."""
    return other_field(title) | spaced(title).rlike(w.SENIOR_TITLE) | F.trim(title).rlike(w.GARBAGE_TITLE)


def filter_noise(df: DataFrame) -> DataFrame:
    return df.where(~noise(text("title")))


def select_candidates(df: DataFrame, corroborated: DataFrame | None = None, keys: tuple[str, ...] = ("posting_id",)) -> DataFrame:
    """Adds candidate_status (hydrate, defer) and candidate_reasons. corroborated: keys of listings that a portal shows too."""
    title = text("title")
    if corroborated is not None:
        df = df.join(corroborated.select(*keys).distinct().withColumn("_seen", F.lit(True)), list(keys), "left")
    else:
        df = df.withColumn("_seen", F.lit(False))
    about = F.concat_ws(" ", *[F.when(text(c) != "", text(c)) for c in ("title", "category", "department")])
    off = title.rlike(w.CANDIDATE_OTHER_FIELD) | title.rlike(w.CANDIDATE_SENIOR)
    reason = lambda name, test: F.when(test, F.lit(name))
    good = F.array_compact(F.array(reason("finance_metadata", about.rlike(w.DOMAIN_METADATA)), reason("early_career_title", title.rlike(w.EARLY_CAREER)), reason("generic_title", F.trim(title).rlike(w.GENERIC_TITLE)), reason("education_signal", text("description").rlike(w.EDUCATION)), reason("portal_corroborated", F.coalesce("_seen", F.lit(False)))))
    lacking = F.array_compact(F.array(reason("missing_category", F.trim(text("category")) == ""), reason("missing_department", F.trim(text("department")) == "")))
    every = F.slice(F.array_distinct(F.concat(good, lacking)), 1, 12)
    foreign = about.rlike(w.CANDIDATE_OTHER_FIELD)
    status = F.when(off, "defer").when(F.size(every) > 0, "hydrate").when(foreign, "defer").otherwise("hydrate")
    reasons = F.when(off, F.array(F.lit("strong_non_finance_category"))).when(F.size(every) > 0, every).when(foreign, F.array(F.lit("strong_non_finance_category"))).otherwise(F.array(F.lit("insufficient_exclusion_evidence")))
    return df.withColumns({"candidate_status": status, "candidate_reasons": reasons}).drop("_seen")


def exclusion_reason(df: DataFrame) -> DataFrame:
    """Adds exclusion to classified postings: the first reason to leave one out, or match."""
    reason = F.when(F.col("location_status") == "not_india", "not_india").when(F.col("domain_status") == "unrelated", "not_finance").when(F.col("experience_status") == "zero_to_two", "match").when(F.col("experience_status") == "over_two", "experience_over_limit").otherwise("experience_unknown")
    return df.withColumn("exclusion", reason)


def exclusion_counts(df: DataFrame, source: str = "company") -> DataFrame:
    """Postings by source and exclusion."""
    return exclusion_reason(df).groupBy(source, "exclusion").agg(F.count("*").alias("n"))


def job_feed(df: DataFrame, most: int = 2000) -> DataFrame:
    """The serving feed of classified postings: the newest `most` targeted ones, then without noise, judged again without category and by all wording, strictly 0-2 years."""
    open_ = df.where("active and location_status = 'india' and domain_status in ('exact', 'likely') and match_tier in ('exact', 'possible') and experience_status in ('zero_to_two', 'ambiguous')")
    newest = open_.orderBy(F.desc("last_seen_at"), "posting_id").limit(most)
    judged = added(newest.where(~noise(text("title"))), domain(text("title"), F.lit(""), text("description")).cast("struct<_again:string,_why:array<string>>"))
    kept = added(judged.where("_again <> 'unrelated'"), F.struct(experience_band(F.concat_ws("\n", text("title"), text("experience_text"), text("description"))).alias("_band")))
    inside = "({0} is null or {0} between 0 and 2)"
    strict = f"_band.status = 'zero_to_two' and {inside.format('_band.minimum_years')} and {inside.format('_band.maximum_years')} and {inside.format('minimum_years')} and {inside.format('maximum_years')}"
    return kept.where(strict).drop("_again", "_why", "_band")


def ranked(df: DataFrame) -> DataFrame:
    """Adds feed_rank: exact before possible before the rest, newest first seen first. For a feed of bounded size (job_feed): ranks are counted in one task."""
    tier = F.when(F.col("match_tier") == "exact", 0).when(F.col("match_tier") == "possible", 1).otherwise(2)
    return df.withColumn("feed_rank", F.row_number().over(Window.orderBy(tier, F.desc("first_seen_at"), "posting_id")))


def by_score(feed: DataFrame, scores: DataFrame) -> DataFrame:
    """Adds score and score_rank to a feed: best match first, unscored ones last, then the newest listed, then by company. scores: posting_id, score (one row for each posting).

    For a feed of bounded size (job_feed): ranks are counted in one task.
    """
    order = Window.orderBy(F.desc_nulls_last("score"), F.desc_nulls_last("posted_at"), "company", "posting_id")
    return feed.join(scores.select("posting_id", "score"), "posting_id", "left").withColumn("score_rank", F.row_number().over(order))


def whole_feed(roles: DataFrame, portal: DataFrame, imported: DataFrame) -> DataFrame:
    """Merged roles, portal listings and imported links as one feed; origin says which. Columns that one of them lacks are null."""
    every = [df.withColumn("origin", F.lit(name)) for name, df in (("role", roles), ("portal", portal), ("imported", imported))]
    return every[0].unionByName(every[1], allowMissingColumns=True).unionByName(every[2], allowMissingColumns=True)


def candidate_queue(df: DataFrame, newest: int = 2000, most: int = 250) -> DataFrame:
    """Postings that wait for details: of the newest hydrate rows those at home that look right, `most` of them."""
    waiting = df.where("active and candidate_status = 'hydrate'").orderBy(F.desc("last_seen_at"), "posting_id").limit(newest)
    title = text("title")
    looks = (text("location").rlike(w.INDIA)) & ~noise(title) & (F.concat_ws(" ", title, text("category")).rlike(w.DOMAIN_METADATA) | title.rlike(w.EARLY_CAREER))
    return waiting.where(looks).orderBy(F.desc("last_seen_at"), "posting_id").limit(most)


def dedupe(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def audit_sample(df: DataFrame, date: str, n: int, connector: str = "connector_id", listing: str = "posting_id") -> DataFrame:
    """n deferred listings of each connector, the same for a date whatever the order of the input."""
    mark = F.md5(F.concat_ws("|", F.col(connector).cast("string"), F.col(listing).cast("string"), F.lit(date)))
    return df.where("candidate_status = 'defer'").withColumn("sample_rank", F.row_number().over(Window.partitionBy(connector).orderBy(mark, listing))).where(F.col("sample_rank") <= n)


def due_batch(df: DataFrame, n: int, cap: int = 500, connector: str = "connector_id") -> DataFrame:
    """The next n listings to hydrate of each connector, never hydrated first, then the oldest; backlog: what stays of the first `cap`."""
    order = Window.partitionBy(connector).orderBy(F.asc_nulls_first("hydrated_at"), F.desc("last_seen_at"), "posting_id")
    due = df.where("active and candidate_status = 'hydrate'").withColumn("due_rank", F.row_number().over(order)).where(F.col("due_rank") <= cap)
    return due.withColumn("backlog", F.greatest(F.count("*").over(Window.partitionBy(connector)) - n, F.lit(0))).where(F.col("due_rank") <= n)
