"""Contacts and outcomes: verdicts on addresses, address patterns and suggestions, signals, applications, questionnaires, roles and portals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.functions import wordlists as w
from vacantia.functions.urls import host
from vacantia.operators.classify import noise, text

# Shared mailboxes, throwaway domains, mail providers.
ROLE_PREFIXES = ("info", "hr", "careers", "jobs", "job", "recruiting", "recruiter", "talent", "support", "contact", "admin", "sales", "hello", "team", "office", "mail", "postmaster", "abuse", "no-reply", "noreply", "webmaster", "help", "service", "enquiry", "enquiries", "inquiries", "notifications", "newsletter", "reply")
THROWAWAY = ("mailinator.com", "yopmail.com", "guerrillamail.com", "guerrillamail.org", "tempmail.com", "temp-mail.org", "10minutemail.com", "throwaway.email", "maildrop.cc", "getnada.com", "nada.email", "trashmail.com", "sharklasers.com", "mozmail.com", "emailondeck.com", "fakeinbox.com", "mailnesia.com", "spamgourmet.com", "dispostable.com", "mailcatch.com", "tempinbox.com", "mytemp.email", "tmail.ws", "inboxbear.com", "discard.email", "spam4.me", "mintemail.com", "mailnull.com", "jetable.org", "mailexpire.com")
PROVIDERS = ((r"google(mail)?\.com$", "Google Workspace"), (r"outlook\.com$", "Microsoft 365"), (r"secureserver\.net$", "GoDaddy"), (r"amazonses\.com$", "AWS WorkMail"), (r"protonmail\.ch$", "Proton"), (r"zoho\.com$", "Zoho"), (r"mail\.ru$", "Mail.ru"))
SIGNAL_TYPES = ("hiring_post", "referral", "event", "other")
APPLICATION_STATES = ("saved", "applied", "interview", "offer", "rejected", "withdrawn")


def local_part(email: Column) -> Column:
    return F.regexp_extract(F.lower(F.trim(email)), r"^(.+)@[^@]+$", 1)


def domain_part(email: Column) -> Column:
    return F.regexp_extract(F.lower(F.trim(email)), r"^.+@([^@]+)$", 1)


def verify_contacts(contacts: DataFrame, mx: DataFrame) -> DataFrame:
    """Adds verdict (invalid_format, role_account, disposable, unknown, domain_no_mx, accepts_mail) and provider.

    mx: domain, hosts (array). A domain that is missing there is unknown; one without hosts takes no mail.
    """
    local, domain = local_part(F.col("email")), domain_part(F.col("email"))
    valid = F.length(F.trim("email")).between(6, 254) & (F.length(local) <= 64) & local.rlike("^[a-z0-9._%+-]+$") & domain.rlike(r"^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)+$")
    prefix = F.regexp_extract(local, "^([^._+-]*)", 1)
    joined = contacts.withColumn("_domain", domain).join(mx.select(F.lower("domain").alias("_domain"), "hosts"), "_domain", "left")
    provider = F.lit(None).cast("string")
    for pattern, name in reversed(PROVIDERS):
        provider = F.when(F.exists("hosts", _ends(pattern)), name).otherwise(provider)
    verdict = F.when(~F.coalesce(valid, F.lit(False)), "invalid_format").when(prefix.isin(*ROLE_PREFIXES), "role_account").when(F.col("_domain").isin(*THROWAWAY), "disposable").when(F.col("hosts").isNull(), "unknown").when(F.size("hosts") == 0, "domain_no_mx").otherwise("accepts_mail")
    return joined.withColumn("verdict", verdict).withColumn("provider", F.when(F.col("verdict") == "accepts_mail", provider)).drop("_domain", "hosts")


def _ends(pattern: str):
    return lambda h: F.lower(h).rlike(pattern)


def address_pattern(name: Column, email: Column) -> Column:
    """Form of the local part in terms of the name, as {first}.{last}; null where they can't be aligned."""
    tokens = F.filter(F.split(F.lower(F.trim(F.coalesce(name, F.lit("")))), r"\s+"), lambda t: t != "")
    first, last = F.get(tokens, F.lit(0)), F.try_element_at(tokens, F.lit(-1))
    local = local_part(email)
    f, n = F.substring(first, 1, 1), F.substring(last, 1, 1)
    parts = F.filter(F.split(local, "[._-]+"), lambda t: t != "")
    marks = F.array_distinct(F.regexp_extract_all(local, F.lit("([._-])"), F.lit(1)))
    head, tail = F.get(parts, F.lit(0)), F.try_element_at(parts, F.lit(-1))
    single = F.when(local == F.concat(f, last), "{f}{last}").when(local == F.concat(first, last), "{first}{last}").when(local == F.concat(first, n), "{first}{l}")
    a = F.when(head == first, "{first}").when(head == f, "{f}")
    b = F.when(tail == last, "{last}").when(tail == n, "{l}")
    mark = F.coalesce(F.get(marks, F.lit(0)), F.lit("."))
    middle = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    many = F.when(a.isNotNull() & b.isNotNull(), F.array_join(F.concat(F.array(a), middle, F.array(b)), "\x01"))
    return F.when((local == "") | (F.size(tokens) < 2) | last.contains(".") | (F.size(marks) > 1), None).when(F.size(parts) < 2, single).otherwise(F.replace(many, F.lit("\x01"), mark))


def learn_patterns(results: DataFrame, own: str | None = None) -> DataFrame:
    """(domain, pattern, n, share, pattern_rank) from delivered and replied results; own: the sender's address, left out."""
    kept = results.where(F.col("result").isin("delivered", "replied"))
    kept = kept if own is None else kept.where(F.lower("email") != own.lower())
    found = kept.select(domain_part(F.col("email")).alias("domain"), address_pattern(F.col("name"), F.col("email")).alias("pattern")).where("domain <> '' and pattern is not null")
    counted = found.groupBy("domain", "pattern").agg(F.count("*").alias("n"))
    share = F.floor(100 * F.col("n") / F.sum("n").over(Window.partitionBy("domain")) + 0.5).cast("int")
    return counted.withColumns({"share": share, "pattern_rank": F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("n"), "pattern"))})


def suggest(people: DataFrame, patterns: DataFrame) -> DataFrame:
    """people (name, domain) with the address that the domain's best pattern gives; domains without samples give none."""
    best = patterns.where("pattern_rank = 1").select("domain", "pattern", "share")
    tokens = F.split(F.lower(F.trim("name")), r"\s+")
    first, last = F.get(tokens, F.lit(0)), F.try_element_at(tokens, F.lit(-1))
    address = F.col("pattern")
    for key, value in (("{first}", first), ("{last}", last), ("{f}", F.substring(first, 1, 1)), ("{l}", F.substring(last, 1, 1))):
        address = F.replace(address, F.lit(key), value)
    return people.join(best, "domain").where(F.size(tokens) >= 2).withColumn("email", F.concat(address, F.lit("@"), F.col("domain")))


def pattern_stats(results: DataFrame) -> DataFrame:
    """(domain, samples, patterns): all samples and the learnt counts as a map."""
    every = results.groupBy(domain_part(F.col("email")).alias("domain")).agg(F.count("*").alias("samples")).where("domain <> ''")
    learnt = learn_patterns(results).groupBy("domain").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("pattern", "n")))).alias("patterns"))
    return every.join(learnt, "domain", "left")


def clean_signals(df: DataFrame) -> DataFrame:
    """Signals with an https URL and a company, unknown types as other, capped texts, the latest of each URL."""
    ok = df.where(F.col("url").startswith("https://") & (F.trim(F.coalesce("company", F.lit(""))) != ""))
    out = ok.select(F.md5("url").alias("signal_id"), "url", F.substring(F.trim("company"), 1, 120).alias("company"), F.when(F.col("type").isin(*SIGNAL_TYPES), F.col("type")).otherwise("other").alias("type"), F.substring(F.coalesce("note", F.lit("")), 1, 500).alias("note"), "at")
    return out.withColumn("_n", F.row_number().over(Window.partitionBy("signal_id").orderBy(F.desc("at"), "company", "type", "note"))).where("_n = 1").drop("_n")


def signals_to_applications(df: DataFrame) -> DataFrame:
    return df.select(F.col("signal_id").alias("application_id"), "company", "url", F.lit("saved").alias("status"), F.lit(False).alias("verified"))


def clean_applications(df: DataFrame) -> DataFrame:
    """Applications with valid states (else saved), confidence in 0-100 and at most 6 follow-ups."""
    return df.withColumns({"status": F.when(F.col("status").isin(*APPLICATION_STATES), F.col("status")).otherwise("saved"), "confidence": F.least(F.greatest("confidence", F.lit(0)), F.lit(100)), "follow_ups": F.slice("follow_ups", 1, 6)})


def followups_due(applications: DataFrame, today: Column) -> DataFrame:
    """(application_id, next_at, due): the earliest unsent follow-up as due, soon (7 days) or later; rows without one are none."""
    next_ = F.array_min(F.transform(F.filter("follow_ups", lambda f: ~f["sent"]), lambda f: f["at"]))
    days = F.datediff(next_, today)
    return applications.select("application_id", next_.alias("next_at"), F.when(next_.isNull(), "none").when(days <= 0, "due").when(days <= 7, "soon").otherwise("later").alias("due"))


def survey_completion(answers: DataFrame, questions: DataFrame, outstanding: int = 6) -> DataFrame:
    """For each respondent: answered, total, percent and the first outstanding prompts. questions: question_id, position, prompt, recommended; a short fixed list.

    The list is one array beside each respondent's set of answers, and what is broadcast is its one row; there is no row for each pair.
    """
    given = answers.where(F.size(F.filter("value", lambda v: F.trim(v) != "")) > 0).groupBy("respondent").agg(F.collect_set("question_id").alias("_done"))
    asked = questions.agg(F.sort_array(F.collect_list(F.struct("position", "question_id", "prompt", "recommended"))).alias("_all"))
    x = answers.select("respondent").distinct().join(given, "respondent", "left").withColumn("_done", F.coalesce("_done", F.array().cast(answers.schema["question_id"].dataType.simpleString().join(("array<", ">"))))).join(F.broadcast(asked))
    open_ = F.filter("_all", lambda q: ~F.array_contains("_done", q["question_id"]))
    n, done = F.size("_all"), F.size("_all") - F.size(open_)
    return x.select("respondent", done.alias("answered"), n.alias("total"), F.size(F.filter(open_, lambda q: q["recommended"])).alias("recommended_open"), F.floor(100 * done / n + 0.5).cast("int").alias("percent"), F.array_join(F.transform(F.slice(open_, 1, outstanding), lambda q: q["prompt"]), "; ").alias("outstanding"))


def role_catalog(inventory: DataFrame) -> DataFrame:
    """All listings with null-safe defaults and a composite id of at most 180 characters."""
    said = lambda c, d: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit(d)).alias(c)
    return inventory.select(F.substring(F.concat_ws(":", F.col("connector_id").cast("string"), F.col("posting_id").cast("string"), F.col("detail_url")), 1, 180).alias("role_id"), "company", said("title", "Untitled role"), said("location", "Location not listed"), said("category", "Uncategorised"), "detail_url", "last_seen_at")


def filter_portal(df: DataFrame) -> DataFrame:
    """Portal listings at home with a finance word and a real title of the field, with an id from type and URL."""
    title = text("title")
    kept = df.where(text("location").rlike(w.INDIA) & ~noise(title) & title.rlike(w.DOMAIN_METADATA))
    return kept.withColumn("portal_id", F.md5(F.concat_ws("|", F.lit("portal"), "detail_url")))


def recent(df: DataFrame, days: int, today: Column, company: str | None = None) -> DataFrame:
    """Postings listed (posted, else first seen) within the days; unknown and future dates pass."""
    listed = F.coalesce("posted_at", "first_seen_at")
    out = df.where(listed.isNull() | (F.datediff(today, listed) <= days))
    return out if company is None else out.where(F.lower("company") == company.lower())


def own_host(df: DataFrame, url: str = "detail_url") -> DataFrame:
    return df.withColumn("host", host(F.col(url)))
