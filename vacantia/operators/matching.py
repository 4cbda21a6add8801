"""Profiles against postings: lines, sections, terms, requirements, evidence, scores, letters."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.operators.tables import Rounds, judged_once

# Terms in their groups, their other spellings, section headings and signal words.
TERM_GROUPS = {
    "finance": ("financial analysis", "financial modeling", "financial reporting", "financial statements", "finance", "accounting", "audit", "credit", "risk", "investment", "investment research", "equity research", "portfolio", "treasury", "valuation", "fund accounting", "trade operations", "reconciliation", "capital markets", "fp&a", "budgeting", "forecasting", "variance analysis", "ratio analysis", "corporate finance", "accounts payable", "accounts receivable", "bookkeeping", "taxation", "compliance", "aml", "kyc"),
    "tools": ("Excel", "SQL", "Python", "Power BI", "Tableau", "VBA", "Bloomberg", "Alteryx", "R", "SAS", "SAP", "Oracle", "PowerPoint", "MATLAB", "C++", "Java", "AWS", "Azure", "GCP", "Docker", "Git"),
    "business": ("stakeholder management", "communication", "presentation", "project management", "process improvement", "business analysis", "data analysis", "research", "reporting", "operations", "strategy"),
    "credentials": ("MBA", "PGDM", "CFA", "CA", "CPA", "FRM", "ACCA", "commerce", "economics", "finance degree", "bachelor", "master", "degree"),
}
TERM_ALIASES = {
    "financial modeling": ("financial modeling", "financial modelling"),
    "financial analysis": ("financial analysis", "financial analyst"),
    "financial reporting": ("financial reporting", "financial reports"),
    "financial statements": ("financial statements", "financial statement"),
    "Excel": ("excel", "ms excel", "microsoft excel"),
    "Power BI": ("power bi", "powerbi"),
    "PowerPoint": ("powerpoint", "power point"),
    "data analysis": ("data analysis", "data analytics"),
    "stakeholder management": ("stakeholder management", "stakeholder communication"),
}
SECTIONS = (
    ("summary", r"(?i)^(?:professional )?summary|profile|objective|about me$"),
    ("experience", r"(?i)^(?:professional )?experience|work experience|employment|internship"),
    ("education", r"(?i)^education|academic background|qualifications"),
    ("skills", r"(?i)^(?:technical |core |key )?skills|technologies|competencies|tools"),
    ("projects", r"(?i)^projects?|selected projects|academic projects"),
    ("certifications", r"(?i)^certifications?|licenses"),
    ("achievements", r"(?i)^achievements?|awards?|honors?|leadership|positions? of responsibility"),
)
ACTION = r"(?i)\b(?:built|created|designed|developed|implemented|automated|analysed|analyzed|improved|reduced|increased|delivered|managed|led|coordinated|launched|researched|modelled|modeled|validated|optimised|optimized|supported|owned|streamlined|measured|trained)\b"
QUANTIFIED = r"(?i)(?:\b[0-9]+(?:\.[0-9]+)?\s?%|[$₹€£]\s?[0-9,]+|\b[0-9]+(?:\.[0-9]+)?\s?(?:x|users?|customers?|projects?|hours?|days?|months?|years?|items?|records?|pages?)\b|\b(?:million|thousand|crore|lakh)\b)"
CUE = r"(?i)\b(?:must|required|minimum|qualification|proficiency|experience with|knowledge of|familiarity with|responsible for|responsibilities include)\b"
TEMPLATE = r"(?i)(?:^|\s)(?:dear hiring manager|please consider my application for the|my profile contains documented evidence|relevant evidence from my profile|i would welcome the opportunity|thank you for your consideration|regards|profile line b[0-9a-f]+|\[your name\])(?:$|[.,;:\s])"
FAMILIES = (
    ("FP&A / planning", ("fp&a", "budgeting", "forecasting", "variance analysis", "financial planning")),
    ("financial analysis", ("financial analyst", "financial analysis", "financial modeling", "valuation")),
    ("accounting / finance operations", ("accounting", "reconciliation", "accounts payable", "accounts receivable", "bookkeeping", "audit")),
    ("risk and credit", ("credit", "credit risk", "risk analysis", "underwriting", "aml", "kyc")),
    ("research / investments", ("investment research", "equity research", "portfolio", "capital markets", "investment")),
)


#: ASCII characters that no word has, as they are after lower().
_BETWEEN = "".join(c for c in map(chr, range(128)) if c not in "abcdefghijklmnopqrstuvwxyz0123456789+#.&%/-")


def normal(value: Column) -> Column:
    """Words in lower case with one space between them. Texts of ASCII alone are translated, which takes a quarter of the pattern's time."""
    low = F.lower(F.coalesce(value, F.lit("")))
    slow = F.regexp_replace(low, "[^a-z0-9+#.&%/-]+", " ")
    return F.trim(_let(F.translate(low, _BETWEEN, " " * len(_BETWEEN)), lambda t: F.when(F.octet_length(t) == F.length(t), F.regexp_replace(t, "  +", " ")).otherwise(slow)))


def _norm(term: str) -> str:
    return term.lower()


def _terms(groups: tuple[str, ...] | None = None) -> list[tuple[str, str, tuple[str, ...]]]:
    """(group, term, normal variants of two letters or more), each term once."""
    seen, out = set(), []
    for g, terms in TERM_GROUPS.items():
        for t in terms:
            if t not in seen and (groups is None or g in groups):
                seen.add(t)
                out.append((g, t, tuple(v for v in map(_norm, TERM_ALIASES.get(t, (t,))) if len(v) > 1)))
    return out


def terms_in(value: Column, groups: tuple[str, ...] | None = None) -> Column:
    """The terms (with aliases) that stand in a text as whole words, in list order. Each spelling is one search over the bytes of the normal text."""

    def found(padded: Column) -> Column:
        has = lambda vs: reduce(lambda a, b: a | b, [padded.contains(f" {v} ") for v in vs])
        return F.array_compact(F.array(*[F.when(has(vs), F.lit(t)) for _, t, vs in _terms(groups) if vs]))

    return _let(F.concat(F.lit(" "), normal(value), F.lit(" ")), found)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _line(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"[ \t\x{A0}]+", " "))


def _section(line: Column) -> Column:
    """The section that a line is the heading of, or null."""
    head = F.trim(F.regexp_replace(F.regexp_replace(line, r"^#+\s*", ""), r"[:|]+$", ""))
    any_ = "(?i)" + "|".join(p.removeprefix("(?i)") for _, p in SECTIONS)
    return _let(head, lambda h: F.when(h.rlike(any_), F.coalesce(*[F.when(h.rlike(p), F.lit(s)) for s, p in SECTIONS])))


def profile_lines(profiles: DataFrame, id_col: str = "profile_id", text_col: str = "text") -> DataFrame:
    """(id, pos, line, line_id): the non-empty lines of each text; line_id depends on the words alone."""
    rows = profiles.select(id_col, F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\r?\n")).alias("pos", "line"))
    rows = rows.withColumn("line", _line(F.col("line"))).where("line <> ''")
    return rows.withColumn("line_id", F.md5(normal(F.col("line"))))


def assign_sections(lines: DataFrame, id_col: str = "profile_id") -> DataFrame:
    """Adds is_heading and section: each line belongs to the last heading above it, or to other."""
    w = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("_s", _section(F.col("line"))).withColumns({"is_heading": F.col("_s").isNotNull(), "section": F.coalesce(F.last("_s", ignorenulls=True).over(w), F.lit("other"))}).drop("_s")


def tag_skills(df: DataFrame, text: Column, most: int | None = None) -> DataFrame:
    """Adds skills, in list order."""
    found = terms_in(text)
    return df.withColumn("skills", found if most is None else F.slice(found, 1, most))


def _half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def _said(text: Column) -> Column:
    """(_named, actions, quantified) of a text's lines: the sections that have a heading, and how many lines tell of actions and of amounts. A heading is a line of its own section, so no line has to be assigned."""
    count = lambda lines, pattern: F.size(F.filter(lines, lambda v: v.rlike(pattern))).cast("long")
    named = lambda lines: F.array_distinct(F.array_compact(F.transform(lines, _section)))
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), _line), lambda v: v != "")
    return _let(lines, lambda v: F.struct(named(v).alias("_named"), count(v, ACTION).alias("actions"), count(v, QUANTIFIED).alias("quantified")))


def _by_id(own: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """own (with the `ids`), where rows that share an id count the lines of all of them, and rows without id none."""
    repeated = Rounds(own.sparkSession, "repeated").write(ids.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col), "ids")
    single = own.withColumns({"_named": F.when(F.col(id_col).isNotNull(), F.col("_named")).otherwise(F.array().cast("array<string>")), **{c: F.when(F.col(id_col).isNotNull(), F.col(c)).otherwise(0) for c in ("actions", "quantified")}})
    if repeated.isEmpty():
        return single
    several = own.join(repeated, id_col, "left_semi")
    sums = several.groupBy(id_col).agg(F.array_distinct(F.flatten(F.collect_list("_named"))).alias("_named"), F.sum("actions").alias("actions"), F.sum("quantified").alias("quantified"))
    return single.join(repeated, id_col, "left_anti").unionByName(several.drop("_named", "actions", "quantified").join(sums, id_col))


def score_profiles(profiles: DataFrame, id_col: str = "profile_id", text_col: str = "text") -> DataFrame:
    """Readiness of each profile: sub-scores and their sum, 100 at most; null without words."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    words = lambda n: F.when(n == "", 0).otherwise(F.size(F.split(n, " ")))
    own = profiles.select(id_col, _let(normal(t), words).alias("words"), F.size(terms_in(t)).alias("n_skills"), t.rlike(r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}").alias("_mail"), t.rlike(r"\+?[0-9][0-9 ()-]{8,}[0-9]").alias("_phone"), t.rlike(r"(?i)linkedin\.com/").alias("_in"), F.inline(F.array(_said(t))))
    x = _by_id(own, profiles.select(id_col), id_col).withColumns({"sections": F.size("_named"), "_skills": F.array_contains("_named", "skills"), "_work": F.arrays_overlap("_named", F.array(F.lit("experience"), F.lit("projects")))})
    flag = lambda c, n: F.when(F.col(c), n).otherwise(0)
    x = x.withColumns({
        "section_score": F.least(F.lit(25), _half_up(F.col("sections") / 4 * 25)),
        "content_score": F.least(F.lit(25), _half_up(F.least(F.col("words") / 450, F.lit(1.0)) * 25)),
        "evidence_score": F.least(F.lit(20), _half_up(F.least("actions", F.lit(8)) / 8 * 12 + F.least("quantified", F.lit(4)) / 4 * 8)),
        "contact_score": flag("_mail", 7) + flag("_phone", 5) + flag("_in", 3),
        "ats_score": F.when(F.col("n_skills") > 2, 7).when(F.col("n_skills") > 0, 4).otherwise(0) + flag("_skills", 4) + flag("_work", 4),
    })
    total = F.least(F.lit(100), F.col("section_score") + F.col("content_score") + F.col("evidence_score") + F.col("contact_score") + F.col("ats_score"))
    return x.withColumn("score", F.when(F.col("words") > 0, total)).select(id_col, "words", "sections", "section_score", "content_score", "evidence_score", "contact_score", "ats_score", "score")


def letter_requirement(description: Column) -> Column:
    """required, optional, mentioned, not_mentioned or unknown."""
    said = F.coalesce(F.get(F.filter(F.split(description, r"(?<=[.])|\n"), lambda v: v.rlike(r"(?i)cover letter|covering letter|motivation letter|letter of motivation")), F.lit(0)), F.lit(""))
    return F.when(F.trim(F.coalesce(description, F.lit(""))) == "", "unknown").when(said == "", "not_mentioned").when(said.rlike(r"(?i)\b(?:required|must|mandatory|please (?:submit|include|attach)|submit .*cover)"), "required").when(said.rlike(r"(?i)\boptional\b"), "optional").otherwise("mentioned")


_REQUIREMENTS = "array<struct<label:string,type:string,priority:string,terms:array<string>>>"


def _requirements(title: Column, description: Column, place: Column) -> Column:
    """All requirements of one posting, in order."""
    text = F.concat_ws("\n", title, description)
    row = lambda label, kind, priority, terms: F.struct(label.alias("label"), F.lit(kind).alias("type"), F.lit(priority).alias("priority"), terms.alias("terms"))
    signal = F.transform(terms_in(text, ("finance", "tools", "business")), lambda t: row(t, "skill", "signal", F.array(t)))
    cleaned = F.transform(F.split(description, "\n"), lambda v: F.substring(F.trim(F.regexp_replace(v, r"^[•*\-–—0-9.)]+\s*", "")), 1, 220))
    cue = F.slice(F.filter(cleaned, lambda v: (F.length(v) > 12) & v.rlike(CUE)), 1, 8)
    must = r"(?i)\b(?:must|required|minimum)\b"
    line = F.transform(cue, lambda v: _let(v.rlike(must), lambda m: F.struct(v.alias("label"), F.when(m, "requirement").otherwise("responsibility").alias("type"), F.when(m, "required").otherwise("preferred").alias("priority"), terms_in(v).alias("terms"))))
    years = F.regexp_extract(text, r"(?i)\b((?:minimum of |at least )?[0-9]+(?:\.[0-9]+)?\s*(?:-|to)\s*[0-9]+(?:\.[0-9]+)?\s*years?\b|\b[0-9]+(?:\.[0-9]+)?\+\s*years?)\b", 1)
    school = F.regexp_extract(text, r"(?i)\b(MBA|PGDM|bachelor[^,.;\n]*|master[^,.;\n]*|CFA|CA|CPA|FRM|degree[^,.;\n]*)\b", 1)
    maybe = lambda value, use: _let(value, lambda v: F.when(v != "", F.array(use(v)).cast(_REQUIREMENTS)).otherwise(F.array().cast(_REQUIREMENTS)))
    rest = (maybe(years, lambda v: row(v, "experience", "required", F.array(v))), maybe(school, lambda v: row(v, "education", "required", terms_in(v))), maybe(place, lambda v: row(v, "location", "context", F.array().cast("array<string>"))))
    return F.concat(signal.cast(_REQUIREMENTS), line.cast(_REQUIREMENTS), *rest)


def _first_of_each(rows: Column, most: int) -> Column:
    """The first requirement of each normal label, `most` of them."""
    first = lambda labels: F.filter(rows, lambda r, i: (r["label"] != "") & (F.array_position(labels, F.get(labels, i)) == i + 1))
    return F.slice(_let(F.transform(rows, lambda r: normal(r["label"])), first), 1, most)


def extract_requirements(postings: DataFrame, most: int = 20) -> DataFrame:
    """(posting_id, no, label, type, priority, terms): signal terms, up to 8 cue lines, a range of years, education, place; equal labels once.

    They depend on a posting's texts alone and are looked for once a text. Rows that share a posting_id are one posting.
    """
    inputs = ("title", "description", "location")
    told = lambda df: df.withColumn("_asked", _requirements(*[F.coalesce(c, F.lit("")) for c in inputs]))
    kept = lambda df: told(df).select("*", F.inline(F.array(F.struct(_first_of_each(F.col("_asked"), most).alias("_kept"))))).drop("_asked")
    jobs = postings.select("posting_id", *inputs)
    listed = lambda df: df.select("posting_id", (F.col("_pos") + 1).alias("no"), "r.*")
    repeated = Rounds(jobs.sparkSession, "repeated").write(jobs.groupBy("posting_id").count().where("count > 1").select(F.col("posting_id").alias("_id")), "ids")
    same = F.col("posting_id").eqNullSafe(F.col("_id"))
    several = not repeated.isEmpty()
    one = judged_once(jobs.join(repeated, same, "left_anti") if several else jobs, inputs, kept)
    out = listed(one.select("posting_id", F.posexplode("_kept").alias("_pos", "r")))
    if not several:
        return out
    every = told(jobs.join(repeated, same, "left_semi")).select("posting_id", F.posexplode("_asked").alias("_pos", "r")).groupBy("posting_id").agg(F.sort_array(F.collect_list(F.struct("_pos", "r"))).alias("_asked"))
    merged = every.select("posting_id", F.transform("_asked", lambda x: x["r"]).alias("_asked"))
    return out.unionByName(listed(merged.select("posting_id", F.posexplode(_first_of_each(F.col("_asked"), most)).alias("_pos", "r"))))


def profile_terms(lines: DataFrame, id_col: str = "profile_id") -> DataFrame:
    """(id, term, pos, line): the first line that proves each term."""
    found = lines.select(id_col, "pos", "line", F.explode(terms_in(F.col("line"))).alias("term"))
    return found.groupBy(id_col, "term").agg(F.min_by(F.struct("pos", "line"), "pos").alias("x")).select(id_col, "term", "x.pos", "x.line")


def term_sets(df: DataFrame, id_col: str, value: Column, groups: tuple[str, ...] | None = None) -> DataFrame:
    """(id, terms): the sorted terms of each text that has any."""
    return df.select(id_col, F.inline(F.array(F.struct(F.array_sort(terms_in(value, groups)).alias("terms"))))).where(F.size("terms") > 0)


def offered_sets(jobs: DataFrame, groups: tuple[str, ...] | None = None, cheap: int = 20) -> DataFrame:
    """term_sets of the postings that can be among the first `cheap` with their terms: of postings with one text only the first `cheap`, so that terms are looked for once a text and not once a posting."""
    texts = jobs.select("posting_id", F.concat_ws("\n", "title", "description").alias("_text"))
    first = texts.withColumn("_n", F.row_number().over(Window.partitionBy("_text").orderBy("posting_id"))).where(F.col("_n") <= cheap)
    return term_sets(first, "posting_id", F.col("_text"), groups)


def _offers(jobs: DataFrame, cheap: int) -> DataFrame:
    """(offer, terms, ids): distinct term sets with their first `cheap` postings."""
    first = Window.partitionBy("terms").orderBy("posting_id")
    best = jobs.select("posting_id", "terms").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= cheap).groupBy("terms").agg(F.sort_array(F.collect_list("posting_id")).alias("ids"))
    return best.withColumn("offer", F.xxhash64("terms"))


def _asks(people: DataFrame, offers: DataFrame, cheap: int) -> DataFrame:
    """(ask, rare, upto): distinct term sets of profiles, their terms from the rarest among the offers on, and how many of these have `cheap` offers together."""
    frequency = offers.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    asked = people.select("terms").distinct().select(F.xxhash64("terms").alias("ask"), F.explode("terms").alias("term")).join(frequency, "term")
    rare = asked.groupBy("ask").agg(F.sort_array(F.collect_list(F.struct("n", "term"))).alias("_r"))
    upto = F.aggregate("_r", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("at")), lambda a, x: F.when(a["n"] >= cheap, a).otherwise(F.struct((a["n"] + x["n"]).alias("n"), (a["at"] + 1).alias("at"))), lambda a: a["at"])
    return rare.select("ask", F.transform("_r", lambda x: x["term"]).alias("rare"), upto.alias("upto"))


def _meetings(asks: DataFrame, offers: DataFrame, low: Column, high: Column, salts: int) -> DataFrame:
    """(ask, offer, ids, shared) for the offers with one of the asks' terms low to high, and none before: each pair at its rarest shared term. Terms are few and common; each is split into `salts` keys."""
    lists = offers.select("offer", "ids", "terms", F.explode("terms").alias("term"), F.pmod("offer", F.lit(salts)).alias("salt"))
    wanted = asks.select("ask", "rare", F.explode(F.when(high >= low, F.sequence(low, high))).alias("at"))
    wanted = wanted.withColumns({"term": F.get("rare", F.col("at") - 1), "salt": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))})
    both = lists.join(wanted, ["term", "salt"]).where(~F.arrays_overlap(F.slice("rare", 1, F.col("at") - 1), "terms"))
    return both.select("ask", "offer", "ids", F.size(F.array_intersect("rare", "terms")).cast("long").alias("shared"))


def _best_of(pairs: DataFrame, cheap: int) -> DataFrame:
    best = Window.partitionBy("ask").orderBy(F.desc("shared"), "posting_id")
    return pairs.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= cheap).drop("_n")


def threshold_pairs(jobs: DataFrame, people: DataFrame, cheap: int = 20, salts: int = 16) -> tuple[DataFrame, DataFrame]:
    """The pairs of distinct term sets (ask, offer, ids, shared) that have to be looked at to find the `cheap` best postings of each profile, in two steps.

    First the offers with an ask's rarest terms, as many of its terms as it takes to have `cheap` offers. The `cheap`-th best of these shares t terms. An offer that shares t of q terms has one of
    the q - t + 1 rarest: so only the lists of those are looked at next, and the most common terms' not at all, unless an ask needs them.
    """
    tables = Rounds(jobs.sparkSession, "offers")  # each is looked at several times
    offers = tables.write(_offers(jobs, cheap), "offers")
    asks = tables.write(_asks(people, offers, cheap), "asks")
    first = _meetings(asks, offers, F.lit(1), F.col("upto"), salts)
    found = _best_of(first.select("ask", "shared", F.explode("ids").alias("posting_id")), cheap).groupBy("ask").agg(F.count("*").alias("n"), F.min("shared").alias("least"))
    least = F.when(F.col("n") >= cheap, F.col("least")).otherwise(1).cast("int")
    more = asks.join(found, "ask").select("ask", "rare", "upto", (F.size("rare") - least + 1).alias("high"))
    return first, _meetings(more, offers, F.col("upto") + 1, F.col("high"), salts)


def likely_pairs(jobs: DataFrame, people: DataFrame, cheap: int = 20, salts: int = 16) -> DataFrame:
    """(profile_id, posting_id, shared): the `cheap` postings that share most terms with each profile, one at least; ties go to the smaller posting_id.

    jobs: posting_id, terms; people: profile_id, terms (term_sets). All postings with the same set of terms share equally much, so of each set only the first `cheap` ids
    can be among the best of anyone: different sets are compared, not postings and profiles, and of these only what threshold_pairs leaves.
    """
    first, rest = threshold_pairs(jobs, people, cheap, salts)
    each = [_best_of(x.select("ask", "shared", F.explode("ids").alias("posting_id")), cheap) for x in (first, rest)]
    top = _best_of(each[0].union(each[1]), cheap).groupBy("ask").agg(F.collect_list(F.struct("posting_id", "shared")).alias("found"))
    return _merged(people.select("profile_id", F.xxhash64("terms").alias("ask")), top, ["ask"]).select("profile_id", F.inline("found"))


def _merged(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join by shuffle. The planner guesses the size of texts, term arrays and proofs from a narrow file's size, and would gather all profiles at the driver for a broadcast."""
    return left.hint("shuffle_merge").join(right.hint("shuffle_merge"), on, how)


def scored_pairs(pairs: DataFrame, requirements: DataFrame, terms: DataFrame, postings: DataFrame, profiles: DataFrame, salts: int = 16) -> DataFrame:
    """pairs (profile_id, posting_id, shared) with evidence, score, hard_gaps, confidence.

    evidence: (no, type, matches, supported, excerpt) of the requirements with a proven term; terms: profile_terms(). A pair is one row, to which the posting's requirements and
    the profile's proofs are joined as arrays. Postings that very many profiles have are split into `salts` keys. The score is the mean of the coverages
    of required and skill rows, title and field, that apply; null where either side has no text.
    """
    text, finance = F.concat_ws("\n", "title", "description"), ("finance",)
    wanted = pairs.select("posting_id").distinct()
    asked = requirements.join(wanted, "posting_id", "left_semi").groupBy("posting_id").agg(F.sort_array(F.collect_list(F.struct("no", "type", "priority", F.array_distinct("terms").alias("terms"), F.size("terms").alias("n_terms")))).alias("_asked"))
    job = postings.join(wanted, "posting_id", "left_semi").select("posting_id", terms_in(F.col("title")).alias("_title"), (F.size(terms_in(text, finance)) > 0).alias("_finance"), F.length(F.coalesce("description", F.lit(""))).alias("_length"))
    job = job.join(asked, "posting_id", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    proofs = terms.groupBy("profile_id").agg(F.map_from_entries(F.collect_list(F.struct("term", F.struct("pos", "line")))).alias("_proofs"))
    person = profiles.select("profile_id", F.col("text").alias("_text")).select("profile_id", F.inline(F.array(F.struct(terms_in(F.col("_text")).alias("_terms"), (F.size(terms_in(F.col("_text"), finance)) > 0).alias("_has"), F.when(normal(F.col("_text")) == "", 0).otherwise(F.size(F.split(normal(F.col("_text")), " "))).alias("_words")))))
    person = _merged(person, proofs, ["profile_id"], "left")
    x = _merged(_merged(pairs.withColumn("_salt", F.pmod(F.xxhash64("profile_id"), F.lit(salts))), job, ["posting_id", "_salt"]), person, ["profile_id"])

    def proven(r: Column) -> Column:
        return _let(F.filter(r["terms"], lambda t: F.map_contains_key("_proofs", t)), lambda hit: F.struct(r["no"].alias("no"), r["type"].alias("type"), r["priority"].alias("priority"), F.size(hit).alias("matches"), ((r["type"] == "skill") | (F.size(hit) >= F.least(F.lit(2), r["n_terms"]))).alias("supported"), F.array_min(F.transform(hit, lambda t: F.element_at("_proofs", t)))["line"].alias("excerpt")))

    x = x.withColumn("_asked", F.coalesce("_asked", F.array().cast(asked.schema["_asked"].dataType)))
    x = x.select("*", F.inline(F.array(F.struct(F.filter(F.transform(F.filter("_asked", lambda r: r["priority"] != "context"), proven), lambda e: e["matches"] > 0).alias("evidence")))))
    of = lambda array, field, value: F.filter(array, lambda e: e[field] == value)
    proved = lambda field, value: F.filter(of("evidence", field, value), lambda e: e["supported"])
    counts = F.struct(F.size(of("_asked", "priority", "required")).alias("n_required"), F.size(of("_asked", "type", "skill")).alias("n_skills"), F.size(proved("priority", "required")).alias("got_required"), F.size(proved("type", "skill")).alias("got_skills"))
    x = x.select("*", F.inline(F.array(counts)))
    cover = F.array_compact(F.array(
        F.when(F.col("n_required") > 0, F.col("got_required") / F.col("n_required")),
        F.when(F.col("n_skills") > 0, F.col("got_skills") / F.col("n_skills")),
        F.when(F.size("_title") > 0, F.size(F.array_intersect("_title", "_terms")) / F.size("_title")),
        F.when(F.col("_finance"), F.when(F.col("_has"), 1.0).otherwise(0.0)),
    ))
    mean = _let(cover, lambda c: F.when(F.size(c) > 0, F.aggregate(c, F.lit(0.0), lambda a, v: a + v) / F.size(c)))
    said = (F.col("_length") > 0) & (F.col("_words") > 0)
    gaps = F.least(F.col("n_required") - F.col("got_required") + F.when(F.col("_finance") & ~F.col("_has"), 1).otherwise(0), F.lit(8))
    sure = F.when((F.col("_words") >= 180) & (F.col("_length") >= 300), "high").when((F.col("_words") >= 100) & (F.col("_length") >= 100), "medium").otherwise("low")
    return x.select(*pairs.columns, "evidence", F.when(said, _half_up(mean * 100)).cast("int").alias("score"), gaps.cast("int").alias("hard_gaps"), sure.alias("confidence"))


def top_matches(scored: DataFrame, keep: int = 10) -> DataFrame:
    """The `keep` best of each profile's scored pairs: by score, then shared terms, then posting_id."""
    best = Window.partitionBy("profile_id").orderBy(F.desc_nulls_last("score"), F.desc("shared"), "posting_id")
    return scored.withColumn("match_rank", F.row_number().over(best)).where(F.col("match_rank") <= keep)


def draft_letters(scored: DataFrame, postings: DataFrame) -> DataFrame:
    """(posting_id, profile_id, letter) of the scored pairs whose posting allows a letter and that have two different lines of evidence; three lines at most."""
    allowed = postings.where(letter_requirement(F.col("description")).isin("required", "optional", "mentioned")).select("posting_id", "title", "company", F.concat_ws("\n", "title", "description").alias("_text"))
    lines = F.array_distinct(F.transform(F.filter("evidence", lambda e: e["supported"]), lambda e: e["excerpt"]))
    best = scored.select("posting_id", "profile_id", lines.alias("_lines")).where(F.size("_lines") >= 2).select("posting_id", "profile_id", F.slice("_lines", 1, 3).alias("_e"))
    padded = F.concat(F.lit(" "), normal(F.col("_text")), F.lit(" "))
    family = F.lit("finance / analyst")
    for label, terms in reversed(FAMILIES):
        test = F.lit(False)
        for t in terms:
            test = test | padded.contains(f" {t} ")
        family = F.when(test, label).otherwise(family)
    body = F.array_join(F.transform("_e", lambda e: F.when(e.rlike("^[-*•▪‣]"), e).otherwise(F.concat(F.lit("- "), e))), "\n")
    letter = F.concat(F.lit("Dear Hiring Manager,\n\nPlease consider my application for the "), F.col("title"), F.lit(" position at "), F.col("company"), F.lit(". My profile contains documented evidence relevant to this "), family, F.lit(" role.\n\nRelevant evidence from my profile:\n"), body, F.lit("\n\nRegards,\n[Your name]"))
    return best.join(allowed, "posting_id").select("posting_id", "profile_id", letter.alias("letter"))


def _bare(line: Column) -> Column:
    return normal(F.regexp_replace(line, r"^[-*•▪‣]\s*", ""))


def verify_claims(draft: DataFrame, source: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Draft lines that are neither template wording nor, word by word, a source line (of the same `on` columns)."""
    own = source.select(*(on or []), _bare(F.col("line")).alias("_bare")).distinct()
    return draft.withColumn("_bare", _bare(F.col("line"))).where(~F.col("line").rlike(TEMPLATE)).join(own, [*(on or []), "_bare"], "left_anti").drop("_bare")


def tailor_profile(lines: DataFrame, proven: DataFrame, id_col: str = "profile_id") -> tuple[DataFrame, DataFrame]:
    """(kept, not_carried): the header above the first heading, education, skills and certifications, proven lines (id, line_id), and headings that kept lines follow; proven lines that are not kept."""
    x = assign_sections(lines, id_col).join(proven.select(id_col, "line_id").distinct().withColumn("_proven", F.lit(True)), [id_col, "line_id"], "left")
    whole = Window.partitionBy(id_col)
    first = F.coalesce(F.min(F.when(F.col("is_heading"), F.col("pos"))).over(whole), F.lit(5))
    content = ~F.col("is_heading") & (F.col("_proven").isNotNull() | F.col("section").isin("education", "skills", "certifications") | (F.col("pos") < first))
    after = F.max(content.cast("int")).over(Window.partitionBy(id_col).orderBy("pos").rowsBetween(1, Window.unboundedFollowing))
    marked = x.withColumn("_content", content).withColumn("_keep", F.when(F.col("is_heading"), F.coalesce(after == 1, F.lit(False))).otherwise(content))
    kept = marked.where("_keep").select(*lines.columns, "section")
    return kept, proven.join(kept.select(id_col, "line_id"), [id_col, "line_id"], "left_anti")


def diff_versions(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, line_id, change): lines of two versions by content."""
    a, b = before.select(key, "line_id").distinct().withColumn("_a", F.lit(1)), after.select(key, "line_id").distinct().withColumn("_b", F.lit(1))
    return a.join(b, [key, "line_id"], "full").select(key, "line_id", F.when(F.col("_b").isNull(), "removed").when(F.col("_a").isNull(), "added").otherwise("kept").alias("change"))


def shared_lines(lines: DataFrame, id_col: str = "profile_id") -> DataFrame:
    """(line_id, profiles): lines that several profiles hold, with how many."""
    return lines.select("line_id", id_col).distinct().groupBy("line_id").agg(F.count("*").alias("profiles")).where("profiles > 1")


def merge_model_results(classified: DataFrame, results: DataFrame, least: float = 0.75, cache: DataFrame | None = None, version: str | None = None) -> DataFrame:
    """Classified postings with accepted model results: same description_hash, least confidence, min <= max and all evidence found in the posting; others stay deterministic, possible ones pending.

    results: posting_id, description_hash, domain_status, experience_status, minimum_years, maximum_years, confidence, evidence (array). cache: the same columns and version; its rows of
    `version` count where results have none for a posting and hash. Of several results for these the most confident counts.
    """
    taken = {"domain_status": "_domain", "experience_status": "_years", "minimum_years": "_low", "maximum_years": "_high"}
    said = lambda df, rank: df.select("posting_id", "description_hash", F.struct(F.lit(rank).alias("r"), "confidence", *[F.col(c).alias(n) for c, n in taken.items()], F.col("evidence").alias("_said")).alias("_new"))
    every = said(results, 1) if cache is None else said(results, 1).unionByName(said(cache.where(F.col("version") == version), 0))
    new = every.where("description_hash is not null").groupBy("posting_id", "description_hash").agg(F.max("_new").alias("_new")).select("posting_id", "description_hash", "_new.*")
    text = F.lower(F.concat_ws("\n", "title", "experience_text", "description"))
    fits: Callable[[Column], Column] = lambda e: text.contains(F.lower(e))
    ok = (F.col("confidence") >= least) & F.coalesce(F.col("_low") <= F.col("_high"), F.lit(True)) & F.forall("_said", fits) & F.col("_domain").isin("exact", "likely", "unrelated") & F.col("_years").isin("zero_to_two", "over_two", "ambiguous")
    x = classified.join(new, ["posting_id", "description_hash"], "left").withColumn("_ok", F.coalesce(ok & (F.col("match_tier") == "possible"), F.lit(False)))
    method = F.when(F.col("_ok"), "model").when(F.col("match_tier") == "possible", "pending").otherwise("deterministic")
    return x.select(*[F.when(F.col("_ok"), F.col(taken[c])).otherwise(F.col(c)).alias(c) if c in taken else F.col(c) for c in classified.columns], method.alias("classification_method"))
