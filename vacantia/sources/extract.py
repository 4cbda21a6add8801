"""Landed pages to rows: JSON and HTML boards, JSON-LD, links, page text, records, platforms, liveness.

raw pages: connector_id, page_no, url, http_status, content_type, body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.functions.names import brand, clean_place, employer_from_host, employer_from_path, place_from_path
from vacantia.functions.urls import canonical_url, generic_url, host
from vacantia.functions.wordlists import INDIA

LISTING = ("source_external_id", "company", "title", "location", "category", "department", "detail_url")
#: Longest text that is kept of a page.
TEXT_CAP = 20_000
# Platform words in the order they are tried.
PLATFORMS = (("workday", "Workday"), ("taleo", "Taleo"), ("successfactors", "SuccessFactors"), ("eightfold", "Eightfold"), ("avature", "Avature"), ("icims", "iCIMS"), ("greenhouse", "Greenhouse"), ("phenom", "Phenom"), ("smartrecruiters", "SmartRecruiters"), ("lever", "Lever"), ("beamery", "Beamery"))
# Wording of closed postings, places in Markdown lines, and labels that name no posting.
CLOSED = r"(?i)no longer (?:available|accepting|open|active|in effect)|(?:job|position|posting|requisition|vacancy|opening|role|listing)[^.!?\n]{0,80}(?:is|has|was)[^.!?\n]{0,40}(?:closed|filled|removed|expired|deleted|cancelled|canceled|unavailable|inactive)"
MARKDOWN_PLACE = r"(?i)\b(?:india|bengaluru|bangalore|gurgaon|gurugram|mumbai|pune|hyderabad|delhi|noida|chennai)\b"
PAGE_SUFFIX = r"(?i)\s*[|–—-]\s*[^|–—-]{0,60}?\s*(?:careers?|jobs?|job search|hiring|apply now?)\s*$"
GENERIC_LABEL = r"(?i)^(?:home|careers?|search|learn more|view all|apply now)$"


def plain_text(html: Column, cap: int | None = TEXT_CAP) -> Column:
    """Text of a page: no scripts, styles or tags, common entities decoded, blanks collapsed, cut at the cap."""
    t = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(sign))
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    return t if cap is None else F.substring(t, 1, cap)


def pages_to_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds page_text."""
    return pages.withColumn("page_text", plain_text(F.coalesce(F.col(html), F.lit(""))))


def _first_of_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def _complete(rows: DataFrame) -> DataFrame:
    """Rows with id, title and URL, the first of each listing."""
    full = rows.where("coalesce(source_external_id, '') <> '' and coalesce(title, '') <> '' and coalesce(detail_url, '') <> ''")
    return _first_of_key(full, ["connector_id", "source_external_id"], ["page_no", "pos"]).drop("pos")


def _mapped(raw: DataFrame, mapping: dict[str, dict[str, str]]) -> DataFrame:
    """raw pages of the mapped connectors, with their row of the mapping as a map of strings: pages are read once whatever the number of connectors."""
    rows = [(connector, dict(paths)) for connector, paths in mapping.items()]
    table = raw.sparkSession.createDataFrame(rows, "_connector string, _paths map<string,string>")
    return raw.join(F.broadcast(table), F.col("connector_id").cast("string") == F.col("_connector")).drop("_connector")


def extract_json_listings(raw: DataFrame, mapping: dict[str, dict[str, str]], region: str | None = INDIA) -> DataFrame:
    """Listings of JSON boards. mapping: connector -> {items: path of the array, column: path in an item}; $ is the root.

    Bodies that aren't JSON give no rows. region: pattern that a location has to match, if there is one.
    """
    path = lambda c: F.expr(f"_paths['{c}']")
    get = lambda v, c, kind: F.expr(f"try_variant_get({v}, _paths['{c}'], '{kind}')")
    doc = _mapped(raw, mapping).withColumn("_v", F.try_parse_json("body")).where(F.col("_v").isNotNull() & path("items").isNotNull())
    items = doc.select("connector_id", "page_no", "_paths", F.posexplode(get("_v", "items", "array<variant>")).alias("pos", "_i"))
    rows = items.select("connector_id", "page_no", "pos", *[F.when(path(c).isNotNull(), get("_i", c, "string")).alias(c) for c in LISTING])
    return _complete(rows if region is None else rows.where(F.col("location").isNull() | F.col("location").rlike(region)))


def extract_html_listings(raw: DataFrame, mapping: dict[str, dict[str, str]]) -> DataFrame:
    """Listings of HTML result pages. mapping: connector -> {card: pattern of a card, or start: pattern a card starts with, column: pattern with one group}."""
    pattern = lambda c: F.expr(f"_paths['{c}']")
    whole = F.when(pattern("card").isNotNull(), F.regexp_extract_all("body", pattern("card"), F.lit(0)))
    cards = whole.otherwise(F.filter(F.split("body", F.concat(F.lit("(?="), pattern("start"), F.lit(")"))), lambda _, i: i > 0))
    items = _mapped(raw, mapping).select("connector_id", "page_no", "_paths", F.posexplode(cards).alias("pos", "_card"))
    field = lambda c: F.when(pattern(c).isNotNull(), F.nullif(plain_text(F.expr(f"regexp_extract(_card, _paths['{c}'], 1)"), None), F.lit("")))
    return _complete(items.select("connector_id", "page_no", "pos", *[field(c).alias(c) for c in LISTING]))


def _unfolded(block: Column) -> Column:
    """All JSON values in a text that are no arrays themselves: the text's, and those in arrays and @graph at any depth. Each step of the fold opens one level."""
    none = F.array().cast("array<variant>")
    array = lambda v: F.try_variant_get(v, "$", "array<variant>")
    within = lambda v: F.concat(F.coalesce(array(v), none), F.coalesce(F.try_variant_get(v, "$['@graph']", "array<variant>"), none))
    start = F.struct(F.array_compact(F.array(F.try_parse_json(block))).alias("open"), none.alias("found"))

    def level(a: Column, _: Column) -> Column:
        found = F.concat(a["found"], F.filter(a["open"], lambda v: array(v).isNull()))
        return F.when(F.size(a["open"]) == 0, a).otherwise(F.struct(F.array_compact(F.flatten(F.transform(a["open"], within))).alias("open"), found.alias("found")))

    # A text of n brackets has n levels at most; what lies open after the last is empty.
    levels = F.sequence(F.lit(0), F.length(block) - F.length(F.replace(block, F.lit("["), F.lit(""))))
    return F.aggregate(levels, start, level, lambda a: a["found"])


def extract_jsonld(pages: DataFrame, kind: str = "JobPosting", html: str = "html") -> DataFrame:
    """One row (all columns and `node`, JSON text) for each JSON-LD object of the kind, in arrays and @graph at any depth. Malformed blocks are skipped."""
    blocks = pages.withColumn("_block", F.explode(F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))))
    v = blocks.withColumn("_v", F.explode(_unfolded(F.col("_block")))).drop("_block")
    named = F.coalesce(F.try_variant_get("_v", "$['@type']", "string"), F.lit(""))
    found = v.where(named.contains(kind)).withColumn("node", F.to_json("_v")).drop("_v")
    return found.dropDuplicates([*[c for c in pages.columns if c != html], "node"])


def discover_links(pages: DataFrame, page_id: str = "page_id", html: str = "html", job_pattern: str | None = None, cap: int = 1000) -> DataFrame:
    """(page_id, link, method): anchors, URLs in scripts and sitemap locations, one row for each link of a page, `cap` at most."""
    body = F.coalesce(F.col(html), F.lit(""))
    find = lambda pattern, method: pages.select(page_id, F.posexplode(F.regexp_extract_all(body, F.lit(pattern), F.lit(1))).alias("pos", "link"), F.lit(method).alias("method"))
    links = find(r'(?i)<a\b[^>]*\bhref="([^"#]+)"', "anchor").union(find(r'(?i)"(https?:\\?/\\?/[^"\s<>]+)"\s*[,}\]]', "script")).union(find(r"(?i)<loc>\s*([^<\s]+)", "sitemap"))
    links = links if job_pattern is None else links.where(F.col("link").rlike(job_pattern))
    links = _first_of_key(links, [page_id, "link"], ["method", "pos"])
    return links.withColumn("_n", F.row_number().over(Window.partitionBy(page_id).orderBy("method", "pos", "link"))).where(F.col("_n") <= cap).select(page_id, "link", "method")


def extract_markdown_links(docs: DataFrame, id_col: str = "doc_id", body: str = "text") -> DataFrame:
    """(id, title, link, place) of Markdown links whose own or next line names a place; the first of each link."""
    lines = docs.select(F.col(id_col), F.posexplode(F.split(F.coalesce(F.col(body), F.lit("")), "\n")).alias("line_no", "line"))
    context = F.concat_ws("\n", "line", F.lead("line").over(Window.partitionBy(id_col).orderBy("line_no")))
    seen = lines.withColumn("place", F.regexp_extract(context, "(?i)(" + MARKDOWN_PLACE.removeprefix("(?i)") + ")", 1)).where("place <> ''")
    pattern = r"\[([^\]]+)\]\(([^)]+)\)"
    found = seen.select(id_col, "line_no", "place", F.posexplode(F.regexp_extract_all("line", F.lit(pattern), F.lit(0))).alias("pos", "_m"))
    found = found.select(id_col, "line_no", "pos", F.trim(F.regexp_extract("_m", pattern, 1)).alias("title"), F.trim(F.regexp_extract("_m", pattern, 2)).alias("link"), "place").where(~F.col("title").rlike(GENERIC_LABEL))
    return _first_of_key(found, [id_col, "link"], ["line_no", "pos"]).select(id_col, "title", "link", "place")


def build_observations(listings: DataFrame, details: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations, rejects): listings with their details (connector_id, source_external_id, description, apply_url); rejects say what is missing."""
    joined = listings.join(details, ["connector_id", "source_external_id"], "left")
    missing = F.array_compact(F.array(*[F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", F.lit(c)) for c in ("title", "detail_url", "description")]))
    marked = joined.withColumn("missing", missing)
    return marked.where(F.size("missing") == 0).drop("missing"), marked.where(F.size("missing") > 0)


def _meta(body: Column, *names: str) -> Column:
    """Content of the first of the named meta tags that has any, or null."""
    found = [F.nullif(F.trim(plain_text(F.regexp_extract(body, rf"""(?i)<meta\b[^>]*\b(?:property|name)\s*=\s*["']{n}["'][^>]*content\s*=\s*["']([^"']*)["']""", 1), None)), F.lit("")) for n in names]
    return F.coalesce(*found)


def extract_page_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, title, company, location, posted_at, source (jsonld, meta, title or url), confidence (high, medium, low), host: the best that a page or its address gives for each.

    A page with several postings gives the first by its text.
    """
    get = lambda path: F.nullif(F.trim(F.get_json_object("_node", path)), F.lit(""))
    ld = extract_jsonld(pages.select(page_id, html), "JobPosting", html).groupBy(page_id).agg(F.min("node").alias("_node"))
    body, site = F.coalesce(F.col(html), F.lit("")), host(F.col(url))
    title = F.nullif(plain_text(F.regexp_extract(body, r"(?is)<title[^>]*>(.*?)</title>", 1), None), F.lit(""))
    title = F.nullif(F.trim(F.regexp_replace(title, PAGE_SUFFIX, "")), F.lit(""))
    path = F.nullif(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(F.regexp_replace(F.col(url), r"[?#].*$", ""), r"[^/]/+([^/]+)/*$", 1), r"[-_]+|\.html?$", " "), r"\b[0-9]{3,}\b", "")), F.lit(""))
    x = pages.join(ld, page_id, "left").withColumns({"_ld": get("$.title"), "_meta": _meta(body, "og:title", "twitter:title"), "_told": _meta(body, "og:description", "description", "twitter:description")})
    employer = F.coalesce(get("$.hiringOrganization.name"), get("$.employerOverview.name"), F.when(~F.get_json_object("_node", "$.hiringOrganization").startswith("{"), get("$.hiringOrganization")))
    place = F.coalesce(get("$.jobLocation.address.addressLocality"), get("$.jobLocation[0].address.addressLocality"), F.when(~F.get_json_object("_node", "$.jobLocation").rlike("^[{\\[]"), get("$.jobLocation")), _meta(body, "jobLocation", "location"))
    source = F.when(F.col("_ld").isNotNull(), "jsonld").when(F.col("_meta").isNotNull() & F.col("_told").isNotNull(), "meta").when(F.coalesce("_meta", title).isNotNull(), "title").otherwise("url")
    confidence = F.when(source == "jsonld", "high").when(source == "meta", "medium").otherwise("low")
    company = brand(_meta(body, "og:site_name"), employer, employer_from_path(F.col(url)), employer_from_host(site))
    return x.select(page_id, F.substring(F.coalesce("_ld", "_meta", title, path, F.lit("Role listing")), 1, 200).alias("title"), F.substring(company, 1, 120).alias("company"), F.substring(F.coalesce(F.nullif(place_from_path(F.col(url)), F.lit("")), clean_place(place)), 1, 160).alias("location"), F.to_date(F.try_to_timestamp(get("$.datePosted"))).alias("posted_at"), source.alias("source"), confidence.alias("confidence"), site.alias("host"))


def detect_platform(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Adds platform: the first platform whose word is in the page or its address."""
    both = F.lower(F.concat_ws(" ", html, url))
    case = F.lit("Unknown")
    for word, name in reversed(PLATFORMS):
        case = F.when(both.contains(word), name).otherwise(case)
    return pages.withColumn("platform", case)


def posting_liveness(crawl: DataFrame) -> DataFrame:
    """Adds verdict (open, closed, unknown) to http_status, final_url, body, content_type."""
    code = F.col("http_status")
    raw = F.substring(F.coalesce("body", F.lit("")), 1, 150_000)
    title = F.regexp_extract(raw, r"(?i)<title[^>]*>([^<]*)</title>", 1)
    text = plain_text(raw, None)
    other = F.coalesce("content_type", F.lit("")).rlike(r"(?i)^(?!.*(?:text/html|application/xhtml|application/pdf)).+")
    verdict = F.when(code.isin(404, 410), "closed").when(code.isNull() | (code != 200), "unknown").when(other, "open").when(F.concat_ws(" ", title, F.substring(text, 1, 2500)).rlike(CLOSED), "closed").when((F.length(text) < 200) | generic_url(F.col("final_url")), "unknown").otherwise("open")
    return crawl.withColumn("verdict", verdict)


def canonical_pages(pages: DataFrame) -> DataFrame:
    return pages.withColumn("canonical_url", canonical_url(F.col("url")))
