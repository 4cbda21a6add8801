"""Names of employers and places as pages give them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wording of legal entities, labels that name no employer, host labels of job boards, cities, codes of places, and other spellings of companies.
ENTITY_NUMBER = r"(?i)^[a-z]*[0-9][0-9 -]*"
ENTITY_FORM = r"(?i)\b(?:private|pvt|limited|ltd|llc|inc\.?|advantage svcs|advantage services|international solutions|services|solutions|default company(?: for [a-z]+)?)\b.*$"
ENTITY_KIND = r"(?i)\b(?:company|corporation|corp|group|holding)\b.*$"
NO_EMPLOYER = r"(?i)^(?:external|internal|students|apply|careers|jobs|talent|career|job|lateral ba continuum|default company(?:.*)?)$|^[0-9-]+$"
BOARD_LABEL = r"(?i)(?:myworkdayjobs|greenhouse|lever|smartrecruiters|icims|oraclecloud|sapsf|successfactors|taleo|avature|workable|bamboohr|recruit|recruiting|talent|careers|jobs|external|internal|students|apply|wd[0-9]?|www|com)$"
BOARD_PATH = r"(?i)(?:jobs|careers|talent)(?:portal)?$"
CITIES = r"(?i)\b(bengaluru|bangalore|gurugram|gurgaon|mumbai|pune|hyderabad|delhi|noida|chennai|kolkata|ahmedabad|jaipur|kochi|thiruvananthapuram|indore|lucknow|coimbatore|vadodara|nagpur|visakhapatnam|surat|bhopal|chandigarh)\b"
PLACE_CODE = r"(?i)\s*\b(?:IN|IND|MH|KA|TN|DL|UP|TS|WB|GJ|RJ|KL|HR)\b\s*"
COMPANY_ALIASES = {"jpmorganchase": "jpmorgan", "deloitteusi": "deloitte", "pwcsdc": "pwc"}


def _squeezed(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def clean_entity(value: Column) -> Column:
    """An employer's name without registration numbers and legal form; empty if nothing is left or null."""
    plain = F.regexp_replace(F.coalesce(value, F.lit("")), ENTITY_NUMBER, " ")
    return _squeezed(F.regexp_replace(F.regexp_replace(plain, ENTITY_FORM, ""), ENTITY_KIND, ""))


def brand(*candidates: Column) -> Column:
    """The longest cleaned candidate of three letters or more that names an employer; of equally long ones the first; else null."""
    named = F.filter(F.transform(F.array(*candidates), clean_entity), lambda v: (F.length(v) >= 3) & ~v.rlike(NO_EMPLOYER))
    longest = F.array_max(F.transform(named, lambda v, i: F.struct(F.length(v).alias("n"), (-i).alias("i"), v.alias("v"))))
    return longest["v"]


def _spoken(label: Column) -> Column:
    return _squeezed(F.regexp_replace(F.regexp_replace(label, "([a-z])([A-Z])", "$1 $2"), "[-_]+", " "))


def employer_from_path(url: Column) -> Column:
    """The first segment of the path without words of job boards, if more than two letters are left; else empty."""
    segment = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/+([^/?#]+)", 1), BOARD_PATH, "")
    return F.when(F.length(segment) > 2, _spoken(segment)).otherwise("")


def employer_from_host(host: Column) -> Column:
    """The first label of the host that is no word of a job board and longer than two letters, or the first of all."""
    labels = F.split(host, r"\.")
    return _spoken(F.coalesce(F.get(F.filter(labels, lambda x: ~x.rlike(BOARD_LABEL) & (F.length(x) > 2)), F.lit(0)), F.get(labels, F.lit(0))))


def clean_place(value: Column) -> Column:
    """A known city of an address as "City, India"; else the address without codes of country and state."""
    raw = F.trim(F.coalesce(value, F.lit("")))
    city = F.regexp_extract(raw, CITIES, 1)
    plain = _squeezed(F.regexp_replace(F.regexp_replace(raw, PLACE_CODE, " "), ",+", ", "))
    return F.when(city != "", F.concat(F.initcap(city), F.lit(", India"))).otherwise(F.trim(F.regexp_replace(plain, r",\s*,", ",")))


def place_from_path(url: Column) -> Column:
    """The place that an address of a posting names, or empty."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    at_home, of_job = F.regexp_extract(path, r"(?i)/([a-z-]+)-india(?:/|$)", 1), F.regexp_extract(path, r"(?i)/jobs?/([a-z-]+)(?:/|$)", 1)
    label = F.trim(F.regexp_replace(F.when(at_home != "", at_home).otherwise(of_job), "[-_]+", " "))
    return F.when(F.length(label) > 2, F.concat(label, F.lit(", India"))).otherwise("")


def company_key(name: Column) -> Column:
    """Letters and digits in lower case, other spellings as one: equal for what counts as the same company."""
    plain = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", "")
    return F.coalesce(F.create_map(*[F.lit(x) for pair in COMPANY_ALIASES.items() for x in pair])[plain], plain)
