"""URL forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia.functions.wordlists import TRACKING_PARAMETER


def canonical_url(url: Column) -> Column:
    """Without fragment, tracking parameters, and slashes at the end of the path; lower case. Parameters keep their order."""
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    path = F.regexp_replace(F.regexp_replace(plain, r"\?.*$", ""), r"/+$", "")
    root = F.when(path.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]+$"), F.concat(path, F.lit("/"))).otherwise(path)
    query = F.regexp_extract(plain, r"\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.split_part(p, F.lit("="), F.lit(1)).rlike(TRACKING_PARAMETER)), "&")
    return F.lower(F.concat(root, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def host(url: Column) -> Column:
    """Host without www, or null."""
    found = F.regexp_replace(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), r"^www\.", "")
    return F.when(found != "", found)


def generic_url(url: Column) -> Column:
    """No URL of a single posting: empty, or the page of all of them."""
    return F.coalesce(url, F.lit("")).rlike(r"(?i)^$|/(?:careers|jobs|work-with-us|search|index\.html)/?$|\.myworkdayjobs\.com/careers$")


def pick_apply_url(*urls: Column) -> Column:
    """The first that leads to a single posting, or null."""
    return F.get(F.filter(F.array(*urls), lambda u: ~generic_url(u)), F.lit(0))


def normal_text(value: Column) -> Column:
    """Lower case, & as and, other signs as blanks: for comparing companies, titles and places."""
    return F.trim(F.regexp_replace(F.replace(F.lower(F.coalesce(value, F.lit(""))), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))
