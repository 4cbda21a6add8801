"""Wordings and titles with their expected classes."""

import pytest
from pyspark.sql import functions as F

from vacantia.functions.experience import experience_band
from vacantia.operators import classify as c

BANDS = [
    ("0-2 years experience", "zero_to_two", 0, 2),
    ("up to 24 months of experience", "zero_to_two", 0, 2),
    ("1+ years of experience", "zero_to_two", 1, None),
    ("2+ years of experience", "zero_to_two", 2, None),
    ("3+ years of experience", "over_two", 3, None),
    ("Minimum 3 years of experience", "over_two", 3, None),
    ("more than 2 years of experience", "over_two", 2.01, None),
    ("1-3 years of relevant experience", "over_two", 1, 3),
    ("0-2 years in analytics and minimum 4 years in banking", "ambiguous", None, None),
    ("Freshers may apply", "zero_to_two", 0, 0),
    ("no prior experience required", "zero_to_two", 0, 0),
    ("3-8 years preferred", "over_two", None, None),
    ("2 years preferred", "zero_to_two", 2, 2),
    ("mid-level finance professional", "over_two", 3, None),
    ("Vice President, Risk", "over_two", 5, None),
    ("two years of experience", "zero_to_two", 2, 2),
    ("six months of experience", "zero_to_two", 0.5, 0.5),
    ("A company with more than 150 years of history", "ambiguous", None, None),
    ("requires 5 years", "over_two", 5, 5),
    ("", "ambiguous", None, None),
    (None, "ambiguous", None, None),
]


def test_experience(spark):
    df = spark.createDataFrame([(i, b[0]) for i, b in enumerate(BANDS)], "i int, t string").withColumn("b", experience_band(F.col("t")))
    got = {r.i: (r.b.status, r.b.minimum_years, r.b.maximum_years) for r in df.collect()}
    assert [got[i] for i in range(len(BANDS))] == [tuple(b[1:]) for b in BANDS]


@pytest.mark.parametrize(("title", "is_noise"), [("Tele caller - Associate", True), ("Voice Over Artist", True), ("IN_Manager_Employee Central_SAP", True), ("Senior Manager", True), ("All positions in", True), ("Financial Data Analyst", False), ("Tax Analyst 2", False), ("Credit Portfolio Officer", False), ("Controller - Analyst", False), ("Senior Financial Data Analyst", False), ("", False)])
def test_noise(spark, title, is_noise):
    assert spark.createDataFrame([(title,)], "title string").select(c.noise(F.col("title"))).first()[0] is is_noise


def test_places_fields_and_tiers(spark):
    rows = [
        (1, "Financial Analyst", "Pune, India", "", "0-2 years experience", "india", "exact", "exact"),
        (2, "Financial Analyst", "Remote", "", "0-2 years experience", "uncertain", "exact", "possible"),
        (3, "Financial Analyst", "London, UK", "", "0-2 years experience", "not_india", "exact", "not_targeted"),
        (4, "Software Engineer - Finance", "Mumbai", "", "Freshers", "india", "unrelated", "not_targeted"),
        (5, "Analyst", "Mumbai", "Work in the financial services industry", "Freshers", "india", "unrelated", "not_targeted"),
        (6, "Analyst", "Mumbai", "Knows portfolio work", "Freshers", "india", "likely", "possible"),
        (7, None, None, None, None, "uncertain", "unrelated", "not_targeted"),
    ]
    df = spark.createDataFrame([(i, t, p, "", "", d, e) for i, t, p, d, e, *_ in rows], "posting_id int, title string, location string, category string, department string, description string, experience_text string")
    got = {r.posting_id: (r.location_status, r.domain_status, r.match_tier) for r in c.classify_postings(df).collect()}
    assert got == {r[0]: r[5:] for r in rows}


def test_candidates_and_sample(spark):
    rows = [(1, "Vice President", "x"), (2, "Analyst", ""), (3, "Chef", "Kitchen"), (4, "Chef", None), (5, "Chef", "Marketing")]
    df = spark.createDataFrame([(i, 1, t, cat, "Dept", "d") for i, t, cat in rows], "posting_id int, connector_id int, title string, category string, department string, description string")
    got = {r.posting_id: (r.candidate_status, list(r.candidate_reasons)) for r in c.select_candidates(df).collect()}
    assert got == {1: ("defer", ["strong_non_finance_category"]), 2: ("hydrate", ["early_career_title", "generic_title", "missing_category"]), 3: ("hydrate", ["insufficient_exclusion_evidence"]), 4: ("hydrate", ["missing_category"]), 5: ("defer", ["strong_non_finance_category"])}
    seen = c.select_candidates(df, spark.createDataFrame([(5,)], "posting_id int"))
    assert {r.posting_id: r.candidate_status for r in seen.collect()}[5] == "hydrate"
    many = spark.createDataFrame([(i, i % 3, "defer") for i in range(300)], "posting_id int, connector_id int, candidate_status string")
    pick = lambda d, day: {(r.connector_id, r.posting_id, r.sample_rank) for r in c.audit_sample(d, day, 4).collect()}
    assert pick(many, "2026-08-01") == pick(many.orderBy(F.desc("posting_id")).repartition(5), "2026-08-01") != pick(many, "2026-08-02")
    assert len(pick(many, "2026-08-01")) == 12
