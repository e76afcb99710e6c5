"""Point-in-time boundaries: what is visible on which date."""

from datetime import date, datetime

import pytest

from panelspark.operators import asof, universe
from panelspark.operators.features_fund import attach, filing_features
from panelspark.operators.features_macro import macro_as_of

F_SCHEMA = "security_id string, fiscal_period_end date, filing_date date, available_at timestamp, revenue double, net_income double"


def panel(spark, *days):
    return spark.createDataFrame([("S1", d) for d in days], "security_id string, as_of date")


def filing(end, at, ni):
    return ("S1", end, at.date(), at, 10.0, float(ni))


def seen(spark, filings, *days):
    f = spark.createDataFrame(filings, F_SCHEMA)
    return {r["as_of"]: r["net_income"] for r in attach(panel(spark, *days), f).collect()}


def test_a_filing_is_invisible_before_it_is_made(spark):
    f = [filing(date(2020, 9, 30), datetime(2020, 10, 29), 71), filing(date(2020, 12, 31), datetime(2021, 2, 3), 86)]
    assert seen(spark, f, date(2021, 1, 20), date(2021, 3, 1)) == {date(2021, 1, 20): 71, date(2021, 3, 1): 86}


def test_midnight_is_visible_and_an_evening_filing_a_day_later(spark):
    f = [filing(date(2020, 12, 31), datetime(2021, 2, 15), 1)]
    assert seen(spark, f, date(2021, 2, 14), date(2021, 2, 15)) == {date(2021, 2, 14): None, date(2021, 2, 15): 1}
    f = [filing(date(2020, 12, 31), datetime(2021, 2, 15, 17), 1)]
    assert seen(spark, f, date(2021, 2, 15), date(2021, 2, 16)) == {date(2021, 2, 15): None, date(2021, 2, 16): 1}


def test_a_restatement_counts_from_its_publication(spark):
    f = [filing(date(2020, 3, 31), datetime(2020, 4, 27), 34), filing(date(2020, 3, 31), datetime(2020, 9, 8), 29)]
    assert seen(spark, f, date(2020, 7, 1), date(2020, 12, 1)) == {date(2020, 7, 1): 34, date(2020, 12, 1): 29}


def test_ties_fall_to_the_later_period(spark):
    f = [filing(date(2020, 3, 31), datetime(2020, 5, 10), 1), filing(date(2019, 12, 31), datetime(2020, 5, 10), 2)]
    assert seen(spark, f, date(2020, 6, 1)) == {date(2020, 6, 1): 1}


def test_trailing_sums_need_four_filings(spark):
    ends = [date(2020, 3, 31), date(2020, 6, 30), date(2020, 9, 30), date(2020, 12, 31)]
    at = [datetime(2020, 5, 15), datetime(2020, 8, 15), datetime(2020, 11, 15), datetime(2021, 2, 15)]
    f = spark.createDataFrame([filing(e, a, 100) for e, a in zip(ends, at, strict=True)], F_SCHEMA)
    assert [r["net_income_ttm"] for r in filing_features(f).orderBy("available_at").collect()] == [None, None, None, 400.0]


def test_macro_vintages(spark):
    m = spark.createDataFrame([("GDP", date(2020, 3, 31), datetime(2020, 4, 30), 21000.0, 0), ("GDP", date(2020, 3, 31), datetime(2020, 6, 29), 19500.0, 1)], "series_id string, observation_date date, available_at timestamp, value double, revision_id long")
    days = spark.createDataFrame([(date(2020, 4, 1),), (date(2020, 5, 31),), (date(2020, 8, 31),)], "as_of date")
    assert {r["as_of"]: r["GDP"] for r in macro_as_of(days, m, ["GDP"]).collect()} == {date(2020, 4, 1): None, date(2020, 5, 31): 21000.0, date(2020, 8, 31): 19500.0}


def test_empty_sides_and_clashes(spark):
    f = spark.createDataFrame([], F_SCHEMA)
    assert [r["net_income"] for r in attach(panel(spark, date(2020, 1, 1)), f).collect()] == [None]
    with pytest.raises(ValueError, match="both sides"):
        asof.as_of_join(panel(spark, date(2020, 1, 1)), panel(spark, date(2020, 1, 1)).withColumnRenamed("security_id", "k").selectExpr("k as security_id", "as_of"), "security_id", "as_of", "as_of")


def test_membership_is_half_open_and_announced(spark):
    m = spark.createDataFrame(
        [("A", "main", date(2020, 1, 1), date(2020, 6, 1), None), ("B", "main", date(2020, 1, 1), date(9999, 12, 31), datetime(2020, 3, 1, 15)), ("C", "main", date(2020, 1, 1), date(2020, 2, 1), None), ("C", "main", date(2020, 7, 1), date(9999, 12, 31), None)],
        "security_id string, universe string, start_date date, end_date date, available_at timestamp")
    days = spark.createDataFrame([(date(2020, 2, 29),), (date(2020, 3, 1),), (date(2020, 6, 1),), (date(2020, 7, 1),)], "as_of date")
    got = {}
    for r in universe.members(days, m, "main").collect():
        got.setdefault(r["as_of"], set()).add(r["security_id"])
    assert got == {date(2020, 2, 29): {"A"}, date(2020, 3, 1): {"A", "B"}, date(2020, 6, 1): {"B"}, date(2020, 7, 1): {"B", "C"}}


def test_biased_membership_is_refused(spark):
    m = spark.createDataFrame([("A", True)], "security_id string, is_survivorship_biased boolean")
    with pytest.raises(ValueError, match="biased"):
        universe.refuse_biased(m, False)
    universe.refuse_biased(m, True)
