"""Questions read what they need of the policies: their names alone, or narrow rows and no mart."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from covermart.operators import monthly as mo
from covermart.operators import reviews as rv
from covermart.operators.coverage import coverage_dates
from covermart.operators.options import filter_options
from covermart.plans import questions as qu
from covermart.plans.snapshot import PORTFOLIO_COLUMNS, portfolio
from fixture_queries import question_queries, tables
from fixture_queries.registry import QUERIES

DAY = datetime.date


@pytest.fixture(scope="module")
def policies(spark):
    """Missing dimensions with and without a year and a covered month; names with blanks around."""
    start, stop = DAY(2020, 1, 5), DAY(2020, 3, 31)
    rows = [
        (2020, "Aland", "p1", "c1", "k1", "t1", "N", "old", "m1", "u1", None, start, stop, 1.5, 1.0, 0.1),
        (2020, "Aland", " p1 ", None, "k1", None, None, "new", "m1", None, start, start, stop, None, 2.0, 0.2),
        (2021, None, "p2", "c2", "k2", "t2", "N", None, "m2", "u1", None, start, DAY(2020, 1, 9), 4.0, 3.0, None),
        (2021, "Bland", None, "c1", "k1", "t1", "F", "old", None, "u2", None, start, stop, 8.0, None, 0.4),
        (None, None, "p3", None, "k3", None, "N", "", None, None, None, None, None, 16.0, 5.0, 0.5),
        (None, "Cland", None, " ", "k3", "t3", "N", "old", "m3", "u3", None, start, stop, 32.0, 6.0, 0.6),
    ]
    dates = ("effective_start_date", "effective_stop_date")
    kinds = ", ".join(
        f"{c.replace('effective', 'member') if c in dates else c} "
        + ("int" if c == "uw_year" else "date" if "date" in c else "double" if c.endswith("usd") else "string")
        for c in PORTFOLIO_COLUMNS
    )
    return coverage_dates(spark.createDataFrame(rows, kinds)).select(*PORTFOLIO_COLUMNS).persist()


def missing_country(policies, stop):
    return policies.withColumns(
        {"payer_country": F.lit(None).cast("string"), "effective_stop_date": F.lit(stop).cast("date")}
    )


@pytest.mark.parametrize("change", [
    lambda p: p, lambda p: missing_country(p, DAY(2020, 1, 31)), lambda p: missing_country(p, DAY(2020, 1, 30)),
    lambda p: missing_country(p, None), lambda p: p.where("uw_year IS NULL"), lambda p: p.where("false"),
])
def test_names_are_those_of_the_dictionary(spark, policies, change):
    rows = change(policies)
    with portfolio(rows) as frames:
        catalog = qu.entity_catalog(
            frames["payer_review_all"], frames["monthly_country_kpis"], frames["policy_type_review_all"],
            frames["master_contract_network_premium"], frames["age_bucket_review"],
            filter_options(rows, tuple(qu.ENTITY_COLUMNS.values())),
        )
        whole = sorted(map(tuple, catalog.select("entity_class", "value").collect()))
    names = qu.entity_names(rows)
    assert names.schema.names == catalog.schema.names
    assert sorted(map(tuple, names.select("entity_class", "value").collect())) == whole


def test_frames_of_the_portfolio_are_those_of_each_review(spark, policies):
    dated = policies.where("uw_year IS NOT NULL")
    with portfolio(policies) as frames:
        for name, alone in (
            ("premium_by_year", rv.premium_by_year), ("payer_review_all", rv.payer_review_all),
            ("age_bucket_review", rv.age_bucket_review), ("policy_type_review_all", rv.policy_type_review_all),
            ("master_contract_network_premium", rv.contract_network_premium),
            ("mobile_by_payer_all", rv.mobile_by_payer_all), ("monthly_kpis", mo.monthly_kpis),
            ("monthly_country_kpis", mo.monthly_country_kpis),
        ):
            expected = alone(dated)
            assert frames[name].select(*expected.columns).collect() == expected.collect(), name
        summary = frames["summary"].first()
    assert summary["policy_records"] == 4 and summary["latest_active_month"] == DAY(2020, 3, 31)


@pytest.mark.parametrize(("name", "steps"), [
    ("phrase_join", {"entity_names", "asked"}),
    ("q_sources", {"entity_names", "asked", "planned"}),
    ("q_years", {"entity_names", "asked", "planned"}),
    ("metric_fallback", {"narrow_policies", "aggregates", "asked", "routed", "evidence"}),
])
def test_questions_store_neither_whole_policies_nor_a_mart(spark, sf_dir, monkeypatch, name, steps):
    written: dict = {}
    monkeypatch.setattr(tables, "_written", written)
    monkeypatch.setattr(tables, "shared_folder", lambda s, own=f"narrow-{name}": f"{s.sparkContext.getCheckpointDir()}/{own}")
    QUERIES[name](spark, sf_dir)
    assert {key[2] for key in written} == steps


def test_stored_policies_of_questions_are_narrow(spark, sf_dir):
    stored = tables.narrow_policies(spark, sf_dir)
    assert tuple(stored.columns) == PORTFOLIO_COLUMNS
    assert stored.count() == tables.source_policies(spark, sf_dir).count()
    assert question_queries.names(spark, sf_dir).count() > 0
