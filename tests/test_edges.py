"""Month series, reviews and scopes against plain Python, with gaps, ties and hot keys."""

from __future__ import annotations

import calendar
import datetime
import json
import math
import random
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from covermart.fixed_values import SCOPE_COLUMNS
from covermart.operators import coverage as cov
from covermart.operators import monthly as mo
from covermart.operators import reviews as rv
from covermart.operators import scope as sc
from covermart.operators import timeintel as ti

DIMENSIONS = list(SCOPE_COLUMNS.values())
SCHEMA = (
    ", ".join(f"{d} string" for d in DIMENSIONS)
    + ", beneficiary_key string, registered_user_key string, master_contract_key string, "
    "gross_premium_usd double, net_premium_usd double, tpa_fee_usd double, uw_year int, "
    "member_start_date date, member_stop_date date, registration_date date"
)


def make_rows(n: int, seed: int) -> list[dict]:
    """A third of the rows belong to one member and one payer; many fields are missing."""
    pick = random.Random(seed)

    def day(first=2023, last=2025):
        return datetime.date(pick.randint(first, last), pick.randint(1, 12), pick.randint(1, 28))

    rows = []
    for i in range(n):
        hot = i % 3 == 0
        start = day() if pick.random() > 0.1 else None
        length = pick.choice([0, 5, 30, 31, 90, 365, 800, -40])
        stop = (start or day()) + datetime.timedelta(days=length)
        if pick.random() < 0.2:
            stop = stop.replace(day=calendar.monthrange(stop.year, stop.month)[1])
        row = {d: pick.choice([None, "Unassigned", "a", "b", "c"]) for d in DIMENSIONS}
        row["payer_name"] = "hot" if hot else pick.choice([None, "p1", "p2", "p3"])
        member = 0 if hot else pick.randint(1, n // 6)
        row["beneficiary_key"] = f"B{member}" if pick.random() > 0.1 else None
        row["registered_user_key"] = f"U{member // 2}" if pick.random() > 0.4 else None
        row["master_contract_key"] = pick.choice([None, "m1", "m2"])
        for money in ("gross_premium_usd", "net_premium_usd", "tpa_fee_usd"):
            row[money] = pick.choice([None, 0.0, pick.randint(1, 10**7) / 100])
        row["uw_year"] = pick.choice([None, 2023, 2024, 2025, 1800])
        row["member_start_date"] = start
        row["member_stop_date"] = stop if pick.random() > 0.1 else None
        row["registration_date"] = day(2022, 2025) if pick.random() > 0.3 else None
        rows.append(row)
    return rows


@pytest.fixture(scope="module")
def rows():
    return make_rows(600, 7)


@pytest.fixture(scope="module")
def policies(spark, rows):
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    values = [tuple(row[name] for name in names) for row in rows]
    return cov.coverage_dates(spark.createDataFrame(values, SCHEMA)).persist()


def months_of(row: dict) -> list[datetime.date]:
    year = row["uw_year"] if row["uw_year"] and 1900 <= row["uw_year"] <= 2100 else None
    start = row["member_start_date"] or (year and datetime.date(year, 1, 1))
    stop = row["member_stop_date"] or (year and datetime.date(year, 12, 31))
    if not start or not stop:
        return []
    stop = max(start, stop)
    ends, y, m = [], start.year, start.month
    while (y, m) <= (stop.year, stop.month):
        end = datetime.date(y, m, calendar.monthrange(y, m)[1])
        if end <= stop:
            ends.append(end)
        y, m = (y, m + 1) if m < 12 else (y + 1, 1)
    return ends


def test_month_series_matches_plain_python(rows, policies):
    members, users = defaultdict(set), defaultdict(set)
    money = defaultdict(lambda: [0, 0, 0])
    for row in rows:
        ends = months_of(row)
        for end in ends:
            keys = [("total", None, end)] + [
                (d, row[d] or "Unassigned", end) for d in mo.SERIES_DIMENSIONS
            ]
            for key in keys:
                money[key]
                if row["beneficiary_key"]:
                    members[key].add(row["beneficiary_key"])
                    registered = row["registration_date"]
                    if row["registered_user_key"] and (not registered or registered <= end):
                        users[key].add(row["registered_user_key"])
                for place, column in enumerate(mo.MONEY_COLUMNS):
                    if row[column] is not None:
                        money[key][place] += Fraction(round(row[column] * 1e6), len(ends))
    expected = {
        key: (
            len(members[key]), len(users[key]),
            *(math.floor(v + Fraction(1, 2)) / 1e6 for v in amounts),
        )
        for key, amounts in money.items()
    }
    found = {
        (r["dimension"], r["dimension_value"], r["month_end"]): tuple(
            r[c] for c in mo.SERIES_MEASURES
        )
        for r in mo.monthly_series(policies, mo.SERIES_DIMENSIONS).collect()
    }
    assert found == expected


def test_series_agrees_with_member_months(policies):
    months = cov.member_months(policies)
    counted = months.groupBy("month_end").agg(
        F.countDistinct("beneficiary_key").alias("m"),
        F.countDistinct(mo.registered_as_of(F.col("month_end"))).alias("u"),
    )
    series = mo.monthly_kpis(policies)
    assert sorted(map(tuple, counted.collect())) == sorted(
        map(tuple, series.select(*mo.SERIES_COLUMNS[:3]).collect())
    )


def test_additive_measures_of_every_dimension_sum_to_the_total(policies):
    metrics = mo.scoped_monthly_metrics(policies).persist()
    frames = mo.split_grouping_sets(metrics)
    total = {r["month_end"]: r["gross_premium_usd"] for r in frames["monthly_kpis"].collect()}
    for name, frame in frames.items():
        by_month = frame.groupBy("month_end").agg(F.sum("gross_premium_usd")).collect()
        assert {r[0]: pytest.approx(r[1]) for r in by_month} == total, name


def test_reviews_match_plain_python(rows, policies):
    groups = defaultdict(list)
    for row in rows:
        groups[row["payer_name"] or "Unassigned"].append(row)
    found = {r["payer_name"]: r for r in rv.payer_review_all(policies).collect()}
    assert set(found) == set(groups)
    for payer, group in groups.items():
        members = {r["beneficiary_key"] for r in group} - {None}
        users = {r["registered_user_key"] for r in group} - {None}
        linked = {r["beneficiary_key"] for r in group if r["registered_user_key"]} - {None}
        review = found[payer]
        assert (review["beneficiaries"], review["registered_users"]) == (
            len(members), len(users),
        )
        assert review["registered_beneficiaries"] == len(linked)
        gross = [r["gross_premium_usd"] for r in group if r["gross_premium_usd"] is not None]
        assert review["gross_premium_usd"] == pytest.approx(sum(gross))
    summary = rv.portfolio_summary(policies).first()
    assert summary["policy_records"] == len(rows)
    assert summary["master_contracts"] == 2


def test_empty_portfolio(policies):
    nothing = policies.where("false")
    summary = rv.latest_active(
        rv.portfolio_summary(nothing), mo.active_population(mo.monthly_kpis(nothing))
    ).first()
    assert summary["policy_records"] == summary["unique_beneficiaries"] == 0
    assert summary["gross_premium_usd"] == 0.0
    assert summary["latest_active_population"] == 0
    assert summary["latest_active_month"] is None
    assert rv.payer_review(nothing).isEmpty()
    assert mo.monthly_kpis(nothing).isEmpty()


def test_zero_and_missing_gross_have_no_ratio(spark, policies):
    zero = policies.withColumn("gross_premium_usd", F.lit(0.0))
    missing = policies.withColumn("gross_premium_usd", F.lit(None).cast("double"))
    for frame, gross in ((zero, 0.0), (missing, None)):
        for row in rv.payer_review_all(frame).collect():
            assert row["gross_premium_usd"] == gross
            assert row["net_to_gross_ratio"] is None
            assert row["tpa_to_gross_ratio"] is None


def test_scope_table_agrees_with_single_scopes(spark, policies):
    payloads = {
        "all": {"year_start": 2000, "year_end": 2100},
        "wide": {"year_start": -2_000_000_000, "year_end": 2_000_000_000},
        "one": {"year_start": 2023, "year_end": 2024, "payers": ["hot", "p1"]},
        "two": {"year_start": 2023, "year_end": 2025, "gender": ["a"], "payers": [" ", "p2"]},
        "null": {"year_start": 2023, "year_end": 2025, "policy_types": ["Unassigned"]},
        "none": {"year_start": 2023, "year_end": 2025, "payers": ["nobody"]},
        "year": {"year_start": 1800, "year_end": 1800},
        "back": {"year_start": 2025, "year_end": 2024},
    }
    table = spark.createDataFrame(
        [(k, json.dumps(v)) for k, v in payloads.items()], "scope_id string, scope_json string"
    )
    counts = dict(sc.match_scopes(policies, table).groupBy("scope_id").count().collect())
    for name, payload in payloads.items():
        single = sc.scope_filter(policies, sc.Scope.from_dict(payload)).count()
        assert counts.get(name, 0) == single, name
    table = table.unionByName(
        spark.createDataFrame(
            [("broken", "{nope"), ("missing", None), ("yearless", "{}")], table.schema
        )
    )
    summary = {r["scope_id"]: r for r in sc.scope_summary(policies, table).collect()}
    assert set(summary) == {*payloads, "broken", "missing", "yearless"}
    for name, payload in payloads.items():
        row = summary[name]
        single = sc.scope_filter(policies, sc.Scope.from_dict(payload))
        expected = rv.portfolio_summary(single).first()
        assert row["policy_records"] == single.count(), name
        assert row["beneficiaries"] == expected["unique_beneficiaries"], name
        assert row["gross_premium_usd"] == (expected["gross_premium_usd"] or 0.0), name
        assert row["problem"] == (sc.EMPTY_YEARS if name == "back" else None), name
    for name in ("broken", "missing", "yearless"):
        assert (summary[name]["policy_records"], summary[name]["problem"]) == (
            0, sc.UNREADABLE_SCOPE,
        )
    label = dict(
        sc.parse_scopes(table).select("scope_id", sc.scope_label().alias("l")).collect()
    )
    assert label["two"] == "payer: p2 | gender: a"
    assert sc.Scope.from_dict(sc.Scope.from_dict(payloads["two"]).as_dict()) == (
        sc.Scope.from_dict(payloads["two"])
    )


def test_changes_look_back_by_calendar_month(spark):
    day = datetime.date
    series = spark.createDataFrame(
        [
            (day(2024, 2, 29), 10, 5, 100.0, 0.0, 1.0),
            (day(2025, 1, 31), 8, 0, 50.0, 0.0, 2.0),
            (day(2025, 2, 28), 12, 6, 75.0, 9.0, 3.0),
        ],
        "month_end date, active_population long, active_registered_users long, "
        "gross_premium_usd double, net_premium_usd double, tpa_fee_usd double",
    )
    found = {r["metric"]: r for r in ti.kpi_latest_mom_yoy(series).collect()}
    population = found["active_population"]
    assert (population["value"], population["mom"]) == (12.0, 0.5)
    assert population["yoy"] == pytest.approx(0.2)
    assert found["active_registered_users"]["mom"] is None  # from zero
    assert found["net_premium_usd"]["yoy"] is None
    assert found["app_penetration"]["value"] == 0.5


def test_no_money_is_lost_in_months(spark):
    """Many small policies whose money does not divide by their months."""
    start, stop = datetime.date(2030, 2, 1), datetime.date(2030, 8, 31)  # seven months
    policies = spark.range(300_000).select(
        *[F.lit("x").alias(d) for d in DIMENSIONS],
        F.col("id").cast("string").alias("beneficiary_key"),
        F.lit(None).cast("string").alias("registered_user_key"),
        F.lit("m").alias("master_contract_key"),
        F.lit(0.01).alias("gross_premium_usd"), F.lit(1.0).alias("net_premium_usd"),
        F.lit(20_000_000_000_000.0).alias("tpa_fee_usd"), F.lit(2030).alias("uw_year"),
        F.lit(start).alias("member_start_date"), F.lit(stop).alias("member_stop_date"),
        F.lit(None).cast("date").alias("registration_date"),
    )
    policies = cov.coverage_dates(policies)
    monthly = mo.monthly_kpis(policies).collect()
    assert len(monthly) == 7
    assert round(sum(r["gross_premium_usd"] for r in monthly), 2) == 3000.0
    assert round(sum(r["net_premium_usd"] for r in monthly), 2) == 300_000.0
    assert sum(r["tpa_fee_usd"] for r in monthly) == pytest.approx(6e18)
    one = cov.member_months(policies.limit(1)).orderBy("month_end").collect()
    assert [r["gross_premium_usd"] for r in one] == [0.001429] * 4 + [0.001428] * 3
