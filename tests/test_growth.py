"""What keeps work in proportion to the tables: one pass, narrow rows, equal things once."""

from __future__ import annotations

import datetime
import json
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from covermart.functions import money
from covermart.operators import monthly as mo
from covermart.operators import reviews as rv
from covermart.operators import scope as sc
from covermart.operators.coverage import coverage_dates, covered_span
from covermart.plans import answers as an
from covermart.plans import batch
from covermart.plans import questions as qu
from fixture_queries import tables
from fixture_queries.registry import QUERIES
from test_plans import plan_of
from test_questions import TABLES, store


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return store(spark, str(tmp_path_factory.mktemp("aggregates")), TABLES)


def asked(spark, rows):
    return spark.createDataFrame(rows, "question_id string, question string")


REPEATED = [
    ("a", "Bolm Care gross premium"), ("b", "Bolm  Care gross premium "), ("c", "Colm Care adoption"),
    ("d", "Colm Care adoption"), ("d", "Colm Care adoption"), ("e", "Colm Care adoption"),
    ("f", "Bolm Care gross premium"), ("f", "Colm Care adoption"), ("g", " "), ("h", None),
    (None, "Bolm Care gross premium"), (None, "Bolm Care gross premium"), (None, "Colm Care adoption"),
]


def test_equal_questions_are_routed_once_and_answered_each(spark, folder, tmp_path):
    questions = asked(spark, REPEATED)
    batch.store_questions(spark, questions, str(tmp_path))
    distinct = batch.read_distinct(spark, str(tmp_path))
    assert distinct.where("question_id IS NOT NULL AND once").count() == 5  # a b, c e, d, f f
    catalog = batch.catalog_of(spark, folder)
    summary, values = batch.read_aggregates(spark, folder)["summary"], batch.read_values(spark, folder)
    whole = an.answer_questions(
        batch.evidence_of(spark, qu.route_questions(questions, catalog), folder).persist(), values, summary
    )
    routed = qu.route_questions(distinct, catalog, batch.ASKED)
    found = an.answer_questions(batch.evidence_of(spark, routed, folder).persist(), values, summary)
    each = batch.for_all_questions(spark, found.where("once").drop("question_id"), str(tmp_path))
    columns = ["question_id", "question", "question_focus", "payers", "evidence", "answer"]
    shown = lambda frame: sorted(str(r) for r in frame.select(*columns).collect())
    assert len(shown(each)) == 11
    assert shown(each) == shown(whole)


def test_more_askers_leave_the_routed_table_as_it_is(spark, tmp_path):
    few = [(f"q{i}", f"question {i % 3}") for i in range(6)]
    many = [(f"q{i}", f"question {i % 3}") for i in range(600)]
    for name, rows, size in (("few", few, 6), ("many", many, 600)):
        batch.store_questions(spark, asked(spark, rows), f"{tmp_path}/{name}")
        assert batch.read_distinct(spark, f"{tmp_path}/{name}").count() == 3
        found = batch.read_distinct(spark, f"{tmp_path}/{name}").where("once").select("asked", F.lit(1).alias("x"))
        assert batch.for_all_questions(spark, found, f"{tmp_path}/{name}").count() == size


def test_often_asked_questions_are_no_hot_key(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(batch, "DEALT_ROWS", 10)
    rows = [(f"q{i}", "which one" if i % 2 else f"question {i % 40}") for i in range(400)]
    rows += [(None, "which one"), ("q1", "which one"), ("q2", "which one"), ("x", "which one"), ("x", "which one")]
    batch.store_questions(spark, asked(spark, rows), str(tmp_path))
    often = spark.read.parquet(f"{tmp_path}/often").collect()
    assert [row["deals"] for row in often] == [20]  # of q1, q3 and so on but for q1 itself, asked twice
    found = batch.read_distinct(spark, str(tmp_path)).where("once").select(
        "asked", F.explode(F.array(F.lit(1), F.lit(2))).alias("cell"), F.col("question").alias("text")
    )
    each = batch.for_all_questions(spark, found, str(tmp_path))
    assert each.columns == ["question_id", "question", "cell", "text"]
    expected = [(i, t, c, t) for i, t in rows for c in (1, 2)]
    assert sorted(map(str, each.collect())) == sorted(str(_row(r)) for r in expected)
    assert re.search(r"Join .*asked#.*deal#", each._jdf.queryExecution().optimizedPlan().toString())


def _row(values):
    return Row(question_id=values[0], question=values[1], cell=values[2], text=values[3])


def policies(spark, n=40):
    rows = [
        (1996 + i % 3, f"p{i % 4}", f"m{i % 7}" if i % 5 else None, f"u{i % 3}" if i % 2 else None,
         float(i) if i % 6 else None, 0.5 * i, None)
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows,
        "uw_year int, payer_name string, beneficiary_key string, registered_user_key string, "
        "gross_premium_usd double, net_premium_usd double, tpa_fee_usd double",
    )


def test_equal_scopes_are_looked_up_once(spark):
    one = json.dumps({"year_start": 1996, "year_end": 1998, "payers": ["p1"]})
    two = json.dumps({"year_start": 1996, "year_end": 1997, "payers": ["p2"]})
    rows = [(f"s{i}", (one, two)[i % 2]) for i in range(20)]
    rows += [("both", one), ("both", two), ("twice", one), ("twice", one), (None, one)]
    scopes = spark.createDataFrame(rows, "scope_id string, scope_json string")
    assert sc._first_of_equal(scopes).count() == 6  # s0, s1, both twice, twice twice
    found = {}
    for row in sc.scope_summary(policies(spark), scopes).collect():
        found.setdefault(row["scope_id"], []).append((row["policy_records"], row["beneficiaries"]))
    single = {name: policies(spark).where(test) for name, test in (("s0", "payer_name = 'p1'"), ("s1", "payer_name = 'p2' AND uw_year < 1998"))}
    for name, frame in single.items():
        members = frame.where("beneficiary_key IS NOT NULL").select("beneficiary_key").distinct().count()
        for i in range(int(name[1]), 20, 2):
            assert found[f"s{i}"] == [(frame.count(), members)]
    assert found["twice"] == [(2 * found["s0"][0][0], found["s0"][0][1])] * 2
    assert [n for n, _ in found["both"]] == [found["s0"][0][0] + found["s1"][0][0]] * 2
    assert found[None] == [(0, 0)]


@pytest.mark.parametrize("name", ["premium_by_year", "payer_review_all", "age_bucket_review"])
def test_reviews_read_the_source_once_and_narrow(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert len(re.findall(r"FileScan parquet \[[^\]]*l_orderkey", plan)) == 1
    assert "policy_records" not in re.sub(r"policy_records#", "", plan).partition("Location")[2]
    assert "o_orderpriority" not in plan


def test_reviews_keep_groups_without_keys_or_amounts(spark):
    rows = policies(spark).where("payer_name = 'p0'").withColumns(
        {"beneficiary_key": F.lit(None).cast("string"), "gross_premium_usd": F.lit(None).cast("double")}
    )
    row = rv.payer_review_all(rows).first()
    assert (row["beneficiaries"], row["gross_premium_usd"], row["tpa_fee_usd"]) == (0, None, None)
    assert row["net_premium_usd"] == rows.agg(F.sum("net_premium_usd")).first()[0]
    empty = rv.portfolio_summary(rows.where("false").withColumn("master_contract_key", F.lit("c"))).collect()
    assert [(r["policy_records"], r["gross_premium_usd"]) for r in empty] == [(0, 0.0)]


def test_months_are_computed_below_their_filter(spark, sf_dir):
    plan = plan_of(mo.monthly_country_kpis(tables.dated_policies(spark, sf_dir)))
    for line in plan.split("\n"):
        if "Join " in line:
            assert "last_day" not in line
    day = datetime.date
    rows = [(1, None, day(2020, 2, 29)), (2, day(2020, 1, 5), None), (3, day(2020, 1, 5), day(2020, 2, 28)),
            (4, day(2020, 1, 5), day(2020, 2, 29)), (5, day(2020, 1, 5), day(2020, 1, 9))]
    dated = spark.createDataFrame(rows, "id int, member_start_date date, member_stop_date date")
    spans = covered_span(coverage_dates(dated.withColumn("uw_year", F.lit(None).cast("int"))))
    assert [(r["id"], r["month_count"]) for r in spans.orderBy("id").collect()] == [(3, 1), (4, 2)]


def test_covered_months_are_not_stored_for_aggregates(spark, sf_dir):
    from fixture_queries.monthly_queries import _mart

    assert {entry["table"] for entry in _mart(spark, sf_dir).manifest}.isdisjoint({"member_months"})
    plan = plan_of(QUERIES["apportion"](spark, sf_dir))
    assert "member_months" not in plan and "n_name" not in plan


def test_policies_are_stored_without_being_moved(spark, tmp_path):
    from covermart.sources.sinks import write_by_year

    rows = spark.range(40, numPartitions=4).selectExpr("id", "cast(1996 + id % 2 AS int) AS uw_year")
    for gather, files in ((True, 2), (False, 8)):
        write_by_year(rows, f"{tmp_path}/{gather}", gather)
        back = spark.read.parquet(f"{tmp_path}/{gather}")
        assert (back.count(), len(back.inputFiles())) == (40, files)


def test_money_of_all_reviews_comes_from_three_groups(spark):
    rows = policies(spark).withColumns(
        {
            "network_type": F.when(F.col("net_premium_usd") % 2 == 0, "A"),
            "master_contract": F.when(F.col("net_premium_usd") % 3 != 0, "C"),
            "master_contract_key": F.lit("c"),
            "age_bucket": F.when(F.col("uw_year") != 1997, "old"),
            "policy_type": F.when(F.col("net_premium_usd") > 5, F.col("payer_name")),
        }
    )
    summed = rv._money_totals(rows)
    text = summed._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Generate inline\(array\(.*part.*part.*part", text)
    frames = rv.review_frames(rv.review_measures(rows))
    for name, alone in (
        ("summary", rv.portfolio_summary), ("premium_by_year", rv.premium_by_year),
        ("payer_review_all", rv.payer_review_all), ("age_bucket_review", rv.age_bucket_review),
        ("policy_type_review_all", rv.policy_type_review_all), ("payer_network_premium", rv.payer_network_premium),
        ("master_contract_network_premium", rv.contract_network_premium),
    ):
        assert frames[name].collect() == alone(rows).select(*frames[name].columns).collect(), name


def test_parts_of_amounts_add_up_as_decimals_do(spark):
    amounts = [
        None, 0.0, -0.0, 0.125, -0.0000005, 1.5e-7, 4503599627.370495, 4503599627.370496, -4503599627.370497, 9.3e12,
        -98765432109876.25, 1.2345678912345678e19, -7.77e21, 9.9e21, 1e22, 1e30, float("nan"), float("inf"),
    ]
    rows = spark.createDataFrame([(i % 5, a) for i, a in enumerate(amounts)] + [(5, None)], "k int, usd double")
    for keys in (("k", "usd"), ("k",), ()):
        sums = rows.groupBy(*keys).agg(money.sum_micro(money.micro(F.col("usd"))).alias("sum"))
        parts = rows.select("*", *money.micro_parts("usd")).groupBy(*keys).agg(money.sum_parts("usd").alias("sum"))
        assert parts.schema["sum"].dataType == sums.schema["sum"].dataType
        assert sorted(map(str, parts.collect())) == sorted(map(str, sums.collect()))


def test_keys_of_few_groups_are_made_of_members_not_of_policies(spark):
    wide = policies(spark).withColumns(
        {c: F.col("payer_name") for c in ("age_bucket", "policy_type", "master_contract", "master_contract_key", "network_type")}
    )
    plan = rv.review_measures(wide)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    made = [i for i, line in enumerate(plan) if "Generate inline" in line and "beneficiary_key" in line and "uw_year" in line]
    assert len(made) == 1
    assert any("Aggregate [" in line for line in plan[made[0] + 1 : made[0] + 4])
    other = [line for line in plan if "Generate inline" in line and "payer_name" in line and "beneficiary_key" in line]
    assert len(other) == 1 and "uw_year" not in other[0]
    text = "\n".join(plan)
    assert "sum(gross_premium_usd_0" in text and not re.search(r"sum\(try_cast", text)
    runs = mo.money_runs(wide.selectExpr("*", "1 AS first_month", "2 AS last_month"), ())
    assert "gross_premium_usd_3" in runs._jdf.queryExecution().optimizedPlan().toString()
