"""Routing, evidence and answers on invented aggregates, wider than any list that is shown."""

from __future__ import annotations

import calendar
import datetime
import itertools
import json

import pytest
from pyspark.sql import functions as F

from covermart.plans import answers as an
from covermart.plans import evidence as ev
from covermart.plans import questions as qu
from covermart.plans.batch import (
    answer_batch,
    catalog_of,
    evidence_of,
    read_aggregates,
    read_values,
    store_values,
)

MONEY = "gross_premium_usd double, net_premium_usd double, tpa_fee_usd double"
RATES = "app_penetration_rate double, net_to_gross_ratio double, tpa_to_gross_ratio double"
COUNTS = "beneficiaries long, registered_users long, registered_beneficiaries long"
LETTERS = "abdefgkmnprsuvz"
PAYERS = [f"{x}olm Care" for x in "BCDFGHJKLMNPRTW"]  # fifteen, largest premium first
TYPES = [f"Plan {a}{b}" for a, b in itertools.product("KLMNO", "aeiou")]  # twenty-five
COUNTRIES = [f"Ter{a}{b}ia" for a, b in itertools.product(LETTERS, "aeiou ".strip() + "y")][:80]
MONTHS = [
    datetime.date(y, m, calendar.monthrange(y, m)[1]) for y in (2031, 2032, 2033) for m in range(1, 13)
][:30]


def review(name: str, members: int, users: int, gross: float) -> tuple:
    net, fee = gross * 0.75, gross * 0.125
    return name, members, users, users, gross, net, fee, users / members, 0.75, 0.125


PAYER_ROWS = [review(p, 200, 40 + 10 * i, 64_000.0 - 4_000 * i) for i, p in enumerate(PAYERS)]
TABLES = {
    "summary": (
        "policy_records long, unique_beneficiaries long, master_contracts long, "
        f"registered_users long, registered_beneficiaries long, {MONEY}, "
        "latest_active_population long, latest_active_month date",
        [(4100, 3000, 3, 1650, 1600, 540_000.0, 405_000.0, 67_500.0, 2480, MONTHS[-1])],
    ),
    "monthly_kpis": (
        f"month_end date, active_population long, active_registered_users long, {MONEY}",
        [(m, 1900 + 20 * i, 800 + 10 * i, 1000.0 + i, 750.0, 125.0) for i, m in enumerate(MONTHS)],
    ),
    "monthly_country_kpis": (
        "month_end date, payer_country string, active_population long, "
        "active_registered_users long",
        [(m, c, 100 + k + i, 50 + k) for i, m in enumerate(MONTHS) for k, c in enumerate(COUNTRIES)],
    ),
    "premium_by_year": (
        f"uw_year int, beneficiaries long, {MONEY}",
        [(2031, 1400, 250_000.0, 187_500.0, 31_250.0), (2032, 1600, 290_000.0, 217_500.0, 36_250.0)],
    ),
    "payer_review": (f"payer_name string, {COUNTS}, {MONEY}, {RATES}", PAYER_ROWS),
    "master_contract_network_premium": (
        "master_contract string, network_type string, gross_premium_usd double",
        [("Quarry Crew", "Near", 700.0), ("Quarry Crew", "Far", 900.0), ("Mill Hands", "Near", 1200.0)]
        + [(f"Yard {x}", "Near", 10.0 + k) for k, x in enumerate("ABCDEFGHIJKLMN")],
    ),
    "age_bucket_review": (
        f"age_bucket string, {COUNTS}, {MONEY}, {RATES}",
        [review("0-24", 900, 630, 100.0), review("25-54", 1500, 1200, 300.0), review("55-99", 600, 90, 140.0)],
    ),
    "policy_type_review": (
        f"policy_type string, beneficiaries long, {MONEY}",
        [(t, 50, 9000.0 - 100 * i, 50.0, 90.0 + i) for i, t in enumerate(TYPES)],
    ),
    "mobile_by_payer": (
        "payer_name string, unique_beneficiaries long, unique_registered_users long, "
        "linked_beneficiaries long, registered_user_penetration double, "
        "linked_beneficiary_coverage double",
        [(p, 200, 40 + 10 * i, 40, (40 + 10 * i) / 200, 0.2) for i, p in enumerate(PAYERS)],
    ),
}
QUESTIONS = {
    "two": f"Is {PAYERS[3]} ahead of {PAYERS[9]} in digital registration?",
    "lagging": "Which payer is lagging on mobile adoption?",
    "contracts": "Rank every master contract by gross premium.",
    "ages": "What is the weakest age group for app penetration?",
    "last_type": f"TPA ratio for {TYPES[-1]}",
    "countries": "Active population by country",
    "country_trend": "Active population trend by country",
    "named_trend": f"Population growth in {COUNTRIES[0]}, {COUNTRIES[40]} and {COUNTRIES[79]}",
    "named": f"Active members of {COUNTRIES[5]} and {COUNTRIES[6]}",
    "year": "Population by country in 2032",
    "far_year": "Active population trend in 2090",
    "long": "please " * 200 + f"show the gross premium of {PAYERS[14]}",
    "gaps": "Premium of Oak Unlisted in every market of Nowhere Isle",
    "vague": "  Tell \t us something. ",
    "blank": " \n ",
}


def store(spark, path: str, tables: dict) -> str:
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}")
    spark.createDataFrame(
        [("payer_name", "Oak Unlisted"), ("payer_country", "Nowhere Isle"), ("gender", "X")],
        "dimension string, value string",
    ).write.parquet(f"{path}/filter_options")
    store_values(spark, path)
    return path


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return store(spark, str(tmp_path_factory.mktemp("aggregates")), TABLES)


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame(list(QUESTIONS.items()), "question_id string, question string")


@pytest.fixture(scope="module")
def answered(spark, folder, questions):
    routed = qu.route_questions(questions, catalog_of(spark, folder)).persist()
    evidence = evidence_of(spark, routed, folder).persist()
    summary = read_aggregates(spark, folder)["summary"]
    frame = an.answer_questions(evidence, read_values(spark, folder), summary)
    frame = frame.withColumn("context", an.context_json(F.lit("All portfolio")))
    frame = frame.withColumn("prompt", an.prompt_text(F.col("question"), F.col("context")))
    return {r["question_id"]: r.asDict(recursive=True) for r in frame.collect()}


def tables_of(row) -> dict[str, list[dict]]:
    return json.loads(row["context"])["evidence"]


def test_named_entities_are_compared_with_each_other(answered):
    row = answered["two"]
    assert sorted(row["payers"]) == sorted([PAYERS[3], PAYERS[9]])
    assert row["question_focus"] == "Payer digital-adoption comparison"
    evidence = tables_of(row)
    assert sorted(r["payer_name"] for r in evidence["payer_review"]) == sorted([PAYERS[3], PAYERS[9]])
    assert PAYERS[0] not in row["context"]
    assert (
        f"{PAYERS[9]} leads {PAYERS[3]} on app penetration: 65.0% versus 35.0%, "
        "a 30.0 percentage points gap."
    ) in row["answer"]


def test_extremes_cover_entities_that_are_not_listed(answered):
    row = answered["lagging"]
    listed = [r["payer_name"] for r in tables_of(row)["payer_review"]]
    assert listed == PAYERS[:12]  # the twelve weakest are shown
    assert (
        f"{PAYERS[14]} leads {PAYERS[0]} on app penetration: 90.0% versus 20.0%" in row["answer"]
    )
    assert f"plan for {PAYERS[0]}" in row["answer"]
    for payer in PAYERS[:14]:
        assert f"{payer} leads" not in row["answer"]
    contracts = answered["contracts"]
    names = {r["master_contract"] for r in tables_of(contracts)["master_contract_network_premium"]}
    assert len(names) == 12 and "Yard A" not in names
    assert "Quarry Crew is largest on gross premium at $1.6k; Yard A is at $10." in contracts["answer"]
    assert "25-54 leads 55-99 on app penetration: 80.0% versus 15.0%" in answered["ages"]["answer"]


def test_every_policy_type_has_evidence(answered):
    row = answered["last_type"]
    assert row["policy_types"] == [TYPES[-1]]
    assert [r["policy_type"] for r in tables_of(row)["policy_type_review"]] == [TYPES[-1]]
    assert row["limitations"] == []


def test_countries_are_cut_by_months_only(answered):
    def of(name):
        return tables_of(answered[name])["monthly_country_kpis"]

    last = f"{MONTHS[-1]}T00:00:00"
    assert {(r["payer_country"], r["month_end"]) for r in of("countries")} == {
        (c, last) for c in COUNTRIES
    }
    assert len(of("country_trend")) == 24 * 80
    assert len(of("named_trend")) == 24 * 3
    assert {r["month_end"] for r in of("named")} == {last} and len(of("named")) == 2
    assert len(of("year")) == 12 * 80
    months = tables_of(answered["far_year"])["monthly_kpis"]
    assert len(months) == 24  # no such year: the trend word decides


def test_long_questions_are_read_to_their_end(answered):
    row = answered["long"]
    assert row["payers"] == [PAYERS[14]] and len(row["question"]) > 1400
    assert tables_of(row)["payer_review"][0]["gross_premium_usd"] == 8000.0


def test_every_gap_is_reported(answered):
    row = answered["gaps"]
    assert "payer_review" not in tables_of(row)
    assert len(row["limitations"]) >= 3
    for gap in row["limitations"]:
        assert f"- Limitation: {gap}" in row["answer"]


def test_unclear_and_blank_questions(answered):
    row = answered["vague"]
    assert row["question"] == "Tell us something."
    assert (row["intents"], row["question_focus"]) == (["portfolio"], "Portfolio review")
    assert set(tables_of(row)) == {"summary", "premium_by_year", "payer_review"}
    assert "blank" not in answered


def test_prompts_hold_the_whole_context(answered):
    for row in answered.values():
        parsed = json.loads(row["prompt"].split("Aggregate evidence (JSON):\n")[1])
        assert parsed == json.loads(row["context"])
        assert list(parsed) == sorted(parsed)
        for rows in parsed["evidence"].values():
            assert all(list(r) == sorted(r) for r in rows)
        assert row["question"] in row["prompt"]
    assert max(len(row["prompt"]) for row in answered.values()) > 100_000


def test_rankings_and_missing_measures(spark):
    schema = TABLES["mobile_by_payer"][0]
    rows = [("b", 5, 1, 1, 0.2, 0.2), ("a", 5, 1, 1, 0.2, 0.2), ("c", 9, 0, 0, None, None)]
    ranked = ev.rankings(spark.createDataFrame(rows, schema), "mobile_by_payer")
    places: dict = {}
    for row in ranked.orderBy("place").collect():
        places.setdefault(row["ranking"], []).append(row["payer_name"])
    assert places == {
        "adoption:asc": ["a", "b", "c"], "adoption:desc": ["a", "b", "c"], "listed": ["c", "a", "b"],
    }


def test_batches_keep_their_own_values(spark, folder, questions, tmp_path):
    other = dict(TABLES)
    schema, (first, *rest) = TABLES["payer_review"]
    other["payer_review"] = (schema, [review(PAYERS[0], 10, 5, 123.0), *rest])
    second = store(spark, f"{tmp_path}/second", other)
    asked = questions.where("question_id IN ('two', 'lagging', 'blank')")
    for source in (folder, second):
        answer_batch(
            spark, asked, source, f"{tmp_path}/work", f"{tmp_path}/records",
            scope="all of it", scope_json="{}",
        )
    saved = spark.read.parquet(f"{tmp_path}/records")
    assert len(saved.columns) == 25  # twenty-three fields and the folders of date and batch
    rows = saved.orderBy("timestamp_utc").collect()
    assert len(rows) == 4 and len({r["interaction_id"] for r in rows}) == 4
    assert {(r["schema_version"], r["scope"]) for r in rows} == {(4, "all of it")}
    assert all(r["timestamp_utc"].date() == r["date"] for r in rows)
    paths = list(dict.fromkeys(json.loads(r["all_aggregate_metrics_json"])["values_path"] for r in rows))
    assert len(paths) == 2
    gross = []
    for path in paths:
        values = spark.read.parquet(path)
        names = {r["table_name"] for r in values.select("table_name").distinct().collect()}
        assert names == {*TABLES, "active_population", "metadata"}
        own = [json.loads(r["row_json"]) for r in values.where("table_name = 'payer_review'").collect()]
        gross.append({r["payer_name"]: r["gross_premium_usd"] for r in own}[PAYERS[0]])
    assert gross == [64_000.0, 123.0]


def test_a_batch_written_again_leaves_one_copy(spark, folder, questions, tmp_path):
    asked = questions.where("question_id IN ('two', 'lagging', 'blank')")
    places = (folder, f"{tmp_path}/work", f"{tmp_path}/records")
    first = answer_batch(spark, asked, *places, batch="b1")
    before = sorted(map(str, spark.read.parquet(places[2]).collect()))
    # an attempt that died after it began, and one that runs through
    spark.range(1).where("id < 0").selectExpr("current_timestamp() AS started").write.parquet(
        f"{tmp_path}/work/batch-b2/started"
    )
    assert answer_batch(spark, asked, *places, batch="b2") == "b2"
    assert (first, answer_batch(spark, asked, *places, batch="b1")) == ("b1", "b1")
    saved = spark.read.parquet(places[2])
    assert sorted(map(str, saved.where("batch = 'b1'").collect())) == before
    assert saved.count() == 4 and saved.select("interaction_id").distinct().count() == 4


def test_evidence_is_not_searched_in_arrays(spark, folder, questions):
    """Values come from joins: no filter over evidence rows, whatever the number of tables."""
    evidence = evidence_of(spark, qu.route_questions(questions, catalog_of(spark, folder)), folder)
    evidence.write.mode("overwrite").parquet(f"{folder}/plan_check")
    stored = spark.read.parquet(f"{folder}/plan_check")
    summary = read_aggregates(spark, folder)["summary"]
    plan = an.answer_questions(stored, read_values(spark, folder), summary).select("question_id", "answer")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(evidence" not in text
    assert text.count("cells") <= 1  # rows are read by their keys alone


def test_a_name_in_half_of_the_questions_is_no_hot_key(spark, folder):
    """Large dictionaries: the same entities, the questions of one name dealt over the copies."""
    asked = spark.createDataFrame(
        [(f"q{k}", f"premium of {PAYERS[3] if k % 2 else PAYERS[k % 15]} and payer {k} again") for k in range(800)],
        "question_id string, question string",
    )
    catalog = catalog_of(spark, folder)
    normal = qu.normalize_questions(asked)
    want = {r["question_id"]: r["payers"] for r in qu.match_entities(normal, catalog).collect()}
    got = qu.match_entities(normal, catalog, broadcast_bytes=0)
    assert {r["question_id"]: r["payers"] for r in got.collect()} == want
    assert all(want[f"q{k}"] == [PAYERS[3]] for k in range(1, 800, 2))
    plan = qu.match_entities(normal, catalog)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    phrases = catalog.select(qu.normalize_phrase(F.col("value")).alias("phrase"), "value")
    runs = normal.select("question_id", F.explode(F.array(F.lit(PAYERS[3].lower()), F.lit("no such name"))).alias("phrase"))
    met = qu._named_phrases(runs.where("question_id LIKE '%1'"), phrases, small=False)
    sizes = met.select(F.pmod(F.xxhash64("question_id"), F.lit(qu.SALTS)).alias("s")).groupBy("s").count().collect()
    assert sum(r["count"] for r in sizes) == 80 and len(sizes) == qu.SALTS
    assert max(r["count"] for r in sizes) <= 3 * 80 / qu.SALTS
