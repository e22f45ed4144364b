"""Readers, header rules, cleaning rules and the synthetic extract."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from covermart import fixed_values as fv
from covermart.functions import clean
from covermart.operators.options import filter_options
from covermart.operators.scope import Scope
from covermart.plans.mart import Mart, build_mart
from covermart.plans.snapshot import snapshot
from covermart.sources import extract as ex
from covermart.sources.sinks import write_csv
from covermart.sources.synthetic import synthetic_extract


def test_unknown_suffix_and_missing_columns_are_errors(spark):
    with pytest.raises(ValueError, match="Cannot read"):
        ex.read_extract(spark, "/data/extract.xlsx")
    bare = spark.createDataFrame([("b", "1")], "beneficiary_key string, gross_premium_usd string")
    with pytest.raises(ValueError, match="net_premium_usd, tpa_fee_usd, uw_year"):
        ex.typed_projection(bare)


def test_missing_path_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        ex.read_extract(spark, f"{tmp_path}/none.csv")


@pytest.mark.parametrize(
    ("line", "expected"),
    [("a,b;c", ","), ("a;b;c,d", ";"), ("a|b|c", "|"), ("a\tb\tc,d", "\t"), ("plain", ",")],
)
def test_delimiter_of(spark, line, expected):
    frame = spark.createDataFrame([(line,)], "line string")
    assert frame.select(ex.delimiter_of(F.col("line"))).first()[0] == expected


def test_later_duplicate_header_wins(spark):
    raw = spark.createDataFrame([(1, 2, 3)], ["Payer Name", " payer--NAME ", "x"])
    assert ex.normalize_headers(raw).first().asDict() == {"payer_name": 2, "x": 3}


def test_exactly_repeated_header_keeps_the_first_column(spark, tmp_path):
    (tmp_path / "twice.csv").write_text("payer_name,payer_name,x\nA,B,1\n")
    read = ex.read_extract(spark, f"{tmp_path}/twice.csv")
    assert ex.resolve_aliases(read).first()["payer_name"] == "A"


def test_long_and_short_rows(spark, tmp_path):
    (tmp_path / "ragged.csv").write_text('a,b,c\n1,2\n1,2,3,4\n"x, ""y""",,z\n')
    read = ex.read_extract(spark, f"{tmp_path}/ragged.csv")
    assert [tuple(r) for r in read.collect()] == [
        ("1", "2", None), ("1", "2", "3"), ('x, "y"', None, "z"),
    ]


DATES = {
    "2026-03-08": datetime.date(2026, 3, 8),
    "2026/03/08": datetime.date(2026, 3, 8),
    "2026 3 8": datetime.date(2026, 3, 8),
    "2026-03-08 10:11:12": datetime.date(2026, 3, 8),
    "2026-03-08T10:11:12.5": datetime.date(2026, 3, 8),
    "1 01 2026": datetime.date(2026, 1, 1),
    "31/12/2025": datetime.date(2025, 12, 31),
    "2026": None,
    "2026-03": None,
    "2026-02-30": None,
    "31 02 2026": None,
    "2026-03-08 junk": None,
    " <NA> ": None,
    "none": None,
}
NUMBERS = {
    "$1,234.50": 1234.5, "12 USD": 12.0, "1e3": 1000.0, ".5": 0.5, "-3": -3.0, "5d": None,
    "(5)": None, "": None, " NaN ": None, "12usd": None, "1.2.3": None,
}
INTEGERS = {"2024.7": 2025, "2025.5": 2026, "-3.5": -4, "2024.0": 2024, "1e12": None}
TEXTS = {" a b ": "a b", "  None": None, "\ta": "\ta", "NA": None, "nano": "nano"}


@pytest.mark.parametrize(
    ("parser", "cases"),
    [
        (clean.parse_date, DATES),
        (clean.parse_number, NUMBERS),
        (clean.parse_integer, INTEGERS),
        (clean.clean_text, TEXTS),
        (clean.clean_text, {"\u00a0 x\u3000": "x", "\u2003": None}),
    ],
)
def test_parsers(spark, parser, cases):
    frame = spark.createDataFrame([(k,) for k in cases], "raw string")
    parsed = dict(frame.select("raw", parser(F.col("raw"))).collect())
    assert parsed == cases


def test_synthetic_extract_amounts_and_coverage(spark, tmp_path):
    rows = {r["index"]: r for r in synthetic_extract(spark).collect()}
    assert len(rows) == 288
    number = fv.SYNTHETIC_FIRST_RECORD
    for year in fv.SYNTHETIC_YEARS:
        for payer in range(6):
            for member in range(16):
                gross = round((285 + payer * 68 + member * 19) * (1 + (year - 2024) * 0.06), 2)
                row = rows[number]
                assert row["gross_premium_usd"] == gross
                rate = 0.87 + ((member + payer) % 4) * 0.015
                assert row["net_premium_usd"] == round(gross * rate, 2)
                fee = 0.035 + ((member + payer) % 3) * 0.006
                assert row["tpa_usd"] == round(gross * fee, 2)
                number += 1
    write_csv(synthetic_extract(spark), f"{tmp_path}/synthetic.csv")
    build_mart(spark, f"{tmp_path}/synthetic.csv", f"{tmp_path}/mart")
    mart = Mart(spark, f"{tmp_path}/mart")
    counts = dict(
        filter_options(mart.table("policy_records")).groupBy("dimension").count().collect()
    )
    expected = {
        "payer_country": 6, "payer_name": 6, "service_provider": 6, "master_contract": 12,
        "policy_type": 3, "policy_type_detail": 3, "licensing_authority": 5, "network_type": 3,
        "network_group": 3, "payer_type": 3, "server_name": 6, "app_name": 3, "dependency": 4,
        "nationality": 10, "marital_status": 3, "gender": 2, "dependent_status": 2,
        "age_profile": 3, "age_bucket": 6,
    }
    assert all(counts[d] >= least for d, least in expected.items())
    scope = Scope.from_dict(
        {"year_start": 2025, "year_end": 2026, "payers": ["Bupa"],
         "age_buckets": ["30-39"], "network_groups": ["Premium"]}
    )
    frames = snapshot(mart, scope)
    assert frames["summary"].first()["policy_records"] > 0
    assert all(
        not frames[n].isEmpty()
        for n in ("active_population", "monthly_country_kpis", "monthly_network_type_kpis",
                  "monthly_network_group_kpis", "monthly_policy_type_kpis")
    )
