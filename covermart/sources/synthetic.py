"""A deterministic synthetic extract of any size.

Every field follows from the row number by modular arithmetic, so rows are made in
parallel and no row depends on another. The small domains are literal arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from covermart.fixed_values import (
    SYNTHETIC_APPS,
    SYNTHETIC_FIRST_RECORD,
    SYNTHETIC_NETWORK_GROUPS,
    SYNTHETIC_PAYER_TYPES,
    SYNTHETIC_PAYERS,
    SYNTHETIC_PRODUCTS,
    SYNTHETIC_PROFILES,
    SYNTHETIC_YEARS,
)

MAX_ROWS_PER_PAYER = len(SYNTHETIC_PROFILES)


def _pick(domain: tuple, place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in domain]), place.cast("int") + 1)


def _cents(amount: Column) -> Column:
    """Rounded to cents by the exact value of the double.

    ``round`` works on the shortest decimal text instead, which turns 357.765 up although
    the double is a little below it.
    """
    return F.call_function("format_number", amount, F.lit("0.00")).cast("double")


def synthetic_rows(row_numbers: DataFrame, rows_per_payer: int = MAX_ROWS_PER_PAYER) -> DataFrame:
    """Extract rows for a frame with a long ``id`` counted from 0.

    Rows run over profiles, then payers, then years; beyond the last year the cycle goes on
    with later years.
    """
    if not 1 <= rows_per_payer <= MAX_ROWS_PER_PAYER:
        raise ValueError(f"rows_per_payer must be between 1 and {MAX_ROWS_PER_PAYER}")
    payers = len(SYNTHETIC_PAYERS)
    member = F.expr(f"cast(id % {rows_per_payer} AS int)")
    payer = F.expr(f"cast((id div {rows_per_payer}) % {payers} AS int)")
    year = F.expr(f"cast({SYNTHETIC_YEARS[0]} + id div {rows_per_payer * payers} AS int)")
    base = row_numbers.select("id", member.alias("m"), payer.alias("p"), year.alias("y"))
    m, p, y = F.col("m"), F.col("p"), F.col("y")

    payer_fields = ("country", "payer", "payer_key", "server", "provider", "authority", "network")
    profile_fields = (
        "dependency", "dependent", "gender", "age_profile", "age_bucket", "nationality", "marital",
    )
    picked = base.withColumns(
        {
            **{
                f"p_{name}": _pick(tuple(row[i] for row in SYNTHETIC_PAYERS), p)
                for i, name in enumerate(payer_fields)
            },
            **{
                f"m_{name}": _pick(tuple(row[i] for row in SYNTHETIC_PROFILES), m)
                for i, name in enumerate(profile_fields)
            },
            "contract_place": (m + y) % 2,
            "contract": F.when(
                (m + y) % 2 == 0, _pick(tuple(row[7][0] for row in SYNTHETIC_PAYERS), p)
            ).otherwise(_pick(tuple(row[7][1] for row in SYNTHETIC_PAYERS), p)),
            "start_month": (m * 2 + p + y) % 10 + 1,
            "registered": (m + p + y) % 5 != 0,
            "gross": _cents(
                (285 + p * 68 + m * 19) * (1 + (y - SYNTHETIC_YEARS[0]) * F.lit(0.06))
            ),
        }
    )
    net_rate = F.lit(0.87) + (m + p) % 4 * F.lit(0.015)
    fee_rate = F.lit(0.035) + (m + p) % 3 * F.lit(0.006)
    stop = (
        F.when(m % 11 == 0, F.make_date(y, F.lit(6), F.lit(30)))
        .when(m % 7 == 0, F.make_date(y, F.lit(9), F.lit(30)))
        .otherwise(F.make_date(y, F.lit(12), F.lit(31)))
    )
    start = F.make_date(y, F.col("start_month"), F.lit(1))
    joined = F.make_date(y, F.greatest(F.lit(1), F.col("start_month") - 1), F.lit(15))
    number = lambda c, width: F.lpad((c + 1).cast("string"), width, "0")
    if_registered = lambda c: F.when(F.col("registered"), c).otherwise("")
    member_code = F.concat(number(p, 2), F.lit("-"), number(m, 3))
    return picked.select(
        (F.col("id") + SYNTHETIC_FIRST_RECORD).alias("index"),
        F.col("p_server").alias("servername"),
        F.col("p_provider").alias("serviceprovidername"),
        F.col("p_country").alias("payercountry"),
        F.col("p_payer").alias("payer_name"),
        F.col("p_payer_key").alias("payer_key"),
        F.col("contract").alias("mastercontract"),
        _pick(tuple(a for a, _ in SYNTHETIC_PRODUCTS), (m + p) % 4).alias("policy_type"),
        F.col("p_authority").alias("licensing_authority"),
        F.col("p_network").alias("op_member_network_type"),
        F.col("m_dependency").alias("dependency"),
        F.col("m_nationality").alias("nationality"),
        F.col("m_marital").alias("maritalstatus"),
        F.col("gross").alias("gross_premium_usd"),
        _cents(F.col("gross") * net_rate).alias("net_premium_usd"),
        _cents(F.col("gross") * fee_rate).alias("tpa_usd"),
        F.col("m_gender").alias("gender"),
        F.col("m_dependent").alias("isdependent"),
        F.col("m_age_profile").alias("age_profile"),
        y.alias("uwyear"),
        _pick(SYNTHETIC_PAYER_TYPES, (p + m) % 3).alias("payer_type"),
        _pick(tuple(b for _, b in SYNTHETIC_PRODUCTS), (m + p) % 4).alias("policytype"),
        _pick(SYNTHETIC_NETWORK_GROUPS, (m + y + p) % 3).alias("networkgroup"),
        (m + 1).alias("rn1"),
        F.date_format(start, "dd MM yyyy").alias("member_start_date"),
        F.date_format(stop, "dd MM yyyy").alias("member_stop_date"),
        F.concat(F.lit("BEN-"), member_code).alias("beneficiarykey"),
        F.concat(F.lit("BP-"), member_code).alias("beneficiarypayerkey"),
        F.concat(
            F.lit("MC-"), number(p, 2), F.lit("-"), number(F.col("contract_place"), 2)
        ).alias("mastercontractkey"),
        if_registered(
            F.concat(
                F.lit("REG-"), number(p, 2), F.lit("-"), number(F.expr("m div 2"), 3)
            )
        ).alias("registereduserkey"),
        if_registered(F.date_format(joined, "dd MM yyyy")).alias("registrationdate"),
        if_registered(y.cast("string")).alias("registrationyear"),
        F.when(F.col("registered"), _pick(SYNTHETIC_APPS, (m + p) % 3))
        .otherwise("None")
        .alias("appname"),
        F.col("m_age_bucket").alias("age_bucket"),
        F.concat((y + 1).cast("string"), F.lit("0308115210")).alias("reload_ts"),
    )


def synthetic_extract(spark: SparkSession, rows_per_payer: int = MAX_ROWS_PER_PAYER) -> DataFrame:
    """The default extract: three years of every payer and profile (288 rows)."""
    n = len(SYNTHETIC_YEARS) * len(SYNTHETIC_PAYERS) * rows_per_payer
    return synthetic_rows(spark.range(n), rows_per_payer)
