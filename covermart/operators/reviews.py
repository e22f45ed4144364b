"""Aggregates over the policies of one scope.

Each review needs several exact distinct counts beside its sums. Every counted key becomes
a row of its own, ``(group, kind, key)``, and is made distinct once; then plain counts are
enough. The reduction starts before the shuffle and is keyed by group and key together, so
a payer that holds much of the portfolio is still spread over all tasks. Money is summed on
its own, and the two small results are added together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covermart.functions.clean import unassigned
from covermart.functions.money import (
    MONEY_COLUMNS,
    dollars,
    micro,
    micro_parts,
    ratio,
    sum_micro,
    sum_parts,
    sum_usd,
    sum_usd_or_zero,
)

PAYER_ROWS = 25
POLICY_TYPE_ROWS = 20
_KEYS = {
    "beneficiary": "beneficiary_key",
    "user": "registered_user_key",
    "contract": "master_contract_key",
}


def _measures(
    scoped: DataFrame, by: dict[str, Column], counts: dict[str, str], money: bool = True
) -> DataFrame:
    """Row count, distinct counts and money totals per group, from one pass over the policies.

    ``counts`` maps a result name to a kind of key; the kind ``linked`` counts beneficiaries that
    have a registered user. Beside its keys every policy has a row of kind ``record`` with its
    money; they are few after the first reduction. A total is NULL when a group has no amount,
    and a group without keys counts 0.
    """
    amounts = MONEY_COLUMNS if money else ()
    nothing = [F.lit(None).cast("decimal(28,0)").alias(c) for c in amounts]
    kinds = {"beneficiary" if k == "linked" else k for k in counts.values()}
    linked = F.col("registered_user_key").isNotNull()
    keys = F.array(
        *[
            F.struct(
                F.lit(kind).alias("kind"),
                F.col(column).alias("key"),
                (linked if kind == "beneficiary" else F.lit(False)).alias("linked"),
                *nothing,
            )
            for kind, column in _KEYS.items()
            if kind in kinds
        ],
        F.struct(
            F.lit("record").alias("kind"),
            F.lit(None).cast("string").alias("key"),
            F.lit(False).alias("linked"),
            *[micro(F.col(c)).alias(c) for c in amounts],
        ),
    )
    groups = [column.alias(name) for name, column in by.items()]
    distinct = (
        scoped.select(*groups, F.inline(keys))
        .where("key IS NOT NULL OR kind = 'record'")
        .groupBy(*by, "kind", "key")
        .agg(
            F.max("linked").alias("linked"),
            F.count(F.lit(1)).alias("rows"),
            *[sum_micro(F.col(c)).alias(c) for c in amounts],
        )
    )
    records = F.sum(F.when(F.col("kind") == "record", F.col("rows")))
    return distinct.groupBy(*by).agg(
        F.coalesce(records, F.lit(0)).alias("policy_records"),
        *[
            F.count_if(F.col("linked") if kind == "linked" else F.col("kind") == kind).alias(name)
            for name, kind in counts.items()
        ],
        *[dollars(F.sum(c)).alias(c) for c in amounts],
    )


def _rates(review: DataFrame) -> DataFrame:
    gross = F.col("gross_premium_usd")
    return review.withColumns(
        {
            "app_penetration_rate": ratio(F.col("registered_users"), F.col("beneficiaries")),
            "net_to_gross_ratio": ratio(F.col("net_premium_usd"), gross),
            "tpa_to_gross_ratio": ratio(F.col("tpa_fee_usd"), gross),
        }
    )


def _review(scoped: DataFrame, dimension: str) -> DataFrame:
    measures = _measures(
        scoped,
        {dimension: unassigned(F.col(dimension))},
        {
            "beneficiaries": "beneficiary",
            "registered_users": "user",
            "registered_beneficiaries": "linked",
        },
    )
    return _rates(measures.drop("policy_records"))


def portfolio_summary(scoped: DataFrame) -> DataFrame:
    """One row of counts, exact distinct counts and money; always one row."""
    measures = _measures(
        scoped,
        {},
        {
            "unique_beneficiaries": "beneficiary",
            "master_contracts": "contract",
            "registered_users": "user",
            "registered_beneficiaries": "linked",
        },
    )
    return measures.na.fill(0.0, subset=list(MONEY_COLUMNS))


def latest_active(summary: DataFrame, active_population: DataFrame) -> DataFrame:
    """Summary with the population of the latest month (0 and NULL when there is none)."""
    latest = active_population.agg(
        F.max(F.struct("month_end", "active_population"))
    ).scalar()
    return summary.withColumn("latest", latest).select(
        *summary.columns,
        F.coalesce("latest.active_population", F.lit(0)).alias("latest_active_population"),
        F.col("latest.month_end").alias("latest_active_month"),
    )


def premium_by_year(scoped: DataFrame) -> DataFrame:
    """Distinct members and users, penetration and money by underwriting year."""
    grouped = _measures(
        scoped,
        {"uw_year": F.col("uw_year")},
        {"beneficiaries": "beneficiary", "registered_users": "user"},
    )
    return grouped.select(
        "uw_year", "beneficiaries", "registered_users",
        ratio(F.col("registered_users"), F.col("beneficiaries")).alias("app_penetration"),
        *MONEY_COLUMNS,
    ).orderBy(F.asc_nulls_last("uw_year"))


def payer_review_all(scoped: DataFrame) -> DataFrame:
    """Every payer with distinct counts, money and guarded ratios, largest gross first."""
    return _review(scoped, "payer_name").orderBy(
        F.desc_nulls_last("gross_premium_usd"), "payer_name"
    )


def payer_review(scoped: DataFrame, rows: int = PAYER_ROWS) -> DataFrame:
    """The first payers of :func:`payer_review_all`; ties go by name."""
    return payer_review_all(scoped).limit(rows)


def _premium_by(scoped: DataFrame, *dimensions: str) -> DataFrame:
    return (
        scoped.groupBy(*[unassigned(F.col(d)).alias(d) for d in dimensions])
        .agg(sum_usd_or_zero("gross_premium_usd"))
        .orderBy(F.desc_nulls_last("gross_premium_usd"), *dimensions)
    )


def payer_network_premium(scoped: DataFrame) -> DataFrame:
    """Gross premium by payer and network type."""
    return _premium_by(scoped, "payer_name", "network_type")


def contract_network_premium(scoped: DataFrame) -> DataFrame:
    """Gross premium by master contract and network type."""
    return _premium_by(scoped, "master_contract", "network_type")


def age_bucket_review(scoped: DataFrame) -> DataFrame:
    """As the payer review, by age bucket, most members first."""
    return _review(scoped, "age_bucket").orderBy(
        F.desc_nulls_last("beneficiaries"), "age_bucket"
    )


def policy_type_review_all(scoped: DataFrame) -> DataFrame:
    """Distinct members and money of every policy type, largest gross first."""
    measures = _measures(
        scoped,
        {"policy_type": unassigned(F.col("policy_type"))},
        {"beneficiaries": "beneficiary"},
    )
    return measures.drop("policy_records").orderBy(
        F.desc_nulls_last("gross_premium_usd"), "policy_type"
    )


def policy_type_review(scoped: DataFrame, rows: int = POLICY_TYPE_ROWS) -> DataFrame:
    """The first policy types of :func:`policy_type_review_all`; ties go by name."""
    return policy_type_review_all(scoped).limit(rows)


def mobile_by_payer_all(scoped: DataFrame) -> DataFrame:
    """Registered users, penetration and linked coverage of every payer."""
    members, users = F.col("unique_beneficiaries"), F.col("unique_registered_users")
    measures = _measures(
        scoped,
        {"payer_name": unassigned(F.col("payer_name"))},
        {
            "unique_beneficiaries": "beneficiary",
            "unique_registered_users": "user",
            "linked_beneficiaries": "linked",
        },
        money=False,
    )
    return (
        measures.drop("policy_records")
        .withColumns(
            {
                "registered_user_penetration": ratio(users, members),
                "linked_beneficiary_coverage": ratio(F.col("linked_beneficiaries"), members),
            }
        )
        .orderBy(F.desc_nulls_last("unique_beneficiaries"), "payer_name")
    )


def mobile_by_payer(scoped: DataFrame, rows: int = PAYER_ROWS) -> DataFrame:
    """The first payers of :func:`mobile_by_payer_all`; ties go by name."""
    return mobile_by_payer_all(scoped).limit(rows)


# --- all reviews from one pass -------------------------------------------------------

#: Group sets of :func:`review_measures` and the kinds of keys that each counts.
_COUNTED = {
    "total": ("beneficiary", "user", "contract"),
    "uw_year": ("beneficiary", "user"),
    "payer_name": ("beneficiary", "user"),
    "age_bucket": ("beneficiary", "user"),
    "policy_type": ("beneficiary",),
}
#: Dimensions and kinds whose keys are counted over distinct members instead of policies.
_MEMBER_DIMENSIONS, _MEMBER_KINDS = ("uw_year", "age_bucket", "policy_type"), ("beneficiary", "user")
_PREMIUMS = {"payer_network": "payer_name", "contract_network": "master_contract"}


def _group_value(name: str) -> Column:
    if name == "total":
        return F.lit(None).cast("string")
    return F.col(name).cast("string") if name == "uw_year" else unassigned(F.col(name))


def _money_totals(scoped: DataFrame) -> DataFrame:
    """Rows and money of all groups, ``(grouping, value, detail)``.

    A policy has three rows, not one for each group set: its payer and its contract, by network,
    and its year, age and type together. The sums of these give those of all group sets.
    """
    none = F.lit(None).cast("string")
    parts = {
        "payer": (_group_value("payer_name"), _group_value("network_type"), none),
        "contract": (_group_value("master_contract"), _group_value("network_type"), none),
        "kind": (_group_value("uw_year"), _group_value("age_bucket"), _group_value("policy_type")),
    }
    rows = [
        F.struct(F.lit(part).alias("part"), a.alias("a"), b.alias("b"), c.alias("c"))
        for part, (a, b, c) in parts.items()
    ]
    summed = (
        scoped.select(*[part for c in MONEY_COLUMNS for part in micro_parts(c)], F.inline(F.array(*rows)))
        .groupBy("part", "a", "b", "c")
        .agg(F.count(F.lit(1)).alias("policy_records"), *map(sum_parts, MONEY_COLUMNS))
    )
    sets = {
        "payer": [("payer_name", F.col("a"), none), ("payer_network", F.col("a"), F.col("b"))],
        "contract": [("contract_network", F.col("a"), F.col("b"))],
        "kind": [
            ("total", none, none), ("uw_year", F.col("a"), none), ("age_bucket", F.col("b"), none),
            ("policy_type", F.col("c"), none),
        ],
    }
    groups = [
        F.when(
            F.col("part") == part,
            F.array(
                *[
                    F.struct(F.lit(name).alias("grouping"), value.alias("value"), detail.alias("detail"))
                    for name, value, detail in of_part
                ]
            ),
        )
        for part, of_part in sets.items()
    ]
    return (
        summed.select("policy_records", *MONEY_COLUMNS, F.inline(F.coalesce(*groups)))
        .groupBy("grouping", "value", "detail")
        .agg(*[F.sum(c).alias(c) for c in ("policy_records", *MONEY_COLUMNS)])
    )


def _key_rows(rows: DataFrame, counted: list[tuple[str, str]]) -> DataFrame:
    """``(grouping, value, kind, key, linked)`` for pairs of a group set and a kind, both as numbers."""
    linked = F.col("registered_user_key").isNotNull()
    keys = F.array(
        *[
            F.struct(
                F.lit(list(_COUNTED).index(name)).cast("byte").alias("grouping"),
                _group_value(name).alias("value"),
                F.lit(list(_KEYS).index(kind)).cast("byte").alias("kind"),
                F.col(_KEYS[kind]).alias("key"),
                (linked if kind == "beneficiary" else F.lit(False)).alias("linked"),
            )
            for name, kind in counted
        ]
    )
    return rows.select(F.inline(keys)).where("key IS NOT NULL")


def _distinct_keys(scoped: DataFrame) -> DataFrame:
    """Every key once for each group that counts it.

    Members and users are first made distinct by the few dimensions that hold many of them, so
    the rows for those group sets are made of members, not of policies. A payer has nearly as
    many pairs with members as policies, so its rows are made of these.
    """
    members = scoped.select(*_MEMBER_DIMENSIONS, *map(_KEYS.get, _MEMBER_KINDS)).distinct()
    pairs = [(name, kind) for name, kinds in _COUNTED.items() for kind in kinds]
    of_members = [
        (name, kind) for name, kind in pairs
        if name in ("total", *_MEMBER_DIMENSIONS) and kind in _MEMBER_KINDS
    ]
    return (
        _key_rows(members, of_members)
        .unionByName(_key_rows(scoped, [pair for pair in pairs if pair not in of_members]))
        .groupBy("grouping", "value", "kind", "key")
        .agg(F.max("linked").alias("linked"))
    )


def review_measures(scoped: DataFrame) -> DataFrame:
    """The counts and money of all ten reviews, one row per group set, value and detail.

    Policies are read twice for the keys and once for the money. Each key becomes a row for
    every group set that counts it, ``(grouping, value, kind, key)``, and all are made distinct
    in one shuffle; the total and a hot payer are spread over all tasks by their keys. The
    result is as small as the reviews are.
    """
    names = F.array(*map(F.lit, _COUNTED))
    counts = (
        _distinct_keys(scoped)
        .groupBy("grouping", "value")
        .agg(
            *[F.count_if(F.col("kind") == place).alias(kind) for place, kind in enumerate(_KEYS)],
            F.count_if("linked").alias("linked"),
        )
        .withColumn("grouping", names[F.col("grouping")])
    )
    return (
        counts.unionByName(_money_totals(scoped), allowMissingColumns=True)
        .groupBy("grouping", "value", "detail")
        .agg(
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("policy_records", *_KEYS, "linked")],
            *[dollars(F.sum(c)).alias(c) for c in MONEY_COLUMNS],
        )
    )


def review_frames(measures: DataFrame) -> dict[str, DataFrame]:
    """The ten reviews and the summary from :func:`review_measures`."""

    def group(name: str, **columns: str | Column) -> DataFrame:
        own = [(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in columns.items()]
        return measures.where(F.col("grouping") == name).select(*own, *MONEY_COLUMNS)

    def review(name: str) -> DataFrame:
        return _rates(
            group(name, **{name: "value"}, beneficiaries="beneficiary", registered_users="user",
                  registered_beneficiaries="linked")
        )

    def premium(name: str) -> DataFrame:
        gross = F.coalesce("gross_premium_usd", F.lit(0.0)).alias("gross_premium_usd")
        column = _PREMIUMS[name]
        return measures.where(F.col("grouping") == name).select(
            F.col("value").alias(column), F.col("detail").alias("network_type"), gross
        ).orderBy(F.desc("gross_premium_usd"), column, "network_type")

    # an empty scope has no total: the aggregate makes it one row of zeros
    names = {
        "policy_records": "policy_records", "unique_beneficiaries": "beneficiary", "master_contracts": "contract",
        "registered_users": "user", "registered_beneficiaries": "linked",
    }
    summary = measures.where("grouping = 'total'").agg(
        *[F.coalesce(F.max(c), F.lit(0)).alias(name) for name, c in names.items()],
        *[F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in MONEY_COLUMNS],
    )
    years = group("uw_year", uw_year=F.col("value").cast("int"), beneficiaries="beneficiary",
                  registered_users="user")
    years = years.select(
        "uw_year", "beneficiaries", "registered_users",
        ratio(F.col("registered_users"), F.col("beneficiaries")).alias("app_penetration"),
        *MONEY_COLUMNS,
    ).orderBy(F.asc_nulls_last("uw_year"))
    largest = F.desc_nulls_last("gross_premium_usd")
    payers = review("payer_name").orderBy(largest, "payer_name")
    types = group("policy_type", policy_type="value", beneficiaries="beneficiary")
    types = types.orderBy(largest, "policy_type")
    mobile = group(
        "payer_name", payer_name="value", unique_beneficiaries="beneficiary", unique_registered_users="user",
        linked_beneficiaries="linked",
    ).drop(*MONEY_COLUMNS)
    members = F.col("unique_beneficiaries")
    mobile = mobile.withColumns(
        {
            "registered_user_penetration": ratio(F.col("unique_registered_users"), members),
            "linked_beneficiary_coverage": ratio(F.col("linked_beneficiaries"), members),
        }
    ).orderBy(F.desc("unique_beneficiaries"), "payer_name")
    return {
        "summary": summary,
        "premium_by_year": years,
        "payer_review": payers.limit(PAYER_ROWS),
        "payer_review_all": payers,
        "payer_network_premium": premium("payer_network"),
        "master_contract_network_premium": premium("contract_network"),
        "age_bucket_review": review("age_bucket").orderBy(F.desc("beneficiaries"), "age_bucket"),
        "policy_type_review": types.limit(POLICY_TYPE_ROWS),
        "policy_type_review_all": types,
        "mobile_by_payer": mobile.limit(PAYER_ROWS),
        "mobile_by_payer_all": mobile,
    }


def contract_totals(contract_network: DataFrame) -> DataFrame:
    """Network rows collapsed to one total per contract; a NULL contract is its own group."""
    return (
        contract_network.groupBy("master_contract")
        .agg(sum_usd("gross_premium_usd"))
        .orderBy(F.desc_nulls_last("gross_premium_usd"), F.asc_nulls_last("master_contract"))
    )


def count_min_max(policies: DataFrame) -> DataFrame:
    """Row count and range of underwriting years."""
    return policies.agg(
        F.count(F.lit(1)).alias("policy_records"),
        F.min("uw_year").alias("uw_year_min"),
        F.max("uw_year").alias("uw_year_max"),
    )
