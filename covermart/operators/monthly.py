"""Month-end series: active members, active registered users and apportioned money.

Exact distinct counts per month are the costly part. A policy covers a run of months, so
the work is done on runs, never on exploded months:

1. Runs are reduced to one per (member, dimensions, first month), keeping the longest. The
   reduction starts before the shuffle, so a member with very many policies stays small.
2. Members are brought together once, on their key alone. Every dimension then works
   inside that partitioning without another shuffle.
3. Along a member's runs, each run keeps only the months that earlier runs left uncovered.
   Runs can then simply be counted: no month counts a member twice.
4. The counted runs (at most one row per dimension value and pair of months) are spread
   over their months and added up with the money, which is summed by run as well and
   divided once for the run, so that no policy loses a remainder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covermart.functions.clean import unassigned
from covermart.functions.money import (
    MONEY_COLUMNS,
    dollars,
    micro_parts,
    ratio,
    share_of_months,
    sum_parts,
    whole_micros,
)
from covermart.operators.coverage import covered_span, month_end, month_number
from covermart.session import shared_folder

TOTAL = "total"
ROLLUP_DIMENSIONS = ("network_type", "network_group", "policy_type")
SERIES_DIMENSIONS = ("payer_country", *ROLLUP_DIMENSIONS)
SERIES_MEASURES = ("active_population", "active_registered_users", *MONEY_COLUMNS)
SERIES_COLUMNS = ("month_end", *SERIES_MEASURES)


def registered_as_of(day: Column) -> Column:
    """The registered user of a known member, NULL before the registration date."""
    registered = F.col("registration_date").isNull() | (F.col("registration_date") <= day)
    return F.when(
        F.col("beneficiary_key").isNotNull() & registered, F.col("registered_user_key")
    )


def _long_form(rows: DataFrame, dimensions: tuple[str, ...], total: bool) -> DataFrame:
    """One row per dimension, as ``(dimension, dimension_value)``."""
    pairs = [
        F.struct(F.lit(d).alias("dimension"), F.col(d).alias("dimension_value"))
        for d in dimensions
    ]
    if total:
        pairs.append(
            F.struct(
                F.lit(TOTAL).alias("dimension"),
                F.lit(None).cast("string").alias("dimension_value"),
            )
        )
    others = [c for c in rows.columns if c not in dimensions]
    return rows.select(*others, F.inline(F.array(*pairs)))


def member_runs(spans: DataFrame, dimensions: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """Runs of members and of registered users, one per key, dimensions and first month.

    Runs of several sets of policies may be put together: a month that two of them cover is
    counted once in the end.
    """
    registered_from = F.coalesce(month_number(F.col("registration_date")), F.col("first_month"))
    runs = F.array(
        F.struct(
            F.lit("member").alias("kind"),
            F.col("beneficiary_key").alias("key"),
            F.col("first_month"),
            F.col("last_month"),
        ),
        F.struct(
            F.lit("user").alias("kind"),
            F.when(F.col("beneficiary_key").isNotNull(), F.col("registered_user_key")).alias(
                "key"
            ),
            F.greatest("first_month", registered_from).alias("first_month"),
            F.col("last_month"),
        ),
    )
    return (
        spans.select(*by, *dimensions, F.inline(runs))
        .where("key IS NOT NULL AND first_month <= last_month")
        .groupBy(*by, "kind", "key", "first_month", *dimensions)
        .agg(F.max("last_month").alias("last_month"))
    )


def _counted_runs(runs: DataFrame, dimensions: tuple[str, ...], total: bool) -> DataFrame:
    """How many keys are newly covered by each run of months, per dimension value."""
    by_key = _long_form(runs.repartition("kind", "key"), dimensions, total)
    earlier = (
        Window.partitionBy("kind", "key", "dimension", "dimension_value")
        .orderBy("first_month", "last_month")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    uncovered_from = F.greatest("first_month", F.max("last_month").over(earlier) + 1)
    return (
        by_key.withColumn("first_month", uncovered_from)
        .where("first_month <= last_month")
        .groupBy("dimension", "dimension_value", "first_month", "last_month")
        .agg(
            F.count_if(F.col("kind") == "member").alias("active_population"),
            F.count_if(F.col("kind") == "user").alias("active_registered_users"),
        )
    )


def money_runs(spans: DataFrame, dimensions: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """Money in micro-dollars per run of months and dimensions; sums of several sets add up."""
    keys = (*by, *dimensions, "first_month", "last_month")
    parts = [part for c in MONEY_COLUMNS for part in micro_parts(c)]
    return spans.select(*keys, *parts).groupBy(*keys).agg(*map(sum_parts, MONEY_COLUMNS))


def dimension_spans(policies: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """Policies with their covered months and labelled dimensions."""
    return covered_span(policies).withColumns({d: unassigned(F.col(d)) for d in dimensions})


def monthly_series(
    policies: DataFrame, dimensions: tuple[str, ...] = (), total: bool = True
) -> DataFrame:
    """Month-end measures per dimension value, long form, from policies with coverage dates.

    ``dimension`` names the column, or ``total`` for the whole; a month is present when at
    least one policy covers it.
    """
    spans = dimension_spans(policies, dimensions)
    return series_of_runs(
        member_runs(spans, dimensions), money_runs(spans, dimensions), dimensions, total
    )


def series_of_runs(
    members: DataFrame, money: DataFrame, dimensions: tuple[str, ...], total: bool = True
) -> DataFrame:
    """:func:`monthly_series` from runs, which may be those of several sets of policies.

    Money of equal runs is added before it is divided, so the parts give what the whole gives.
    """
    counted = _counted_runs(members, dimensions, total)
    by_run = money.groupBy(*dimensions, "first_month", "last_month").agg(
        *[F.sum(c).alias(c) for c in MONEY_COLUMNS]
    )
    months = F.col("last_month") - F.col("first_month") + 1
    shares = {c: share_of_months(F.col(c), months) for c in MONEY_COLUMNS}
    shared = _long_form(by_run.withColumns(shares), dimensions, total)
    counts = ("active_population", "active_registered_users")
    return (
        counted.unionByName(shared, allowMissingColumns=True)
        .withColumn("month", F.explode(F.sequence("first_month", "last_month")))
        .groupBy("dimension", "dimension_value", "month")
        .agg(
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts],
            *[
                F.coalesce(dollars(whole_micros(F.sum(c))), F.lit(0.0)).alias(c)
                for c in MONEY_COLUMNS
            ],
        )
        .select(
            month_end(F.col("month")).alias("month_end"),
            "dimension", "dimension_value", *SERIES_MEASURES,
        )
    )


def monthly_kpis(policies: DataFrame) -> DataFrame:
    """Whole-portfolio measures by month-end."""
    return monthly_series(policies).select(*SERIES_COLUMNS).orderBy("month_end")


def active_population(monthly: DataFrame) -> DataFrame:
    """Active members by month-end."""
    return monthly.select("month_end", "active_population")


def monthly_country_kpis(policies: DataFrame) -> DataFrame:
    """Measures by month-end and payer country."""
    series = monthly_series(policies, ("payer_country",), total=False)
    return dimension_slice(series, "payer_country")


def monthly_dimension_kpis(policies: DataFrame) -> DataFrame:
    """Measures by month-end for network type, network group and policy type, long form."""
    return monthly_series(policies, ROLLUP_DIMENSIONS, total=False)


def dimension_slice(series: DataFrame, dimension: str) -> DataFrame:
    """One dimension of a long series under its own column name."""
    return (
        series.where(F.col("dimension") == dimension)
        .select(
            "month_end", F.col("dimension_value").alias(dimension), *SERIES_MEASURES
        )
        .orderBy("month_end", dimension)
    )


def scoped_monthly_metrics(policies: DataFrame) -> DataFrame:
    """Total and four dimensions in one frame, with a flag per dimension.

    A flag is 1 where its dimension is summed over, 0 where the row belongs to one value.
    """
    series = monthly_series(policies, SERIES_DIMENSIONS)
    values = {
        d: F.when(F.col("dimension") == d, F.col("dimension_value")) for d in SERIES_DIMENSIONS
    }
    flags = {
        f"{d}_grouped": F.when(F.col("dimension") == d, 0).otherwise(1)
        for d in SERIES_DIMENSIONS
    }
    return series.withColumns({**values, **flags}).select(
        "month_end", *values, *flags, *SERIES_MEASURES
    )


def stored_monthly_metrics(policies: DataFrame) -> DataFrame:
    """:func:`scoped_monthly_metrics`, computed once and read from the shared folder.

    A row for each month and dimension value, so it is small whatever the policies are; five
    frames and their users start from it instead of from the policies.
    """
    spark = policies.sparkSession
    path = f"{shared_folder(spark)}/monthly-metrics-{uuid.uuid4().hex}"
    scoped_monthly_metrics(policies).write.parquet(path)
    return spark.read.parquet(path)


def stored_series(policies: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """:func:`monthly_series` with the total, computed once and read from the shared folder."""
    spark = policies.sparkSession
    path = f"{shared_folder(spark)}/monthly-series-{uuid.uuid4().hex}"
    monthly_series(policies, dimensions).write.parquet(path)
    return spark.read.parquet(path)


def split_grouping_sets(metrics: DataFrame) -> dict[str, DataFrame]:
    """The five frames inside :func:`scoped_monthly_metrics`, recovered by flags.

    Each frame reads ``metrics``, which should be stored (:func:`stored_monthly_metrics`).
    """
    whole = " AND ".join(f"{d}_grouped = 1" for d in SERIES_DIMENSIONS)
    frames = {"monthly_kpis": metrics.where(whole).select(*SERIES_COLUMNS).orderBy("month_end")}
    for d in SERIES_DIMENSIONS:
        name = "monthly_country_kpis" if d == "payer_country" else f"monthly_{d}_kpis"
        frames[name] = (
            metrics.where(f"{d}_grouped = 0")
            .select("month_end", d, *SERIES_MEASURES)
            .orderBy("month_end", d)
        )
    return frames


def monthly_penetration(monthly: DataFrame) -> DataFrame:
    """Series with registered users over active members, NULL where there are none."""
    return monthly.withColumn(
        "app_penetration",
        ratio(F.col("active_registered_users"), F.col("active_population")),
    )


def stack_totals(sliced: DataFrame, dimension: str, metric: str) -> DataFrame:
    """Each stacked value with the total of its month and the total of its dimension value.

    Distinct members are not additive over values, so a month's sum counts a member once
    for each value held; it is named ``sum_of_members`` to say so. Values are stacked in
    order of ``value_total``.
    """
    by_month = sliced.groupBy("month_end").agg(F.sum(metric).alias("sum_of_members"))
    by_value = sliced.groupBy(dimension).agg(F.sum(metric).alias("value_total"))
    return sliced.join(by_month, "month_end").join(by_value, dimension).select(
        "month_end", dimension, metric, "sum_of_members", "value_total"
    )
