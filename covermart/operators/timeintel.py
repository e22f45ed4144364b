"""Comparisons over time on aggregated month-end frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covermart.functions.money import MONEY_COLUMNS, ratio
from covermart.operators.monthly import monthly_penetration

TRAILING_MONTHS = 24
KPI_METRICS = (
    "active_population", "active_registered_users", "app_penetration", *MONEY_COLUMNS,
)


def change(current: Column, reference: Column) -> Column:
    """Relative change; NULL when the reference is missing or zero."""
    return ratio(current, reference) - 1


def months_before(month_end: Column, months: int) -> Column:
    """The month-end a number of calendar months earlier (28 February -> 31 January)."""
    return F.last_day(F.add_months(month_end, -months))


def period_lookup(
    series: DataFrame, keys: list[str], metrics: list[str], months: int, prefix: str
) -> DataFrame:
    """Each row with the metrics of the same keys ``months`` calendar months earlier."""
    earlier = series.select(
        *keys,
        F.last_day(F.add_months("month_end", months)).alias("month_end"),
        *[F.col(m).alias(f"{prefix}{m}") for m in metrics],
    )
    return series.join(earlier, [*keys, "month_end"], "left")


def kpi_latest_mom_yoy(monthly: DataFrame) -> DataFrame:
    """Latest value of six metrics with change on the month and on the year before.

    The month rows (one per calendar month) are gathered into one map, so the series is
    computed once and both reference months are plain lookups.
    """
    values = F.struct(*[F.col(m).cast("double").alias(m) for m in KPI_METRICS])
    by_month = monthly_penetration(monthly).agg(
        F.max("month_end").alias("latest"),
        F.map_from_entries(F.collect_list(F.struct("month_end", values))).alias("months"),
    )
    picked = by_month.select(
        "latest",
        F.try_element_at("months", F.col("latest")).alias("now"),
        F.try_element_at("months", months_before(F.col("latest"), 1)).alias("month_ago"),
        F.try_element_at("months", months_before(F.col("latest"), 12)).alias("year_ago"),
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                F.col("latest").alias("month_end"),
                F.col(f"now.{m}").alias("value"),
                change(F.col(f"now.{m}"), F.col(f"month_ago.{m}")).alias("mom"),
                change(F.col(f"now.{m}"), F.col(f"year_ago.{m}")).alias("yoy"),
            )
            for m in KPI_METRICS
        ]
    )
    return picked.select(F.inline(rows))


def dedupe_keep_last(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key: the last by ``order``. The choice is made by an aggregate, so
    repeated keys shrink before the shuffle."""
    others = [c for c in rows.columns if c != key and c not in order]
    return (
        rows.groupBy(key)
        .agg(F.max(F.struct(*order, *others)).alias("last"))
        .select(key, "last.*")
        .select(*rows.columns)
    )


def trailing_months(series: DataFrame, months: int = TRAILING_MONTHS) -> DataFrame:
    """Rows of the last ``months`` distinct month-ends present (not calendar months)."""
    shown = (
        series.where("month_end IS NOT NULL")
        .select("month_end")
        .distinct()
        .orderBy(F.desc("month_end"))
        .limit(months)
    )
    return series.join(F.broadcast(shown), "month_end", "left_semi")


def latest_per_entity(series: DataFrame, entity: str) -> DataFrame:
    """The row of the last month-end of each entity."""
    return dedupe_keep_last(series, entity, ["month_end"]).select(*series.columns)


def period_change(
    series: DataFrame, keys: list[str], period: str, metric: str, rate: bool = False
) -> DataFrame:
    """Last two known points of each series and their change.

    Rates change in percentage points, other metrics relatively (NULL from a zero base).
    """
    points = series.where(F.col(metric).isNotNull())
    by_time = Window.partitionBy(*keys).orderBy(F.desc(period))
    both = points.select(
        *keys,
        F.col(period).alias("period"),
        F.col(metric).cast("double").alias("value"),
        F.lead(F.col(period)).over(by_time).alias("previous_period"),
        F.lead(F.col(metric).cast("double")).over(by_time).alias("previous_value"),
        F.row_number().over(by_time).alias("place"),
    )
    now, before = F.col("value"), F.col("previous_value")
    moved = (now - before) * 100 if rate else change(now, before)
    return (
        both.where("place = 1 AND previous_period IS NOT NULL")
        .drop("place")
        .withColumn("change", moved)
    )
