"""Coverage dates, covered months and the equal apportionment of money.

Months are handled as integers (``year * 12 + month - 1``). A policy covers the months from
its start month to the last month whose final day it reaches, so the number of covered
months is plain arithmetic on the policy row: nothing is exploded, numbered or counted in
a window to find it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covermart.fixed_values import SCOPE_COLUMNS
from covermart.functions.money import MONEY_COLUMNS, dollars, micro, share_of_months

FIRST_FALLBACK_YEAR, LAST_FALLBACK_YEAR = 1900, 2100


def month_number(day: Column) -> Column:
    """Month of a date as a running integer."""
    return F.year(day) * 12 + F.month(day) - 1


def month_end(number: Column) -> Column:
    """Last day of a month given as a running integer."""
    year = F.call_function("div", number, F.lit(12)).cast("int")
    return F.last_day(F.make_date(year, number % 12 + 1, F.lit(1)))


def coverage_dates(policies: DataFrame) -> DataFrame:
    """Add effective start and stop: the member date, else the year's first or last day.

    A stop before the start is moved to the start; a NULL stop stays NULL.
    """
    year = F.when(
        F.col("uw_year").between(FIRST_FALLBACK_YEAR, LAST_FALLBACK_YEAR), F.col("uw_year")
    )
    start = F.coalesce("member_start_date", F.make_date(year, F.lit(1), F.lit(1)))
    stop = F.coalesce("member_stop_date", F.make_date(year, F.lit(12), F.lit(31)))
    dated = policies.withColumns(
        {"effective_start_date": start, "provisional_stop_date": stop}
    )
    start, stop = F.col("effective_start_date"), F.col("provisional_stop_date")
    return dated.withColumn("effective_stop_date", F.when(stop < start, start).otherwise(stop))


def dated_only(policies: DataFrame) -> DataFrame:
    """Drop policies without an effective start or stop."""
    return policies.where(
        F.col("effective_start_date").isNotNull() & F.col("effective_stop_date").isNotNull()
    )


def _first_and_last_month() -> tuple[Column, Column]:
    stop = F.col("effective_stop_date")
    reaches_month_end = F.when(stop == F.last_day(stop), 0).otherwise(1)
    return month_number(F.col("effective_start_date")), month_number(stop) - reaches_month_end


def covers_a_month() -> Column:
    """Whether a policy is one of those that :func:`covered_span` keeps."""
    first, last = _first_and_last_month()
    return F.coalesce(first <= last, F.lit(False))


def covered_span(policies: DataFrame) -> DataFrame:
    """Add ``first_month``, ``last_month`` and ``month_count``; keep policies with a month.

    Policies without a start or stop have no month. Both months are made by a generator of one
    row, so that they are computed once and not again in every filter and use of them.
    """
    first, last = _first_and_last_month()
    months = F.struct(first.alias("first_month"), last.alias("last_month"))
    others = [c for c in policies.columns if c not in ("first_month", "last_month")]
    return (
        policies.select(*others, F.inline(F.array(months)))
        .where("first_month <= last_month")
        .withColumn("month_count", F.expr("last_month - first_month + 1"))
    )


def month_expand(policies: DataFrame, columns: list[str]) -> DataFrame:
    """One row per policy and covered month-end, with ``columns`` of the policy."""
    return (
        covered_span(policies)
        .select(*columns, F.explode(F.sequence("first_month", "last_month")).alias("month"))
        .select(month_end(F.col("month")).alias("month_end"), *columns)
    )


def member_months(policies: DataFrame) -> DataFrame:
    """Every covered month of every policy with its share of the money.

    Shares are whole micro-dollars, equal but for the remainder of the division, which goes
    to the first months one by one: a policy's shares add up to its money.
    """
    keep = [
        "uw_year", *SCOPE_COLUMNS.values(),
        "beneficiary_key", "registered_user_key", "registration_date",
    ]
    whole = {c: micro(F.col(c)) for c in MONEY_COLUMNS}
    each = {f"{c}_each": F.floor(share_of_months(F.col(c), F.col("month_count"))) for c in whole}
    place = F.col("month") - F.col("first_month")
    shares = [
        dollars(
            F.col(f"{c}_each")
            + F.when(place < F.col(c) - F.col(f"{c}_each") * F.col("month_count"), 1).otherwise(0)
        ).alias(c)
        for c in whole
    ]
    return (
        covered_span(policies)
        .select(*keep, *[v.alias(c) for c, v in whole.items()], "first_month", "last_month",
                "month_count")
        .withColumns(each)
        .withColumn("month", F.explode(F.sequence("first_month", "last_month")))
        .select(month_end(F.col("month")).alias("month_end"), *keep, *shares)
    )
