"""Exact money sums and guarded ratios.

A sum of doubles depends on the order in which tasks finish, so money is added as whole
micro-dollars. They are decimals: a long would overflow at about nine trillion dollars.
Where many rows are added, each amount is cut into four short longs, which are added far
faster than decimals, and put together once per group.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY_COLUMNS = ("gross_premium_usd", "net_premium_usd", "tpa_fee_usd")
MICRO = 1_000_000
#: Parts of an amount, and bits of each but the last: a sum of fewer than 2**39 rows cannot overflow.
PARTS, PART_BITS = 4, 24


def micro(dollars: Column) -> Column:
    """Dollars as whole micro-dollars (decimal of 28 digits)."""
    return F.rint(dollars * MICRO).try_cast("decimal(28,0)")


def dollars(micros: Column) -> Column:
    """Whole micro-dollars as dollars (double)."""
    return micros.cast("double") / F.lit(float(MICRO))


def sum_micro(micros: Column) -> Column:
    """Exact total of micro-dollars; NULL when every value is NULL."""
    return F.sum(micros)


def micro_parts(column: str) -> list[Column]:
    """:func:`micro` of a dollar column as longs, the lowest first, named after the column.

    An amount under 2**52 micro-dollars is a whole number in its double and is cut by bits;
    any other is cut as the decimal that it is cast to.
    """
    whole = F.rint(F.col(column) * MICRO)
    short, bits = whole.try_cast("long"), F.lit(2**PART_BITS - 1).cast("long")
    short_parts = [
        short.bitwiseAND(bits), F.shiftright(short, PART_BITS).bitwiseAND(bits),
        F.shiftright(short, 2 * PART_BITS), F.lit(0).cast("long"),
    ]
    rest, long_parts = micro(F.col(column)), []
    for place in reversed(range(PARTS)):
        weight = F.lit(Decimal(2 ** (PART_BITS * place)))
        long_parts.insert(0, F.call_function("div", rest, weight))
        rest = rest % weight
    return [
        F.when(F.abs(whole) < float(2**52), a).otherwise(b).alias(f"{column}_{place}")
        for place, (a, b) in enumerate(zip(short_parts, long_parts, strict=True))
    ]


def sum_parts(column: str) -> Column:
    """:func:`sum_micro` of a column whose :func:`micro_parts` the rows hold."""
    sums = [
        F.sum(f"{column}_{place}").cast("decimal(20,0)") * F.lit(Decimal(2 ** (PART_BITS * place)))
        for place in range(PARTS)
    ]
    return reduce(lambda a, b: a + b, sums).cast("decimal(38,0)").alias(column)


def share_of_months(micros: Column, months: Column) -> Column:
    """Micro-dollars over a number of months, to eleven decimal places."""
    return micros.cast("decimal(26,0)") / months.cast("decimal(10,0)")


def whole_micros(shares: Column) -> Column:
    """A sum of shares to the nearest micro-dollar, a half upwards.

    The margin covers what eleven places lose, so that a half is a half however the shares
    were grouped.
    """
    return F.floor(shares + F.lit("0.5001").cast("decimal(5,4)"))


def sum_usd(column: str) -> Column:
    """Exact total of a dollar column, as dollars; NULL when every value is NULL."""
    return dollars(sum_micro(micro(F.col(column)))).alias(column)


def sum_usd_or_zero(column: str) -> Column:
    """As :func:`sum_usd`, with 0 when there is nothing to add."""
    return F.coalesce(sum_usd(column), F.lit(0.0)).alias(column)


def ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator``, NULL when the denominator is zero or NULL."""
    return F.when(denominator != 0, numerator.cast("double") / denominator.cast("double"))
