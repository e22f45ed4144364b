"""Text expressions: question cleaning, whole-word phrases and number formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from covermart.fixed_values import (
    CASE_FOLDS,
    COUNT_METRICS,
    RATE_METRICS,
)

_BLANKS = r"[\t-\r\x1c-\x20\x85\p{Z}]+"


def clean_question(question: Column) -> Column:
    """Runs of white space as one space, outer space removed."""
    return F.trim(F.regexp_replace(question, _BLANKS, " "))


def normalize_phrase(text: Column) -> Column:
    """Case-folded words of ASCII letters and digits, separated by one space."""
    folded = reduce(
        lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])),
        CASE_FOLDS.items(),
        F.lower(text),
    )
    return F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " "))


def has_any(normalised: Column, phrases: tuple[str, ...]) -> Column:
    """Whether normalised text holds one of the phrases as whole words."""
    return F.concat(F.lit(" "), normalised, F.lit(" ")).rlike(f" ({'|'.join(phrases)}) ")


def years_in(question: Column) -> Column:
    """Distinct years 20xx named in a question, ascending."""
    found = F.regexp_extract_all(question, F.lit(r"\b(20[0-9]{2})\b"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda y: y.cast("int"))))


def fixed(value: Column, pattern: str) -> Column:
    """A number in a decimal pattern, rounded by the exact value of the double."""
    return F.call_function("format_number", value, F.lit(pattern))


def percent(value: Column) -> Column:
    """``0.123`` as ``12.3%``."""
    return F.concat(fixed(value * 100, "0.0"), F.lit("%"))


def money(value: Column) -> Column:
    """Dollars in billions, millions or thousands: ``$1.2m``; NULL counts as zero."""
    amount = F.coalesce(value, F.lit(0.0))
    text = F.concat(F.lit("$"), fixed(amount, "#,##0"))
    for size, suffix in ((1e3, "k"), (1e6, "m"), (1e9, "bn")):
        scaled = F.concat(F.lit("$"), fixed(amount / size, "#,##0.0"), F.lit(suffix))
        text = F.when(F.abs(amount) >= size, scaled).otherwise(text)
    return text


def compact_number(value: Column) -> Column:
    """A count in millions or thousands: ``1.2k``; NULL counts as zero."""
    amount = F.coalesce(value, F.lit(0)).cast("double")
    size = F.abs(amount)
    return (
        F.when(size >= 1e6, F.concat(fixed(amount / 1e6, "#,##0.0"), F.lit("m")))
        .when(size >= 1e3, F.concat(fixed(amount / 1e3, "#,##0.0"), F.lit("k")))
        .otherwise(fixed(amount, "#,##0"))
    )


def format_metric(metric: Column, value: Column) -> Column:
    """A metric's value as text: percentage, whole number or money."""
    return (
        F.when(metric.isin(*RATE_METRICS), percent(value))
        .when(metric.isin(*COUNT_METRICS), fixed(value, "#,##0"))
        .otherwise(money(value))
    )
