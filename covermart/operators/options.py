"""Filter dictionaries: the values that each dimension takes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covermart.fixed_values import SCOPE_COLUMNS

OPTION_COLUMNS = ("uw_year", *SCOPE_COLUMNS.values())


def filter_options(policies: DataFrame, columns: tuple[str, ...] = OPTION_COLUMNS) -> DataFrame:
    """Distinct non-NULL ``(dimension, value)``, from one scan of the policies."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value"))
            for c in columns
        ]
    )
    return policies.select(F.inline(pairs)).where("value IS NOT NULL").distinct()


def year_options(policies: DataFrame) -> DataFrame:
    """The same by underwriting year, so that the options of years can be put together."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value"))
            for c in OPTION_COLUMNS
        ]
    )
    return policies.select("uw_year", F.inline(pairs)).where("value IS NOT NULL").distinct()


def ordered_options(options: DataFrame) -> DataFrame:
    """Options in menu order: by dimension, years as numbers, other values as text.

    A sorted table rather than one list per dimension, because a list of every contract of
    a large portfolio would have to fit in one task.
    """
    year = F.when(F.col("dimension") == "uw_year", F.col("value").try_cast("int"))
    return options.select("dimension", "value", year.alias("year")).orderBy(
        "dimension", F.asc_nulls_last("year"), "value"
    )


def rows_per_dimension(options: DataFrame) -> DataFrame:
    """How many values each dimension takes, with the first and the last."""
    return options.groupBy("dimension").agg(
        F.count(F.lit(1)).alias("value_count"),
        F.min("value").alias("first_value"),
        F.max("value").alias("last_value"),
    )
