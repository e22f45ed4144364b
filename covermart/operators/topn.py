"""Top-N reports. Limits are the feature; ties go by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covermart.functions.clean import unassigned
from covermart.functions.money import sum_usd_or_zero

TOP_ENTITIES = 10
BREAKDOWN_ROWS = 8


def topn_semi(detail: DataFrame, ranked: DataFrame, key: str, n: int) -> DataFrame:
    """Detail rows of the first ``n`` entities of an ordered frame.

    The limit bounds the broadcast side at ``n`` rows.
    """
    first = ranked.select(key).limit(n)
    return detail.join(F.broadcast(first), key, "left_semi")


def top_entities_stacked(
    premium: DataFrame, entity: str, n: int = TOP_ENTITIES
) -> DataFrame:
    """Network rows of the entities with the largest gross premium, with stacking totals.

    ``entity_total`` orders the entities and ``network_total`` (over the shown entities)
    orders the stacked network types.
    """
    prepared = premium.select(
        unassigned(F.col(entity)).alias(entity),
        unassigned(F.col("network_type")).alias("network_type"),
        F.coalesce("gross_premium_usd", F.lit(0.0)).alias("gross_premium_usd"),
    )
    totals = (
        prepared.groupBy(entity)
        .agg(sum_usd_or_zero("gross_premium_usd").alias("entity_total"))
        .orderBy(F.desc("entity_total"), entity)
        .limit(n)
    )
    shown = prepared.join(F.broadcast(totals), entity)
    network = shown.groupBy("network_type").agg(
        sum_usd_or_zero("gross_premium_usd").alias("network_total")
    )
    return shown.join(network, "network_type").select(
        entity, "network_type", "gross_premium_usd", "entity_total", "network_total"
    )


def latest_breakdown(
    series: DataFrame, dimension: str, metrics: tuple[str, ...], n: int = BREAKDOWN_ROWS
) -> DataFrame:
    """The ``n`` largest values of a dimension in the latest month, for each metric."""
    latest = series.agg(F.max("month_end")).scalar()
    by_value = (
        series.where(F.col("month_end") == latest)
        .groupBy(unassigned(F.col(dimension)).alias(dimension))
        .agg(*[F.sum(F.col(m).cast("double")).alias(m) for m in metrics])
    )
    long = by_value.unpivot([dimension], list(metrics), "metric", "value")
    largest = Window.partitionBy("metric").orderBy(F.desc_nulls_last("value"), dimension)
    return long.withColumn("place", F.row_number().over(largest)).where(F.col("place") <= n)
