"""Every aggregate of one scope."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covermart.functions.money import MONEY_COLUMNS
from covermart.operators import monthly as mo
from covermart.operators import reviews as rv
from covermart.operators.scope import Scope, scoped_projection
from covermart.plans.mart import Mart


class Snapshot(dict[str, DataFrame]):
    """Frames by name, and the caches they read. Close it, or use it in a ``with`` block."""

    def __init__(self) -> None:
        super().__init__()
        self.caches: list[DataFrame] = []

    def close(self) -> None:
        """Free the caches; the frames still work, computed anew."""
        for frame in self.caches:
            frame.unpersist()
        self.caches.clear()

    def __enter__(self) -> Snapshot:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def snapshot(mart: Mart, scope: Scope) -> Snapshot:
    """Seventeen lazy frames of a scope.

    The reviews share one small table of measures, which is persisted. Month-end metrics that
    the stored rollups do not serve are computed at once and kept in the shared folder.
    Policies are not kept.
    """
    frames = Snapshot()
    scoped = scoped_projection(mart.table("policy_records"), scope)
    measures = rv.review_measures(scoped).persist(StorageLevel.MEMORY_AND_DISK)
    frames.caches.append(measures)
    monthly = mart.monthly(scope)
    population = mo.active_population(monthly["monthly_kpis"])
    reviews = rv.review_frames(measures)
    frames.update(reviews)
    frames.update(monthly)
    frames["summary"] = rv.latest_active(reviews["summary"], population)
    frames["active_population"] = population
    return frames


#: The columns of policies that :func:`portfolio` and the dictionary of names read.
PORTFOLIO_COLUMNS = (
    "uw_year", "payer_country", "payer_name", "master_contract", "master_contract_key", "policy_type",
    "network_type", "age_bucket", "beneficiary_key", "registered_user_key", "registration_date",
    "effective_start_date", "effective_stop_date", *MONEY_COLUMNS,
)


def portfolio(policies: DataFrame) -> Snapshot:
    """The frames of the full scope that questions read, straight from stored policies.

    The full scope is all policies with a year. It needs no mart: ``policies`` are read for
    `PORTFOLIO_COLUMNS` only, and of the month-end series for the total and the countries. The
    series is computed at once and kept in the shared folder, the measures are persisted.
    """
    frames = Snapshot()
    dated = policies.where("uw_year IS NOT NULL")
    measures = rv.review_measures(dated).persist(StorageLevel.MEMORY_AND_DISK)
    frames.caches.append(measures)
    series = mo.stored_series(dated, ("payer_country",))
    monthly = series.where(F.col("dimension") == mo.TOTAL).select(*mo.SERIES_COLUMNS).orderBy("month_end")
    population = mo.active_population(monthly)
    reviews = rv.review_frames(measures)
    frames.update(reviews)
    frames["monthly_kpis"] = monthly
    frames["monthly_country_kpis"] = mo.dimension_slice(series, "payer_country")
    frames["summary"] = rv.latest_active(reviews["summary"], population)
    frames["active_population"] = population
    return frames
