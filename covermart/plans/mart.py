"""The stored tables: two facts, their rollups, the filter dictionary and metadata."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covermart.functions.money import MONEY_COLUMNS
from covermart.operators import monthly as mo
from covermart.operators.coverage import covered_span, coverage_dates, member_months
from covermart.operators.options import year_options
from covermart.operators.scope import Scope, scope_filter
from covermart.sources.extract import read_extract, typed_projection
from covermart.sources.sinks import write_by_year

ROLLUPS = ("monthly_kpis", "monthly_country_kpis", "monthly_dimension_kpis")
TABLES = (
    "policy_records", "monthly_series", *ROLLUPS, "active_population", "filter_options",
    "mart_metadata",
)
VERSIONS, MANIFEST = "versions", "manifest"
MANIFEST_SCHEMA = "table string, year int, version string"
#: Tables that may have no row of some year though policies have one.
_DIMENSIONS = ", ".join(f"{d} string" for d in mo.SERIES_DIMENSIONS)
PART_SCHEMAS = {
    "member_runs": f"kind string, key string, first_month int, {_DIMENSIONS}, last_month int, uw_year int",
    "money_runs": f"{_DIMENSIONS}, first_month int, last_month int, "
    + ", ".join(f"{c} decimal(38,0)" for c in MONEY_COLUMNS) + ", uw_year int",
    "year_options": "dimension string, value string, uw_year int",
    "year_facts": "policies bigint, months bigint, uw_year int",
}


def policy_records(raw: DataFrame) -> DataFrame:
    """Cleaned, typed policies with their coverage dates."""
    return coverage_dates(typed_projection(raw))


def mart_metadata(policies: DataFrame, **extra: str) -> DataFrame:
    """Key and value rows: sizes and year range, and whatever else is given.

    Covered months are added up per policy, so counting them explodes nothing.
    """
    months = covered_span(policies).agg(F.sum("month_count")).scalar()
    facts = policies.agg(
        F.count(F.lit(1)).cast("string").alias("policy_records"),
        F.coalesce(months, F.lit(0)).cast("string").alias("active_member_month_rows"),
        F.coalesce(F.min("uw_year").cast("string"), F.lit("")).alias("uw_year_min"),
        F.coalesce(F.max("uw_year").cast("string"), F.lit("")).alias("uw_year_max"),
    )
    keys = list(facts.columns)
    facts = facts.withColumns({k: F.lit(v) for k, v in extra.items()})
    return facts.unpivot([], [*extra, *keys], "key", "value")


def year_facts(policies: DataFrame) -> DataFrame:
    """Policies and covered months of each year."""
    months = covered_span(policies).groupBy("uw_year").agg(F.sum("month_count").alias("months"))
    sizes = policies.groupBy("uw_year").agg(F.count(F.lit(1)).alias("policies"))
    same = sizes["uw_year"].eqNullSafe(months["uw_year"])
    return sizes.join(months, same, "left").select(sizes["uw_year"], "policies", "months")


def whole_metadata(facts: DataFrame, **extra: str) -> DataFrame:
    """:func:`mart_metadata` from the facts of each year."""
    whole = facts.agg(
        F.coalesce(F.sum("policies"), F.lit(0)).cast("string").alias("policy_records"),
        F.coalesce(F.sum("months"), F.lit(0)).cast("string").alias("active_member_month_rows"),
        F.coalesce(F.min("uw_year").cast("string"), F.lit("")).alias("uw_year_min"),
        F.coalesce(F.max("uw_year").cast("string"), F.lit("")).alias("uw_year_max"),
    )
    keys = list(whole.columns)
    whole = whole.withColumns({k: F.lit(v) for k, v in extra.items()})
    return whole.unpivot([], [*extra, *keys], "key", "value")


def rollup(series: DataFrame, name: str) -> DataFrame:
    """One stored rollup from the long month-end series."""
    if name == "monthly_kpis":
        return series.where(F.col("dimension") == mo.TOTAL).select(*mo.SERIES_COLUMNS)
    if name == "monthly_country_kpis":
        return mo.dimension_slice(series, "payer_country")
    return series.where(F.col("dimension").isin(*mo.ROLLUP_DIMENSIONS))


def build_mart(
    spark: SparkSession,
    source: str,
    folder: str,
    multiline: bool = False,
    months: bool = False,
) -> None:
    """Read an extract and store a new version of every table under ``folder``."""
    raw = read_extract(spark, source, multiline)
    write_mart(spark, policy_records(raw), folder, source, months)


def write_mart(
    spark: SparkSession, policies: DataFrame, folder: str, source: str, months: bool = False
) -> None:
    """Store a new version of every table from policies with coverage dates.

    A version is a folder of its own. Its name is committed last, in one append, so readers
    see the version before until all tables are there, and a failed build leaves it in use.
    Older versions stay until they are removed by hand.

    Each fact is written once and read back, so the rollups start from stored columns and
    a lost executor never repeats the cleaning. ``months`` also stores every covered month of
    every policy, about a dozen rows for each, which no aggregate here reads.
    """
    _write_version(spark, policies, folder, source, months, [])


def refresh_mart(spark: SparkSession, policies: DataFrame, folder: str, source: str) -> None:
    """Store a new version in which the years of ``policies`` are replaced by them.

    ``policies`` is all there is of its years, policies without a year among them if it has
    any. Only these years are read, cleaned and written; the manifest of the new version names
    the folders of the version before for all others. Rollups, options and metadata are put
    together from the parts of each year, which are small beside the policies.
    """
    before = Mart(spark, folder)
    if not before.manifest:
        raise ValueError("the mart was stored without a manifest; build it anew")
    months = any(entry["table"] == "member_months" for entry in before.manifest)
    _write_version(spark, policies, folder, source, months, before.manifest)


def _write_version(
    spark: SparkSession, policies: DataFrame, root: str, source: str, months: bool, before: list[dict]
) -> None:
    version = f"version-{uuid.uuid4().hex}"
    folder = f"{root}/{version}"
    write_by_year(policies, f"{folder}/policy_records", gather=False)
    stored = spark.read.schema(policies.schema).parquet(f"{folder}/policy_records")
    spans = mo.dimension_spans(stored, mo.SERIES_DIMENSIONS)
    parts = {
        "member_runs": mo.member_runs(spans, mo.SERIES_DIMENSIONS, ("uw_year",)),
        "money_runs": mo.money_runs(spans, mo.SERIES_DIMENSIONS, ("uw_year",)),
        "year_options": year_options(stored),
        "year_facts": year_facts(stored),
    }
    for name, part in parts.items():
        write_by_year(part, f"{folder}/{name}")
    if months:
        # read from files of one year each, so no shuffle is needed
        parts["member_months"] = member_months(stored)
        parts["member_months"].write.partitionBy("uw_year").parquet(f"{folder}/member_months")
    own = []
    for name, part in {"policy_records": stored, **parts}.items():
        files = spark.read.schema(part.schema).parquet(f"{folder}/{name}").inputFiles()
        years = {file.rsplit("/", 2)[1].partition("=")[2] for file in files}
        own += [{"table": name, "year": int(y) if y.lstrip("-").isdigit() else None, "version": version} for y in sorted(years)]
    changed = {entry["year"] for entry in own if entry["table"] == "policy_records"}
    manifest = [entry for entry in before if entry["year"] not in changed] + own
    spark.createDataFrame(
        [(e["table"], e["year"], e["version"]) for e in manifest], MANIFEST_SCHEMA
    ).coalesce(1).write.parquet(f"{folder}/{MANIFEST}")

    mart = Mart(spark, root, version)
    # Policies without a year are outside every scope, so the rollups leave them out. All
    # dimensions are computed in one pass and split afterwards.
    dated = {name: mart.table(name).where("uw_year IS NOT NULL") for name in ("member_runs", "money_runs")}
    mo.series_of_runs(dated["member_runs"], dated["money_runs"], mo.SERIES_DIMENSIONS).write.parquet(
        f"{folder}/monthly_series"
    )
    series = spark.read.parquet(f"{folder}/monthly_series")
    for name in ROLLUPS:
        rollup(series, name).write.mode("overwrite").parquet(f"{folder}/{name}")
    tables = {
        "active_population": mo.active_population(spark.read.parquet(f"{folder}/monthly_kpis")),
        "filter_options": mart.table("year_options").select("dimension", "value").distinct(),
        "mart_metadata": whole_metadata(
            mart.table("year_facts"),
            source_path=source,
            built_at_utc=datetime.now(timezone.utc).isoformat(timespec="seconds"),
        ),
    }
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark.range(1).select(
        F.lit(version).alias("version"),
        F.lit(datetime.now(timezone.utc).isoformat()).alias("built_at_utc"),
    ).write.mode("append").parquet(f"{root}/{VERSIONS}")


class Mart:
    """Stored tables under a folder, in their last version or a given one.

    The version is looked up once, so all tables of an object belong together.
    """

    def __init__(self, spark: SparkSession, folder: str, version: str | None = None):
        if version is None:
            versions = spark.read.parquet(f"{folder}/{VERSIONS}")
            version = versions.agg(F.max_by("version", "built_at_utc")).first()[0]
        self.spark, self.root, self.folder = spark, folder, f"{folder}/{version}".rstrip("/")
        self.manifest = self._manifest()
        self._years: tuple[int, int] | None = None

    def _manifest(self) -> list[dict]:
        """Where each year of a table is stored; empty for a folder of plain tables."""
        try:
            rows = self.spark.read.schema(MANIFEST_SCHEMA).parquet(f"{self.folder}/{MANIFEST}").collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return [row.asDict() for row in rows]

    def table(self, name: str) -> DataFrame:
        """A stored table; one that is kept by year is read from the folders of its years."""
        years: dict[str, list[str]] = {}
        for entry in self.manifest:
            if entry["table"] == name:
                year = "__HIVE_DEFAULT_PARTITION__" if entry["year"] is None else entry["year"]
                years.setdefault(entry["version"], []).append(f"uw_year={year}")
        if not years:
            if self.manifest and name in PART_SCHEMAS:
                return self.spark.createDataFrame([], PART_SCHEMAS[name])
            return self.spark.read.parquet(f"{self.folder}/{name}")
        parts = []
        for version, folders in sorted(years.items()):
            base = f"{self.root}/{version}/{name}"
            part = self.spark.read.option("basePath", base).parquet(*[f"{base}/{f}" for f in folders])
            parts.append(part.withColumn("uw_year", F.col("uw_year").cast("int")))
        return reduce(lambda a, b: a.unionByName(b), parts)

    def year_range(self) -> tuple[int, int] | None:
        """First and last underwriting year, from the metadata; None without a valid year."""
        if self._years:
            return self._years
        years = {
            row["key"]: row["value"]
            for row in self.table("mart_metadata").where("key LIKE 'uw_year%'").collect()
        }
        if not years.get("uw_year_min"):
            return None
        self._years = int(years["uw_year_min"]), int(years["uw_year_max"])
        return self._years

    def serves(self, scope: Scope) -> bool:
        """Whether the stored rollups answer a scope: no dimension, all years, all columns."""
        needed = set(mo.SERIES_COLUMNS)
        return (
            not scope.has_dimensions
            and (scope.year_start, scope.year_end) == self.year_range()
            and all(needed <= set(self.table(name).columns) for name in ROLLUPS)
        )

    def monthly(self, scope: Scope) -> dict[str, DataFrame]:
        """The five month-end frames, from the rollups where they serve, else recomputed once."""
        if not self.serves(scope):
            policies = scope_filter(self.table("policy_records"), scope)
            return mo.split_grouping_sets(mo.stored_monthly_metrics(policies))
        stored = self.table("monthly_dimension_kpis")
        frames = {
            name: self.table(name).select(*columns).orderBy(*order)
            for name, columns, order in (
                ("monthly_kpis", mo.SERIES_COLUMNS, ["month_end"]),
                (
                    "monthly_country_kpis",
                    ("month_end", "payer_country", *mo.SERIES_MEASURES),
                    ["month_end", "payer_country"],
                ),
            )
        }
        for dimension in mo.ROLLUP_DIMENSIONS:
            frames[f"monthly_{dimension}_kpis"] = mo.dimension_slice(stored, dimension)
        return frames
