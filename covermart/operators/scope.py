"""Scopes: one conjunctive filter over nineteen dimensions and a year range."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covermart.fixed_values import SCOPE_COLUMNS, SCOPE_LABELS
from covermart.functions.money import dollars, micro, sum_micro

LABEL_VALUES = 3
LABEL_DIMENSIONS = 3
UNREADABLE_SCOPE = "not a scope with a first and a last year"
EMPTY_YEARS = "the first year is after the last"
SCOPED_COLUMNS = (
    "uw_year", "payer_country", "payer_name", "service_provider", "master_contract",
    "policy_type", "network_type", "network_group", "age_bucket", "beneficiary_key",
    "registered_user_key", "master_contract_key", "gross_premium_usd", "net_premium_usd",
    "tpa_fee_usd",
)
SCOPE_JSON_SCHEMA = "year_start int, year_end int, " + ", ".join(
    f"{name} array<string>" for name in SCOPE_COLUMNS
)


@dataclass(frozen=True)
class Scope:
    """A year range and, per dimension, the values kept; no values means no restriction."""

    year_start: int
    year_end: int
    selected: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @classmethod
    def from_dict(cls, payload: dict[str, Any]) -> Scope:
        """Read a plain mapping; blank values and unknown attributes are dropped."""
        chosen = {
            name: tuple(
                str(v) for v in payload.get(name) or () if v is not None and str(v).strip()
            )
            for name in SCOPE_COLUMNS
        }
        return cls(
            int(payload["year_start"]),
            int(payload["year_end"]),
            {name: values for name, values in chosen.items() if values},
        )

    def as_dict(self) -> dict[str, Any]:
        lists = {name: list(self.selected.get(name, ())) for name in SCOPE_COLUMNS}
        return {"year_start": self.year_start, "year_end": self.year_end, **lists}

    @property
    def has_dimensions(self) -> bool:
        return any(self.selected.values())

    def predicate(self) -> Column:
        """The filter as one column; a NULL dimension or year never matches."""
        parts = [F.col("uw_year").between(self.year_start, self.year_end)]
        parts += [
            F.col(SCOPE_COLUMNS[name]).isin(*values)
            for name, values in self.selected.items()
            if values
        ]
        return reduce(and_, parts)


def scope_filter(rows: DataFrame, scope: Scope) -> DataFrame:
    """Rows within a scope."""
    return rows.where(scope.predicate())


def scoped_projection(policies: DataFrame, scope: Scope) -> DataFrame:
    """The slim policy fact of one scope; persist it when several aggregates follow."""
    return scope_filter(policies, scope).select(*SCOPED_COLUMNS)


def parse_scopes(scopes: DataFrame) -> DataFrame:
    """Table of ``(scope_id, scope_json)`` with the JSON as columns, blank values dropped.

    ``problem`` says why a scope cannot match anything, else it is NULL.
    """
    parsed = scopes.select(
        "scope_id", F.from_json("scope_json", SCOPE_JSON_SCHEMA).alias("scope")
    ).select("scope_id", "scope.*")
    problem = F.when(
        F.col("year_start").isNull() | F.col("year_end").isNull(), UNREADABLE_SCOPE
    ).when(F.col("year_start") > F.col("year_end"), EMPTY_YEARS)
    return parsed.withColumns(
        {
            name: F.coalesce(F.filter(name, lambda v: F.trim(v) != ""), F.array())
            for name in SCOPE_COLUMNS
        }
    ).withColumn("problem", problem)


def _wanted(policies: DataFrame, scopes: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
    """Scopes with the years that policies have and an anchor, all dimensions and all anchors used.

    Years are looked up among those of the policies, so a range of any width costs nothing.
    The anchor of a scope is its restricted dimension of which the scopes together name most
    values: payers before networks. That is read from the scopes alone and decides the work,
    never the result. At most nineteen names and the list of years reach the driver.
    """
    years = sorted(r["uw_year"] for r in policies.select("uw_year").distinct().collect() if r["uw_year"] is not None)
    known = F.array(*[F.lit(y) for y in years]).cast("array<int>")
    readable = parse_scopes(scopes).where("problem IS NULL")
    listed = [F.struct(F.lit(name).alias("name"), F.col(name).alias("kept")) for name in SCOPE_COLUMNS]
    named = readable.select(F.inline(F.array(*listed))).select("name", F.explode("kept").alias("value"))
    most = {r["name"]: r["n"] for r in named.groupBy("name").agg(F.countDistinct("value").alias("n")).collect()}
    used = sorted(most, key=lambda name: (-most[name], list(SCOPE_COLUMNS).index(name)))
    anchor = F.coalesce(*[F.when(F.size(name) > 0, F.lit(name)) for name in used], F.lit(None).cast("string"))
    start, end = F.col("year_start"), F.col("year_end")
    wanted = readable.select(
        "scope_id", "year_start", "year_end", anchor.alias("anchor"),
        F.filter(known, lambda y: y.between(start, end)).alias("years"), *used,
    )
    anchors = sorted(r["anchor"] for r in wanted.select("anchor").distinct().collect() if r["anchor"])
    return wanted, used, anchors


def _matched(policies: DataFrame, wanted: DataFrame, used: list[str], anchors: list[str]) -> DataFrame:
    """Policies of scopes that restrict a dimension, looked up by the value of its anchor.

    One equi-join for each dimension that is an anchor; a policy is never multiplied. Scopes
    are the small side, which Spark broadcasts after its own size check. Were they too many,
    adaptive execution splits the policies of a value that holds much of the table.
    """
    parts = []
    for anchor in anchors:
        s = wanted.where(F.col("anchor") == anchor).withColumn(
            "anchor_value", F.explode(F.array_distinct(anchor))
        ).alias("s")
        p = policies.alias("p")
        meets = (F.col(f"p.{SCOPE_COLUMNS[anchor]}") == F.col("s.anchor_value")) & F.col(
            "p.uw_year"
        ).between(F.col("s.year_start"), F.col("s.year_end"))
        for name in used:
            if name != anchor:
                kept = F.array_contains(F.col(f"s.{name}"), F.col(f"p.{SCOPE_COLUMNS[name]}"))
                meets &= (F.size(f"s.{name}") == 0) | F.coalesce(kept, F.lit(False))
        parts.append(p.join(s, meets).select("s.scope_id", *[f"p.{c}" for c in policies.columns]))
    if not parts:
        return policies.where(F.lit(False)).select(F.lit(None).cast("string").alias("scope_id"), "*")
    return reduce(lambda a, b: a.unionByName(b), parts)


def match_scopes(policies: DataFrame, scopes: DataFrame) -> DataFrame:
    """Policies of every scope in a table of scopes as ``(scope_id, policy)``.

    Each scope is looked up by the values of one restricted dimension, so a policy meets only
    scopes that name one of its own values instead of every scope there is. The remaining
    dimensions are checked on the pairs that meet. Scopes without a dimension are looked up
    by year.
    """
    wanted, used, anchors = _wanted(policies, scopes)
    by_value = _matched(policies, wanted, used, anchors)
    years = wanted.where("anchor IS NULL").select("scope_id", F.explode("years").alias("uw_year"))
    by_year = policies.join(years, "uw_year").select("scope_id", *policies.columns)
    return by_value.unionByName(by_year)


def _equal_scopes(scopes: DataFrame) -> DataFrame:
    """``(scope_id, counted_id)``: for each id the first of those with the same scopes.

    An id that comes several times stands for all its scopes together.
    """
    texts = F.to_json(F.sort_array(F.collect_list("scope_json")))
    ids = scopes.where("scope_id IS NOT NULL").groupBy("scope_id").agg(F.sha2(texts, 256).alias("texts"))
    first = ids.groupBy("texts").agg(F.min("scope_id").alias("counted_id"))
    return ids.join(first, "texts").select("scope_id", "counted_id")


def _first_of_equal(scopes: DataFrame) -> DataFrame:
    """The scopes of the ids that are counted for all that have the same ones."""
    counted = _equal_scopes(scopes).select(F.col("counted_id").alias("scope_id")).distinct()
    return scopes.join(counted, "scope_id", "left_semi")


def scope_summary(policies: DataFrame, scopes: DataFrame) -> DataFrame:
    """One row per scope: policies, distinct members, gross premium and ``problem``.

    Scopes that match nothing have zeros. Equal scopes are looked up once, and scopes by year alone that cover the same years
    are counted once, on policies reduced to year and member before they meet the years.
    """
    kept = _first_of_equal(scopes)
    wanted, used, anchors = _wanted(policies, kept)
    slim = policies.select(
        "uw_year", *[SCOPE_COLUMNS[name] for name in used], "beneficiary_key",
        micro(F.col("gross_premium_usd")).alias("gross"),
    )
    by_value = (
        _matched(slim, wanted, used, anchors)
        .groupBy("scope_id", "beneficiary_key")
        .agg(F.count(F.lit(1)).alias("n"), sum_micro(F.col("gross")).alias("gross"))
        .groupBy("scope_id")
        .agg(*_totals())
    )
    plain = wanted.where("anchor IS NULL").select("scope_id", "years")
    members = slim.groupBy("uw_year", "beneficiary_key").agg(
        F.count(F.lit(1)).alias("n"), sum_micro(F.col("gross")).alias("gross")
    )
    by_years = (
        plain.select("years").distinct()
        .select("years", F.explode("years").alias("uw_year"))
        .join(members, "uw_year")
        .groupBy("years", "beneficiary_key")
        .agg(F.sum("n").alias("n"), F.sum("gross").alias("gross"))
        .groupBy("years")
        .agg(*_totals())
    )
    found = by_value.unionByName(plain.join(by_years, "years").drop("years"))
    same = _equal_scopes(scopes).join(found.withColumnRenamed("scope_id", "counted_id"), "counted_id")
    return (
        parse_scopes(scopes).select("scope_id", "problem")
        .join(same, "scope_id", "left")
        .select(
            "scope_id", "problem",
            F.coalesce("policy_records", F.lit(0)).alias("policy_records"),
            F.coalesce("beneficiaries", F.lit(0)).alias("beneficiaries"),
            F.coalesce(dollars(F.col("gross")), F.lit(0.0)).alias("gross_premium_usd"),
        )
    )


def _totals() -> list[Column]:
    """Over rows that are one per member, NULL included."""
    return [
        F.sum("n").alias("policy_records"),
        F.count("beneficiary_key").alias("beneficiaries"),
        F.sum("gross").alias("gross"),
    ]


def scope_label() -> Column:
    """Readable text of a parsed scope: three dimensions of three values, then a count."""
    shown = F.array_compact(
        F.array(
            *[
                F.when(
                    F.size(name) > 0,
                    F.concat(
                        F.lit(f"{label}: "),
                        F.array_join(F.slice(name, 1, LABEL_VALUES), ", "),
                        F.when(F.size(name) > LABEL_VALUES, " +").otherwise(""),
                    ),
                )
                for name, label in SCOPE_LABELS.items()
            ]
        )
    )
    more = F.size(shown) - LABEL_DIMENSIONS
    return F.concat(
        F.array_join(F.slice(shown, 1, LABEL_DIMENSIONS), " | "),
        F.when(
            more > 0, F.concat(F.lit(" | +"), more.cast("string"), F.lit(" more filters"))
        ).otherwise(""),
    )


def keep_entities(rows: DataFrame, column: str, values: list[str] | DataFrame) -> DataFrame:
    """Rows whose entity is listed; an empty list keeps every row, a table is semi-joined."""
    if isinstance(values, DataFrame):
        return rows.join(values.select(column), column, "left_semi")
    return rows.where(F.col(column).isin(*values)) if values else rows
