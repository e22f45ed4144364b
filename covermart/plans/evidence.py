"""Aggregate evidence for every question of a routed table.

Aggregates are turned into rows of one shape: an entity, a period and named cells. Rows that
many questions share (the latest months, a top twelve) form a lookup table bounded by the
calendar and the countries. Spark checks its size and broadcasts it, so a slice that a third
of all questions ask for is not a hot join key; were it ever too large, the join is shuffled
and adaptive execution splits the hot keys. Rows of named entities are joined by entity.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covermart.fixed_values import (
    COUNTRY_ECONOMICS_LIMITATION,
    IDENTITY_COLUMNS,
    METRIC_CANDIDATES,
    METRIC_COLUMNS,
    MISSING_EVIDENCE,
    PENETRATION_COLUMNS,
    RATE_PARTS,
    SUMMARY_ONLY_LIMITATION,
    TOP_ENTITIES,
    TRAILING_ROWS,
)
from covermart.operators.coverage import month_number
from covermart.operators.monthly import active_population
from covermart.operators.reviews import contract_totals, latest_active
from covermart.operators.timeintel import trailing_months
from covermart.operators.topn import topn_semi

# Evidence table -> (entity column, detail column, period column, entity class).
SHAPES = {
    "summary": (None, None, None, None),
    "monthly_kpis": (None, None, "month_end", None),
    "monthly_country_kpis": ("payer_country", None, "month_end", "payer_countries"),
    "premium_by_year": (None, None, "uw_year", None),
    "payer_review": ("payer_name", None, None, "payers"),
    "master_contract_network_premium": (
        "master_contract", "network_type", None, "master_contracts",
    ),
    "age_bucket_review": ("age_bucket", None, None, "age_buckets"),
    "policy_type_review": ("policy_type", None, None, "policy_types"),
    "mobile_by_payer": ("payer_name", None, None, "payers"),
}
NAMED_SOURCES = {source: shape[3] for source, shape in SHAPES.items() if shape[3]}


# --- rows of one shape ---------------------------------------------------------------


def json_text(name: str, kind: str) -> Column:
    """A column's value as JSON text; NULL becomes ``null``."""
    value = F.col(name)
    if kind == "string":
        text = F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", "")
    elif kind == "date":
        text = F.concat(F.lit('"'), value.cast("string"), F.lit('T00:00:00"'))
    elif kind == "double":
        digits = F.round(value, 10).cast("decimal(38,10)").cast("string")
        text = F.regexp_replace(F.regexp_replace(digits, "0+$", ""), r"\.$", ".0")
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit("null"))


def evidence_row(
    source: str, frame: DataFrame, place: Column | str | None = None, section: str = ""
) -> Column:
    """One aggregate row as a struct; ``section`` and ``place`` give the listing order.

    Cells are in name order, the order in which JSON keys are written.
    """
    entity, detail, period, _ = SHAPES[source]
    kinds = dict(frame.dtypes)
    number_kinds = ("double", "bigint", "int")
    columns = [c for c in kinds if c not in ("ranking", "place")]
    cells = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                json_text(name, kinds[name]).alias("json"),
                (F.col(name) if kinds[name] in number_kinds else F.lit(None))
                .cast("double")
                .alias("number"),
            )
            for name in sorted(columns)
        ]
    )
    if period == "month_end":
        when = month_number(F.col("month_end"))
    else:
        when = F.col(period) if period else F.lit(None).cast("int")
    order = F.lit(0) if place is None else (F.col(place) if isinstance(place, str) else place)
    return F.struct(
        (F.col(section) if section else F.lit("")).alias("section"),
        order.cast("double").alias("place"),
        (F.col(entity) if entity else F.lit(None).cast("string")).alias("entity"),
        (F.col(detail) if detail else F.lit(None).cast("string")).alias("detail"),
        when.alias("period"),
        cells.alias("cells"),
    )


# --- shared rows ---------------------------------------------------------------------


def rankings(frame: DataFrame, source: str) -> DataFrame:
    """The first entities of a table under every order that a question can ask for.

    Adds ``ranking`` and ``place``. NULL measures rank last, ties go by name. Spark keeps
    only the first rows of each ranking before it shuffles them.
    """
    entity = SHAPES[source][0]
    measures = {
        "adoption": "app_penetration_rate", "fee": "tpa_to_gross_ratio",
        "gross": "gross_premium_usd",
    }
    if source == "mobile_by_payer":
        measures = {"adoption": "registered_user_penetration"}
    orders = [
        F.struct(F.lit(f"{name}:{way}").alias("ranking"), (F.col(c) * sign).alias("measure"))
        for name, c in measures.items()
        for way, sign in (("asc", 1.0), ("desc", -1.0))
    ]
    if source == "mobile_by_payer":  # has no other measure, so it stays as listed
        listed = F.col("unique_beneficiaries") * F.lit(-1.0)
        orders.append(F.struct(F.lit("listed").alias("ranking"), listed.alias("measure")))
    first = Window.partitionBy("ranking").orderBy(F.asc_nulls_last("measure"), entity)
    return (
        frame.select("*", F.inline(F.array(*orders)))
        .withColumn("place", F.row_number().over(first))
        .where(F.col("place") <= TOP_ENTITIES)
        .drop("measure")
    )


def ranking_key(source: str) -> Column:
    """The ranking of a table that a routed question wants."""
    key = F.concat_ws(":", "rank_by", "direction")
    if source == "mobile_by_payer":
        return F.when(F.col("rank_by") == "adoption", key).otherwise("listed")
    return key


def _packed(source: str, rows: DataFrame, key: Column, row: Column) -> DataFrame:
    """Rows of a small table gathered under a key."""
    return (
        rows.select(key.cast("string").alias("key"), row.alias("row"))
        .groupBy("key")
        .agg(F.sort_array(F.collect_list("row")).alias("rows"))
        .select(F.lit(source).alias("source"), "key", "rows")
    )


def _month_slices(months: DataFrame) -> DataFrame:
    """Month rows under ``latest``, ``trailing`` and their year."""
    source = "monthly_kpis"
    row = evidence_row(source, months, month_number(F.col("month_end")))
    recent = trailing_months(months, TRAILING_ROWS)
    last = trailing_months(months, 1)
    return (
        _packed(source, last, F.lit("latest"), row)
        .unionByName(_packed(source, recent, F.lit("trailing"), row))
        .unionByName(_packed(source, months, F.year("month_end"), row))
    )


def _country_slices(countries: DataFrame) -> DataFrame:
    """All countries under ``latest``, ``trailing`` and their year, largest population first."""
    source = "monthly_country_kpis"
    row = evidence_row(source, countries, -F.col("active_population"))
    recent = trailing_months(countries, TRAILING_ROWS)
    last = trailing_months(countries, 1)
    return (
        _packed(source, last, F.lit("latest"), row)
        .unionByName(_packed(source, recent, F.lit("trailing"), row))
        .unionByName(_packed(source, countries, F.year("month_end"), row))
    )


def shared_evidence(frames: dict[str, DataFrame]) -> DataFrame:
    """``(source, key, rows)`` for evidence that does not depend on a named entity."""
    packs = [
        _packed("summary", frames["summary"], F.lit("all"),
                evidence_row("summary", frames["summary"])),
        _packed("premium_by_year", frames["premium_by_year"], F.lit("all"),
                evidence_row("premium_by_year", frames["premium_by_year"], "uw_year")),
        _month_slices(frames["monthly_kpis"]),
        _country_slices(frames["monthly_country_kpis"]),
    ]
    for source in ("payer_review", "age_bucket_review", "mobile_by_payer"):
        ranked = rankings(frames[source], source)
        packs.append(
            _packed(source, ranked, F.col("ranking"), evidence_row(source, ranked, "place"))
        )
    policy_types = frames["policy_type_review"].orderBy(
        F.desc_nulls_last("gross_premium_usd"), "policy_type"
    ).limit(TOP_ENTITIES)
    packs.append(
        _packed("policy_type_review", policy_types, F.lit("listed"),
                evidence_row("policy_type_review", policy_types, _largest_first()))
    )
    source = "master_contract_network_premium"
    contracts = frames[source]
    top = topn_semi(contracts, contract_totals(contracts), "master_contract", TOP_ENTITIES)
    packs.append(
        _packed(source, top, F.lit("listed"),
                evidence_row(source, top, _largest_first(), "master_contract"))
    )
    return reduce(lambda a, b: a.unionByName(b), packs)


def _largest_first() -> Column:
    return -F.coalesce("gross_premium_usd", F.lit(float("-inf")))


def entity_evidence(frames: dict[str, DataFrame]) -> DataFrame:
    """``(source, entity, rows)``: every row of every entity that a question can name.

    An entity has one row, one per network type, or one per month.
    """
    packs = []
    for source, (entity, detail, period, entity_class) in SHAPES.items():
        if entity_class is None:
            continue
        frame = frames[source]
        if period:
            row = evidence_row(source, frame, month_number(F.col(period)))
        elif detail:
            row = evidence_row(source, frame, _largest_first(), entity)
        elif "gross_premium_usd" in frame.columns:
            row = evidence_row(source, frame, _largest_first())
        else:
            row = evidence_row(source, frame, -F.col("unique_beneficiaries"))
        packs.append(
            frame.groupBy(F.col(entity).alias("entity"))
            .agg(F.sort_array(F.collect_list(row)).alias("rows"))
            .select(F.lit(source).alias("source"), "entity", "rows")
        )
    return reduce(lambda a, b: a.unionByName(b), packs)


# --- evidence of each question -------------------------------------------------------


def _literal_map(pairs: dict[str, tuple[str, ...]]) -> Column:
    return F.create_map(
        *[
            part
            for key, values in pairs.items()
            for part in (F.lit(key), F.array(*[F.lit(v) for v in values]))
        ]
    )


def shown_columns(source: Column) -> Column:
    """The columns of an evidence table that a question's metrics call for."""
    general = _literal_map(METRIC_COLUMNS)
    penetration = _literal_map(PENETRATION_COLUMNS)
    nothing = F.array().cast("array<string>")
    asked = F.flatten(
        F.transform(
            "requested_metrics",
            lambda m: F.coalesce(
                F.when(m == "app_penetration_rate", F.try_element_at(penetration, source))
                .otherwise(F.try_element_at(general, m)),
                nothing,
            ),
        )
    )
    return F.array_distinct(F.concat(F.element_at(_literal_map(IDENTITY_COLUMNS), source), asked))


def _selectors() -> Column:
    """What a question wants of each of its tables, as an array of structs."""

    def wants(source: str, key: Column, rank: int = 2, entity: Column | None = None) -> Column:
        return F.struct(
            F.lit(source).alias("source"),
            key.cast("string").alias("key"),
            (F.lit(None).cast("string") if entity is None else entity).alias("entity"),
            F.lit(rank).alias("rank"),
        )

    def wants_year(source: str):
        return lambda year: wants(source, year, 1)

    def wants_entity(source: str):
        return lambda entity: wants(source, F.lit(None), 2, entity)

    parts = []
    for source in SHAPES:
        asked = F.array_contains("source_tables", source)
        entity_class = NAMED_SOURCES.get(source)
        if source in ("summary", "premium_by_year"):
            shared = F.array(wants(source, F.lit("all")))
        elif source in ("monthly_kpis", "monthly_country_kpis"):
            by_year = F.transform("years", wants_year(source))
            shared = F.concat(by_year, F.array(wants(source, F.col("time_mode"))))
        elif source in ("payer_review", "age_bucket_review", "mobile_by_payer"):
            shared = F.array(wants(source, ranking_key(source)))
        else:
            shared = F.array(wants(source, F.lit("listed")))
        if entity_class:
            named = F.transform(entity_class, wants_entity(source))
            shared = F.when(F.size(entity_class) > 0, named).otherwise(shared)
        parts.append(F.when(asked, shared).otherwise(F.filter(shared, lambda s: F.lit(False))))
    return F.concat(*parts)


def _sliced_entity_rows() -> tuple[Column, Column]:
    """Rank and rows of a named entity; country rows are cut to the asked time."""
    timed = F.col("source") == "monthly_country_kpis"
    of_years = F.filter(
        "rows", lambda r: F.array_contains("years", F.floor(r["period"] / 12).cast("int"))
    )
    recent = F.when(
        F.col("time_mode") == "trailing", F.slice("rows", -TRAILING_ROWS, TRAILING_ROWS)
    ).otherwise(F.slice("rows", -1, 1))
    recent = F.when(
        F.size("rows") > F.when(F.col("time_mode") == "trailing", TRAILING_ROWS).otherwise(1),
        recent,
    ).otherwise(F.col("rows"))
    has_years = timed & (F.size(of_years) > 0)
    rank = F.when(has_years, 1).otherwise(2)
    rows = F.when(has_years, of_years).when(timed, recent).otherwise(F.col("rows"))
    return rank, rows


def question_evidence(
    routed: DataFrame, shared: DataFrame, entities: DataFrame
) -> DataFrame:
    """Routed questions with ``evidence``: ``array<struct<source, rows>>``.

    Tables come in the order of ``source_tables``; a table without rows is left out. Only
    the cells that the question calls for are carried through the final grouping.
    """
    wanted = routed.select(
        "question_id", "requested_metrics", "years", "time_mode", F.inline(_selectors())
    )
    from_shared = (
        wanted.where("entity IS NULL")
        .join(shared, ["source", "key"])
        .select("question_id", "requested_metrics", "source", "rank", "rows")
    )
    rank, rows = _sliced_entity_rows()
    from_entities = (
        wanted.where("entity IS NOT NULL")
        .drop("rank")
        .join(entities, ["source", "entity"])
        .select("question_id", "requested_metrics", "source", rank.alias("rank"),
                rows.alias("rows"))
    )
    shown = F.transform(
        "rows",
        lambda r: r.withField(
            "cells", F.filter(r["cells"], lambda c: F.array_contains("shown", c["name"]))
        ),
    )
    found = (
        from_shared.unionByName(from_entities)
        .withColumn("shown", shown_columns(F.col("source")))
        .select("question_id", F.struct("source", "rank", shown.alias("rows")).alias("found"))
        .groupBy("question_id")
        .agg(F.collect_list("found").alias("found"))
    )
    return (
        routed.join(found, "question_id", "left")
        .withColumn("evidence", _merged())
        .drop("found")
    )


def _merged() -> Column:
    """One entry per table: the best-ranked slices, together and in listing order."""

    def of_source(source: Column) -> Column:
        parts = F.filter("found", lambda f: f["source"] == source)
        best = F.array_min(F.transform(parts, lambda f: f["rank"]))
        kept = F.filter(parts, lambda f: f["rank"] == best)
        rows = F.flatten(F.transform(kept, lambda f: f["rows"]))
        return F.struct(
            source.alias("source"), best.alias("rank"), F.sort_array(rows).alias("rows")
        )

    def cut(entry: Column) -> Column:
        """Named countries without a year or a trend are shown in their last month."""
        rows = entry["rows"]
        last = F.array_max(F.transform(rows, lambda r: r["period"]))
        latest = F.filter(rows, lambda r: r["period"] == last)
        once = (
            (entry["source"] == "monthly_country_kpis")
            & (F.size("payer_countries") > 0)
            & (entry["rank"] != 1)
            & (F.col("time_mode") != "trailing")
        )
        return F.struct(
            entry["source"].alias("source"), F.when(once, latest).otherwise(rows).alias("rows")
        )

    merged = F.transform(F.transform("source_tables", of_source), cut)
    kept = F.filter(merged, lambda e: F.coalesce(F.size(e["rows"]), F.lit(0)) > 0)
    return kept


def evidence_cells(evidence: DataFrame) -> DataFrame:
    """Evidence in long form, one row per question, table, row and shown column."""
    rows = evidence.select("question_id", F.inline("evidence")).select(
        "question_id", "source", F.explode("rows").alias("row")
    )
    cells = rows.select(
        "question_id", "source", "row.entity",
        F.when(F.col("source") == "master_contract_network_premium", F.col("row.detail"))
        .alias("detail"),
        "row.period", F.inline("row.cells"),
    )
    return cells.select(
        "question_id", "source", "entity", "detail", "period",
        F.col("name").alias("column_name"), F.col("json").alias("value_text"),
        F.col("number").alias("value"),
    )


def limitations() -> Column:
    """Gaps in the evidence of a question, in report order."""
    has = lambda name: F.array_contains("intents", name)
    gaps = [
        F.when(
            (F.size(entity_class) > 0) & ~F.array_contains(F.col("evidence.source"), source), F.lit(text)
        )
        for (entity_class, source), text in MISSING_EVIDENCE.items()
    ]
    gaps.append(
        F.when(has("country") & has("economics"), F.lit(COUNTRY_ECONOMICS_LIMITATION))
    )
    gaps.append(F.when(F.size("evidence") == 1, F.lit(SUMMARY_ONLY_LIMITATION)))
    return F.array_compact(F.array(*gaps))


def metric_value(cells: Column, metric: Column) -> Column:
    """A metric from a row's cells: its first non-NULL column, else its two parts' ratio."""
    numbers = F.map_from_entries(F.transform(cells, lambda c: F.struct(c["name"], c["number"])))

    def first(names: Column) -> Column:
        known = F.transform(names, lambda n: F.try_element_at(numbers, n))
        return F.try_element_at(F.array_compact(known), F.lit(1))

    direct = first(F.element_at(_literal_map(METRIC_CANDIDATES), metric))
    above = {m: parts[0] for m, parts in RATE_PARTS.items()}
    below = {m: parts[1] for m, parts in RATE_PARTS.items()}
    numerator = first(F.try_element_at(_literal_map(above), metric))
    denominator = first(F.try_element_at(_literal_map(below), metric))
    return F.coalesce(direct, F.when(denominator != 0, numerator / denominator))


def evidence_frames(
    summary: DataFrame,
    monthly_kpis: DataFrame,
    monthly_country_kpis: DataFrame,
    **others: DataFrame,
) -> dict[str, DataFrame]:
    """The nine tables that evidence is taken from, by name."""
    return {
        "summary": latest_active(summary, active_population(monthly_kpis)),
        "monthly_kpis": monthly_kpis,
        "monthly_country_kpis": monthly_country_kpis,
        **others,
    }
