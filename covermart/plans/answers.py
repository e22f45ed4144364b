"""Deterministic answers, context and prompts from the evidence of each question."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covermart.fixed_values import (
    ACTIONS,
    DEFAULT_TARGET,
    IDENTITY_COLUMNS,
    METRIC_CANDIDATES,
    METRIC_CATALOG,
    METRIC_COLUMNS,
    METRIC_LABELS,
    NO_ANSWER_TEXT,
    NO_EVIDENCE_TEXT,
    PENETRATION_COLUMNS,
    PROMPT_EVIDENCE_HEADING,
    PROMPT_INTRO,
    PROMPT_QUESTION_HEADING,
    RATE_METRICS,
    RATE_PARTS,
)
from covermart.functions.text import fixed, format_metric, money, percent
from covermart.operators.coverage import month_end, month_number
from covermart.plans.evidence import (
    NAMED_SOURCES,
    SHAPES,
    json_text,
    limitations,
    shown_columns,
)
from covermart.plans.questions import ENTITY_COLUMNS
from covermart.sources.sinks import EVALUATION_SCHEMA_VERSION

ALL_PORTFOLIO = "All portfolio"
_LOWER_IS_BETTER = "tpa_to_gross_ratio"


def _named(entity_class: str) -> Column:
    return F.size(entity_class) > 0


def _has(intent: str) -> Column:
    return F.array_contains("intents", intent)


def _label(metric: Column) -> Column:
    pairs = F.create_map(*[F.lit(p) for pair in METRIC_LABELS.items() for p in pair])
    return F.element_at(pairs, metric)


def metric_values(frames: dict[str, DataFrame]) -> DataFrame:
    """Every metric of every aggregate row: source, metric, entity, detail, period, needs, value.

    Computed once for a batch. Questions look values up by these keys and never compute one.
    A value comes from the columns that a question for its metric is shown. Where others would
    give one as well, a second row holds the value with them, and ``needs`` names them: it
    counts for questions that are shown them for another metric. The one-row summary has no
    key and is left out.
    """
    parts = []
    for source, (entity, detail, period, _) in SHAPES.items():
        if not (entity or period):
            continue
        columns = frames[source].columns
        values = [
            F.struct(
                F.lit(metric).alias("metric"),
                F.array(*map(F.lit, needs)).cast("array<string>").alias("needs"),
                _frame_value(columns, source, metric, needs).alias("value"),
            )
            for metric in METRIC_CANDIDATES
            for needs in dict.fromkeys([(), _unshown(columns, source, metric)])
        ]
        when = F.lit(None) if period is None else F.col(period)
        parts.append(
            frames[source].select(
                F.lit(source).alias("source"),
                (F.col(entity) if entity else F.lit(None).cast("string")).alias("entity"),
                (F.col(detail) if detail else F.lit(None).cast("string")).alias("detail"),
                (month_number(when) if period == "month_end" else when).cast("int").alias("period"),
                F.inline(F.array(*values)),
            )
        )
    return reduce(lambda a, b: a.unionByName(b), parts).where("value IS NOT NULL")


def _own_columns(columns: list[str], source: str, metric: str) -> list[str]:
    """The columns of a table that a question for a metric alone is shown."""
    shown = METRIC_COLUMNS.get(metric) or PENETRATION_COLUMNS.get(source, ())
    return [c for c in columns if c in (*IDENTITY_COLUMNS[source], *shown)]


def _unshown(columns: list[str], source: str, metric: str) -> tuple[str, ...]:
    """Columns that could give the metric, but are only shown for others."""
    above, below = RATE_PARTS.get(metric, ((), ()))
    own = _own_columns(columns, source, metric)
    return tuple(c for c in columns if c in (*METRIC_CANDIDATES[metric], *above, *below) and c not in own)


def _frame_value(columns: list[str], source: str, metric: str, more: tuple[str, ...]) -> Column:
    """A metric of a table's rows, from the columns shown for it and some more."""
    shown = [*_own_columns(columns, source, metric), *more]

    def first(names: tuple[str, ...]) -> Column:
        known = [F.col(n).cast("double") for n in names if n in shown]
        return F.coalesce(*known, F.lit(None).cast("double"))

    above, below = RATE_PARTS.get(metric, ((), ()))
    return F.coalesce(
        first(METRIC_CANDIDATES[metric]),
        F.when(first(below) != 0, first(above) / first(below)),
    )


#: Contracts are compared by their gross premium over all networks, in whole micro-dollars.
CONTRACTS = "master_contract_network_premium"


def _by_entity(rows: DataFrame, *keys: str) -> DataFrame:
    """Of each entity its last value, or a contract's sum; contracts have no other metric."""
    micros = F.rint(F.col("value") * 1e6).cast("long")
    total = F.sum(micros).cast("double") / F.lit(1e6)
    last = F.max_by("value", F.struct(F.coalesce("period", F.lit(0)), F.size("needs")))
    contract = F.col("source") == CONTRACTS
    known = rows.where("entity IS NOT NULL").where(~contract | (F.col("metric") == "gross_premium_usd"))
    return known.groupBy(*keys, "source", "metric", "entity").agg(
        F.when(contract, total).otherwise(last).alias("value")
    )


def _lowest_and_highest() -> Column:
    """Of compared entities: how many, the lowest and the highest; ties go by name."""
    pair = F.struct("value", "entity")
    return F.struct(
        F.count(F.lit(1)).cast("int").alias("entities"), F.min(pair).alias("low"), F.max(pair).alias("high")
    )


def whole_extremes(values: DataFrame) -> DataFrame:
    """``(compared, primary_metric, whole)``: lowest and highest entity of whole tables.

    For questions that name no entity of the table. A table and a metric give one row, so
    there are at most as many rows as tables times metrics.
    """
    whole = values.where(F.col("source").isin(CONTRACTS, "age_bucket_review", "payer_review", "mobile_by_payer"))
    return (
        _by_entity(whole)
        .groupBy(F.col("source").alias("compared"), F.col("metric").alias("primary_metric"))
        .agg(_lowest_and_highest().alias("whole"))
    )


def _held(source: str) -> Column:
    """Whether a question has evidence from a table; tables without rows are not listed."""
    return F.array_contains(F.col("evidence.source"), source)


def _compared() -> Column:
    """The table whose entities an answer compares; it follows from what the question names."""
    has_gross = F.array_contains("requested_metrics", "gross_premium_usd") | F.arrays_overlap(
        "requested_metrics",
        F.array(F.lit("net_to_gross_ratio"), F.lit("tpa_to_gross_ratio")),
    )
    return (
        F.when(_has("master_contract") & _held(CONTRACTS) & has_gross, F.lit(CONTRACTS))
        .when(_has("demographic") & _held("age_bucket_review"), "age_bucket_review")
        .when(
            _named("payer_countries"),
            F.when(_held("monthly_country_kpis"), "monthly_country_kpis").otherwise("none"),
        )
        .when(
            _named("policy_types"),
            F.when(_held("policy_type_review"), "policy_type_review").otherwise("none"),
        )
        .when(_has("payer") & _held("payer_review"), "payer_review")
        .when(_has("adoption") & _held("mobile_by_payer"), "mobile_by_payer")
        .otherwise("none")
    )


def _is_named() -> Column:
    """Whether the question names entities of the compared table."""
    named = [(F.col("compared") == s) & _named(c) for s, c in NAMED_SOURCES.items()]
    return reduce(lambda a, b: a | b, named)


def _valued(asked: DataFrame, values: DataFrame) -> DataFrame:
    """Evidence rows of one table per question with the value of the primary metric.

    ``asked`` has question_id, source, metric, requested_metrics and evidence. The rows' keys
    alone are read, and looked up among the values by equality.
    """
    entries = asked.select(
        "question_id", F.col("source").alias("asked"), "metric",
        shown_columns(F.col("source")).alias("shown"), F.explode("evidence").alias("e"),
    )
    rows = entries.where(F.col("e.source") == F.col("asked")).select(
        "question_id", F.col("e.source").alias("source"), "metric", "shown", F.explode("e.rows").alias("r")
    )
    keys = rows.select("question_id", "source", "metric", "shown", "r.entity", "r.detail", "r.period").alias("k")
    v = values.alias("v")
    same = [F.col(f"k.{c}").eqNullSafe(F.col(f"v.{c}")) for c in ("entity", "detail", "period")]
    on = reduce(lambda a, b: a & b, same, (F.col("k.source") == F.col("v.source")) & (F.col("k.metric") == F.col("v.metric")))
    visible = F.size(F.array_except("v.needs", "k.shown")) == 0
    return keys.join(v, on).where(visible).select("k.*", "v.needs", "v.value").drop("shown")


def named_extremes(evidence: DataFrame, values: DataFrame) -> DataFrame:
    """``(question_id, named)``: the extremes among the entities that a question names."""
    asked = (
        evidence.withColumn("compared", _compared()).where(_is_named())
        .select("question_id", F.col("compared").alias("source"), F.col("primary_metric").alias("metric"),
                "requested_metrics", "evidence")
    )
    found = _by_entity(_valued(asked, values), "question_id")
    return found.groupBy("question_id").agg(_lowest_and_highest().alias("named"))


def with_extremes(evidence: DataFrame, values: DataFrame) -> DataFrame:
    """Adds ``extremes``: the entities with the lowest and highest primary metric.

    Named entities are compared with each other, otherwise all entities of the table
    (:func:`whole_extremes`), not only those that the evidence lists. Entities with equal
    values are taken in name order. Lower is better for the fee ratio only.
    """
    e = F.col("found")
    rate = F.col("primary_metric").isin(*RATE_METRICS)
    lower_is_better = F.col("primary_metric") == _LOWER_IS_BETTER
    extremes = F.struct(
        e["entities"].alias("entities"),
        e["low"]["entity"].alias("low_entity"),
        e["low"]["value"].alias("low_value"),
        e["high"]["entity"].alias("high_entity"),
        e["high"]["value"].alias("high_value"),
        (e["high"]["value"] - e["low"]["value"]).alias("gap"),
        F.when(lower_is_better, e["high"]["entity"])
        .when((e["entities"] > 1) & rate, e["low"]["entity"])
        .alias("priority_entity"),
    )
    return (
        evidence.withColumn("compared", _compared())
        .join(F.broadcast(whole_extremes(values)), ["compared", "primary_metric"], "left")
        .join(named_extremes(evidence, values), "question_id", "left")
        .withColumn("found", F.when(_is_named(), F.col("named")).otherwise(F.col("whole")))
        .withColumn("extremes", F.when(e.isNotNull(), extremes))
        .drop("whole", "named", "found")
    )


def _gap_text(metric: Column, gap: Column) -> Column:
    points = F.concat(fixed(F.abs(gap) * 100, "0.0"), F.lit(" percentage points"))
    return F.when(metric.isin(*RATE_METRICS), points).otherwise(
        format_metric(metric, F.abs(gap))
    )


def _entity_texts() -> tuple[Column, Column]:
    """Headline and evidence line about the compared entities; NULL without any."""
    metric, e = F.col("primary_metric"), F.col("extremes")
    label = _label(metric)
    low, high = format_metric(metric, e["low_value"]), format_metric(metric, e["high_value"])
    gap = _gap_text(metric, e["gap"])
    single = F.concat(
        e["low_entity"], F.lit(" is at "), low, F.lit(" for "), label, F.lit(".")
    )
    worst = F.concat(
        e["high_entity"], F.lit(" has the highest "), label, F.lit(" at "), high, F.lit(", "),
        gap, F.lit(" above "), e["low_entity"], F.lit("."),
    )
    leads = F.concat(
        e["high_entity"], F.lit(" leads "), e["low_entity"], F.lit(" on "), label, F.lit(": "),
        high, F.lit(" versus "), low, F.lit(", a "), gap, F.lit(" gap."),
    )
    largest = F.concat(
        e["high_entity"], F.lit(" is largest on "), label, F.lit(" at "), high, F.lit("; "),
        e["low_entity"], F.lit(" is at "), low, F.lit("."),
    )
    peers = F.concat(
        F.lit("The peer range runs from "), e["low_entity"], F.lit(" at "), low, F.lit(" to "),
        e["high_entity"], F.lit(" at "), high, F.lit("."),
    )
    observed = F.concat(
        F.lit("The observed "), label, F.lit(" range is "), low, F.lit(" to "), high,
        F.lit(" across the selected entities."),
    )
    one, fee = e["entities"] == 1, metric == _LOWER_IS_BETTER
    headline = (
        F.when(one, single).when(fee, worst).when(metric.isin(*RATE_METRICS), leads)
        .otherwise(largest)
    )
    line = F.when(one, single).when(fee, peers).otherwise(observed)
    return F.when(e.isNotNull(), headline), F.when(e.isNotNull(), line)


def with_trend(evidence: DataFrame, values: DataFrame) -> DataFrame:
    """Adds ``trend``: the last two points of the first series that has two."""
    series = ("monthly_kpis", "premium_by_year")
    asked = evidence.select(
        "question_id", F.explode(F.array(*map(F.lit, series))).alias("source"),
        F.col("primary_metric").alias("metric"), "requested_metrics", "evidence",
    )
    # a series has as many points as the calendar has periods
    points = F.sort_array(F.collect_list(F.struct("period", F.size("needs"), "value")), False)
    now = F.col("points")[0]
    before = F.get(F.filter("points", lambda p: p["period"] < now["period"]), F.lit(0))
    trend = F.struct(
        "source",
        now["period"].alias("period"),
        now["value"].alias("value"),
        before["period"].alias("previous_period"),
        before["value"].alias("previous_value"),
    )
    found = (
        _valued(asked, values)
        .groupBy("question_id", "source").agg(points.alias("points")).where(before.isNotNull())
        .groupBy("question_id").agg(F.min_by(trend, "source").alias("trend"))
    )
    return evidence.join(found, "question_id", "left")


def _trend_text() -> Column:
    metric, t = F.col("primary_metric"), F.col("trend")
    monthly = t["source"] == "monthly_kpis"

    def when(period: Column) -> Column:
        return F.when(monthly, F.date_format(month_end(period), "MMM yyyy")).otherwise(
            period.cast("string")
        )

    points = (t["value"] - t["previous_value"]) * 100
    moved = (
        F.when(
            metric.isin(*RATE_METRICS),
            F.concat(
                F.when(points >= 0, "+").otherwise(""), fixed(points, "0.0"),
                F.lit(" percentage points"),
            ),
        )
        .when(t["previous_value"] == 0, "from a zero base")
        .otherwise(percent(F.try_divide(t["value"], t["previous_value"]) - 1))
    )
    text = F.concat(
        F.when(monthly, "Monthly ").otherwise("Underwriting-year "), _label(metric),
        F.lit(" is "), format_metric(metric, t["value"]), F.lit(" in "), when(t["period"]),
        F.lit(", "), moved, F.lit(" versus "), when(t["previous_period"]), F.lit("."),
    )
    return F.when(t.isNotNull(), text)


def with_scope_line(evidence: DataFrame, summary: DataFrame) -> DataFrame:
    """Adds ``scope_line``, from the columns of the one-row summary that the question is shown."""
    numbers = [c for c, kind in summary.dtypes if kind in ("bigint", "int", "double")]
    one = summary.agg(F.max(F.struct(*[F.col(c).cast("double").alias(c) for c in numbers]))).scalar()
    row, shown = F.col("summary_row"), F.col("summary_columns")

    def first(metric: str) -> Column:
        known = [c for c in METRIC_CANDIDATES[metric] if c in numbers]
        return F.coalesce(*[F.when(F.array_contains(shown, c), row[c]) for c in known], F.lit(None).cast("double"))

    members, gross, net = map(first, ("unique_beneficiaries", "gross_premium_usd", "net_premium_usd"))
    text = F.concat(
        F.lit("The applied scope covers "), fixed(members, "#,##0"),
        F.lit(" unique beneficiaries and "), money(gross), F.lit(" GP"),
        F.when(net.isNotNull(), F.concat(F.lit(" / "), money(net), F.lit(" NP"))).otherwise(""),
        F.lit("."),
    )
    known = _held("summary") & members.isNotNull() & gross.isNotNull()
    return (
        evidence.withColumn("summary_columns", shown_columns(F.lit("summary")))
        .withColumn("summary_row", one)
        .withColumn("scope_line", F.when(known, text))
        .drop("summary_columns", "summary_row")
    )


def _action_text(place: int) -> Column:
    target = F.coalesce("extremes.priority_entity", F.lit(DEFAULT_TARGET))

    def written(name: str) -> Column:
        before, marker, after = ACTIONS[name][place].partition("{target}")
        return F.concat(F.lit(before), target, F.lit(after)) if marker else F.lit(before)

    text = written("other")
    for name in ("population", "economics", "adoption"):
        text = F.when(_has(name), written(name)).otherwise(text)
    return text


def answer_questions(evidence: DataFrame, values: DataFrame, summary: DataFrame) -> DataFrame:
    """Adds ``limitations`` and the Markdown ``answer`` of every question.

    ``values`` is :func:`metric_values` of the tables the evidence was taken from, ``summary``
    the one-row table. ``evidence`` is read three times and should be stored. Extremes and
    trends are small tables by question, joined back to it.
    """
    headline, entity_line = _entity_texts()
    found = with_trend(with_extremes(evidence, values), values)
    prepared = with_scope_line(found, summary).withColumns(
        {
            "limitations": limitations(),
            "headline": headline,
            "entity_line": entity_line,
            "trend_line": _trend_text(),
        }
    )
    lines = F.concat(
        F.array_compact(F.array("entity_line", "trend_line", "scope_line")),
        F.transform("limitations", lambda gap: F.concat(F.lit("Limitation: "), gap)),
    )
    lines = F.when(F.size(lines) > 0, lines).otherwise(F.array(F.lit(NO_EVIDENCE_TEXT)))
    bullets = F.transform(lines, lambda line: F.concat(F.lit("- "), line))
    answer = F.concat(
        F.lit("**Executive answer**\n\n"),
        F.coalesce("headline", "trend_line", "scope_line", F.lit(NO_ANSWER_TEXT)),
        F.lit("\n\n**Evidence**\n"), F.array_join(bullets, "\n"),
        F.lit("\n\n**Recommended actions**\n1. "), _action_text(0),
        F.lit("\n2. "), _action_text(1),
    )
    return prepared.withColumn("answer", answer).drop(
        "headline", "entity_line", "trend_line", "scope_line"
    )


# --- JSON and prompts ----------------------------------------------------------------


def _json(value: Column) -> Column:
    return F.to_json(value)


def _matched_json() -> Column:
    return _json(F.struct(*[F.col(c) for c in sorted(ENTITY_COLUMNS)]))


def _evidence_json() -> Column:
    by_name = F.array_sort(
        "evidence",
        lambda a, b: F.when(a["source"] < b["source"], -1)
        .when(a["source"] > b["source"], 1)
        .otherwise(0),
    )

    def row(r: Column) -> Column:
        cells = F.transform(
            r["cells"], lambda c: F.concat(F.lit('"'), c["name"], F.lit('":'), c["json"])
        )
        return F.concat(F.lit("{"), F.array_join(cells, ","), F.lit("}"))

    tables = F.transform(
        by_name,
        lambda e: F.concat(
            F.lit('"'), e["source"], F.lit('":['),
            F.array_join(F.transform(e["rows"], row), ","), F.lit("]"),
        ),
    )
    return F.concat(F.lit("{"), F.array_join(tables, ","), F.lit("}"))


def context_json(scope: Column) -> Column:
    """Compact JSON of everything an answer may use, keys in name order."""
    quoted = lambda c: F.regexp_replace(_json(F.array(c)), r"^\[|\]$", "")
    parts = {
        "evidence": _evidence_json(),
        "intents": _json(F.col("intents")),
        "limitations": _json(F.col("limitations")),
        "matched_entities": _matched_json(),
        "question": quoted(F.col("question")),
        "question_focus": quoted(F.col("question_focus")),
        "requested_metrics": _json(F.col("requested_metrics")),
        "scope": quoted(scope),
    }
    pieces = [F.concat(F.lit(f'"{k}":'), v) for k, v in parts.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *pieces), F.lit("}"))


def with_context(answered: DataFrame, scope: str) -> DataFrame:
    """Adds ``context`` and, in place of ``evidence``, the names of the tables it comes from."""
    context = context_json(F.lit(scope or ALL_PORTFOLIO))
    return answered.withColumns({"context": context, "held": F.col("evidence.source")}).drop("evidence")


def prompt_text(question: Column, context: Column) -> Column:
    """Instruction, question and whole context, as a prompt dataset column."""
    return F.concat(
        F.lit(PROMPT_INTRO + PROMPT_QUESTION_HEADING), F.trim(question),
        F.lit(PROMPT_EVIDENCE_HEADING), F.trim(context),
    )


def aggregate_rows(frames: dict[str, DataFrame]) -> DataFrame:
    """All aggregate values as ``(table_name, row_json)``, one row per aggregate row.

    A table, not one document, because the payer tables grow with the portfolio. Values are
    written as in the evidence.
    """

    def row(frame: DataFrame) -> Column:
        cells = [
            F.concat(F.lit(f'"{name}":'), json_text(name, kind))
            for name, kind in sorted(frame.dtypes)
        ]
        return F.concat(F.lit("{"), F.concat_ws(",", *cells), F.lit("}"))

    parts = [
        frame.select(F.lit(name).alias("table_name"), row(frame).alias("row_json"))
        for name, frame in frames.items()
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def metric_catalog_json() -> Column:
    """The metric dictionary as a JSON object."""
    return F.to_json(
        F.struct(
            *[
                F.struct(
                    *[F.lit(text).alias(metric) for metric, text in sorted(metrics.items())]
                ).alias(table)
                for table, metrics in sorted(METRIC_CATALOG.items())
            ]
        )
    )


def evaluation_records(
    answered: DataFrame,
    scope: str,
    scope_json: str,
    aggregates_path: str,
    engine: str,
    batch: str,
    started: datetime.datetime,
) -> DataFrame:
    """One record per answered question (:func:`with_context`), in the layout of the evaluation dataset.

    Ids follow from the batch and the question, and the time is that of the batch, so a batch
    that is run again gives the same records. Values shared by the batch are written once: ``all_aggregate_metrics_json`` holds the
    metric dictionary and names the folder of the batch's aggregate rows.
    """
    aggregates = F.concat(
        F.lit('{"metric_catalog":'), metric_catalog_json(),
        F.lit(',"values_path":'),
        F.regexp_replace(F.to_json(F.array(F.lit(aggregates_path))), r"^\[|\]$", ""),
        F.lit("}"),
    )
    scope_text = F.lit(scope or ALL_PORTFOLIO)
    none = F.lit(None).cast("double")
    return answered.select(
        F.lit(EVALUATION_SCHEMA_VERSION).alias("schema_version"),
        F.md5(F.to_json(F.array(F.lit(batch), F.col("question_id").cast("string")))).alias("interaction_id"),
        F.lit(started).alias("timestamp_utc"),
        "question",
        "question_focus",
        _json(F.col("intents")).alias("intents_json"),
        _json(F.col("requested_metrics")).alias("requested_metrics_json"),
        _matched_json().alias("matched_entities_json"),
        _json(F.col("held")).alias("source_tables_json"),
        scope_text.alias("scope"),
        F.lit(scope_json).alias("filter_spec_json"),
        F.col("context").alias("evidence_context_json"),
        aggregates.alias("all_aggregate_metrics_json"),
        "answer",
        F.lit(engine).alias("response_engine"),
        F.lit("fallback").alias("response_status"),
        F.lit("").alias("configured_model"),
        F.lit("").alias("generation_profile"),
        F.lit("not_checked").alias("model_check_status"),
        F.lit("").alias("error_message"),
        none.alias("planning_ms"),
        none.alias("response_ms"),
        none.alias("dashboard_query_ms"),
        F.lit(batch).alias("batch"),
    )
