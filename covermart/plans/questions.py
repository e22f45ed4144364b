"""Routing a table of questions: entities, intents, metrics, sources and focus.

Every step is a column of the question row. Entities are the only join: the word runs of a
question are looked up in the dictionary by equality, so neither side meets rows that it
does not share a phrase with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covermart.fixed_values import (
    ENTITY_INTENTS,
    FOCUS_LABELS,
    INTENT_PHRASES,
    LOWEST_WORDS,
    METRIC_PHRASES,
    METRIC_PRIORITY,
    RANK_BY_ADOPTION_WORDS,
    RANK_BY_FEE_WORDS,
    TREND_WORDS,
)
from covermart.functions.clean import unassigned
from covermart.functions.text import clean_question, has_any, normalize_phrase, years_in
from covermart.operators.coverage import covers_a_month

ENTITY_COLUMNS = {
    "payers": "payer_name",
    "payer_countries": "payer_country",
    "policy_types": "policy_type",
    "master_contracts": "master_contract",
    "age_buckets": "age_bucket",
}

#: A dictionary of at most so many bytes is broadcast; copies of a larger one; its bitmap's bits.
DICTIONARY_BYTES = 32 << 20
SALTS, BITMAP_BITS = 16, 32768


def normalize_questions(questions: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(question_id, question, normalised)`` and ``keep``; questions without text are dropped."""
    return (
        questions.select("question_id", clean_question(F.col("question")).alias("question"), *keep)
        .where("question <> ''")
        .withColumn("normalised", normalize_phrase(F.col("question")))
    )


def listed_questions(questions: DataFrame, tasks: int) -> DataFrame:
    """``(question_id, asked_id, texts)``: the texts of each id, and a digest of them.

    Ids with the same texts have the same answers. An id may come several times: everything
    that is looked up by id is looked up for all its texts. Rows without an id stay on their
    own, as no lookup finds them; their ``asked_id`` is NULL.
    """
    cleaned = normalize_questions(questions.repartition(tasks)).drop("normalised")
    alone = F.when(F.col("question_id").isNull(), F.col("question"))
    return (
        cleaned.groupBy("question_id", alone.alias("alone"))
        .agg(F.sort_array(F.collect_list("question")).alias("texts"))
        .select(
            "question_id",
            F.when(F.col("question_id").isNotNull(), F.sha2(F.to_json("texts"), 256)).alias("asked_id"),
            "texts",
        )
    )


def _asked(question: Column) -> Column:
    return F.sha2(F.concat(F.coalesce("asked_id", F.lit("-")), F.lit(" "), question), 256).alias("asked")


def asked_questions(listed: DataFrame) -> DataFrame:
    """``(question_id, question, asked)``: every question with the key of its answer."""
    each = listed.select("question_id", "asked_id", F.explode("texts").alias("question"))
    return each.select("question_id", "question", _asked(F.col("question")))


def distinct_questions(listed: DataFrame) -> DataFrame:
    """Questions as a table of their own, those with the same texts once, under ``asked_id``.

    An id's repeated texts stay repeated; ``once`` marks the first of equal ones, which is
    what :func:`asked_questions` are joined with in the end, by ``asked``.
    """
    texts = F.when(F.col("asked_id").isNull(), F.array_distinct("texts")).otherwise(F.col("texts"))
    return (
        listed.select("asked_id", texts.alias("texts")).distinct()
        .select("asked_id", "texts", F.posexplode("texts").alias("place", "question"))
        .select(
            F.col("asked_id").alias("question_id"), "question", _asked(F.col("question")),
            (F.array_position("texts", F.col("question")) == F.col("place") + 1).alias("once"),
        )
    )


def entity_catalog(
    payer_review: DataFrame,
    country_kpis: DataFrame,
    policy_type_review: DataFrame,
    contract_network: DataFrame,
    age_review: DataFrame,
    options: DataFrame,
) -> DataFrame:
    """``(entity_class, value, position)``: values of the aggregates, then other options.

    ``position`` orders values of equal length as their aggregate lists them; values that
    only the filter options know come last.
    """

    def listed(frame: DataFrame, entity_class: str, position: Column) -> DataFrame:
        value = F.trim(F.col(ENTITY_COLUMNS[entity_class]))
        return frame.select(
            F.lit(entity_class).alias("entity_class"),
            value.alias("value"),
            position.cast("double").alias("position"),
        )

    largest_first = -F.coalesce("gross_premium_usd", F.lit(float("-inf")))
    values = listed(payer_review, "payers", largest_first)
    for frame, entity_class, position in (
        (country_kpis, "payer_countries", F.unix_date("month_end")),
        (policy_type_review, "policy_types", largest_first),
        (contract_network, "master_contracts", largest_first),
        (age_review, "age_buckets", -F.col("beneficiaries")),
    ):
        values = values.unionByName(listed(frame, entity_class, position))
    classes = F.create_map(
        *[F.lit(part) for name, column in ENTITY_COLUMNS.items() for part in (column, name)]
    )
    others = options.where(F.col("dimension").isin(*ENTITY_COLUMNS.values())).select(
        classes[F.col("dimension")].alias("entity_class"),
        F.trim("value").alias("value"),
        F.lit(float("inf")).alias("position"),
    )
    return (
        values.unionByName(others)
        .where("value <> ''")
        .groupBy("entity_class", "value")
        .agg(F.min("position").alias("position"))
    )


def entity_names(policies: DataFrame) -> DataFrame:
    """The names of :func:`entity_catalog` from one scan of the policies, in no order of their own.

    Enough to tell which names a question holds. A missing dimension is a name where an
    aggregate lists it: of policies with a year and, for countries, a covered month.
    """
    pairs = []
    for name, column in ENTITY_COLUMNS.items():
        listed = F.col("uw_year").isNotNull()
        if name == "payer_countries":
            listed &= covers_a_month()
        value = F.coalesce(F.col(column), F.when(listed, unassigned(F.col(column))))
        pairs.append(F.struct(F.lit(name).alias("entity_class"), value.alias("value")))
    # made distinct before it is trimmed, as there are far fewer names than policies
    return (
        policies.select(F.inline(F.array(*pairs))).where("value IS NOT NULL").distinct()
        .select("entity_class", F.trim("value").alias("value"), F.lit(float("inf")).alias("position"))
        .where("value <> ''").distinct()
    )


def _named_phrases(runs: DataFrame, phrases: DataFrame, small: bool) -> DataFrame:
    """Word runs of questions that are dictionary phrases, with their entities.

    A dictionary of up to ``DICTIONARY_BYTES`` is broadcast: questions stay where they are, and
    a name in half of them is no hot key. A larger one is shuffled, in `SALTS` copies, so that
    the questions of one name are dealt to as many tasks; runs whose hash no phrase has are
    dropped before that, by a bitmap of fixed size.
    """
    if small:
        return runs.join(F.broadcast(phrases), "phrase")

    def bucket(phrase: Column) -> Column:
        return F.pmod(F.xxhash64(phrase), F.lit(BITMAP_BITS))

    bits = phrases.agg(F.bitmap_construct_agg(F.bitmap_bit_position(bucket(F.col("phrase")) + 1))).first()[0]
    place = bucket(F.col("phrase"))
    byte = F.substr(F.lit(bytes(bits)), F.floor(place / 8).cast("int") + 1, F.lit(1))
    likely = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), F.pmod(place, F.lit(8)).cast("int")) == 1
    salted = runs.where(likely).withColumn("salt", F.pmod(F.xxhash64("question_id"), F.lit(SALTS)))
    copies = phrases.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, ["phrase", "salt"]).drop("salt")


def match_entities(
    questions: DataFrame, catalog: DataFrame, broadcast_bytes: int = DICTIONARY_BYTES
) -> DataFrame:
    """One array column per entity class with the values a question names.

    Longer names come first, then the order of the catalog. Runs are taken only of the
    word counts that dictionary phrases have.
    """
    phrases = (
        catalog.withColumn("phrase", normalize_phrase(F.col("value")))
        .where("phrase <> ''")
        .withColumn("words", F.size(F.split("phrase", " ")))
    )
    facts = phrases.agg(
        F.coalesce(F.collect_set("words"), F.array()).alias("lengths"),
        F.coalesce(F.sum(F.octet_length("phrase") + F.octet_length("value") + 64), F.lit(0)).alias("size"),
    ).first()
    lengths = F.array(*[F.lit(n) for n in sorted(facts["lengths"])]).cast("array<int>")
    runs = F.expr(
        """array_distinct(flatten(transform(lengths, n ->
             CASE WHEN n > size(words) THEN cast(array() AS array<string>)
                  ELSE transform(sequence(1, size(words) - n + 1),
                                 i -> array_join(slice(words, i, n), ' ')) END)))"""
    )
    asked = (
        questions.select("question_id", F.split("normalised", " ").alias("words"))
        .withColumn("lengths", lengths)
        .select("question_id", F.explode(runs).alias("phrase"))
    )
    found = (
        _named_phrases(asked, phrases, facts["size"] <= broadcast_bytes)
        .groupBy("question_id")
        .agg(
            F.sort_array(
                F.collect_set(
                    F.struct(
                        (-F.length("phrase")).alias("shortness"), "position", "value",
                        "entity_class",
                    )
                )
            ).alias("found")
        )
    )
    matched = questions.join(found, "question_id", "left")

    def of_class(name: str) -> Column:
        hits = F.filter("found", lambda e: e["entity_class"] == name)
        values = F.transform(hits, lambda e: e["value"])
        return F.coalesce(values, F.array().cast("array<string>"))

    return matched.withColumns({name: of_class(name) for name in ENTITY_COLUMNS}).drop("found")


def _holds(array: str, value: str) -> Column:
    return F.array_contains(array, value)


def _named(entity_class: str) -> Column:
    return F.size(entity_class) > 0


def _chosen(pairs: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in pairs]))


def intents() -> Column:
    """Intents shown by words, then those implied by named entities; else ``portfolio``."""
    by_words = _chosen(
        [(has_any(F.col("normalised"), words), i) for i, words in INTENT_PHRASES.items()]
    )
    implied = _chosen([(_named(c), intent) for c, intent in ENTITY_INTENTS.items()])
    both = F.array_distinct(F.concat(by_words, implied))
    return F.when(F.size(both) > 0, both).otherwise(F.array(F.lit("portfolio")))


def requested_metrics() -> Column:
    """Metrics asked for by words, in catalogue order; else defaults by intent."""
    asked = _chosen(
        [(has_any(F.col("normalised"), words), m) for m, words in METRIC_PHRASES.items()]
    )
    money = ("gross_premium_usd", "net_premium_usd", "tpa_fee_usd")
    groups = [
        (_holds("intents", "economics"), money),
        (_holds("intents", "adoption"), ("app_penetration_rate", "active_registered_users")),
        (_holds("intents", "population"), ("active_population",)),
        (_holds("intents", "payer") | _holds("intents", "policy"), money),
    ]
    by_intent = F.array_distinct(_chosen([(t, m) for t, ms in groups for m in ms]))
    return (
        F.when(F.size(asked) > 0, asked)
        .when(F.size(by_intent) > 0, by_intent)
        .otherwise(F.array(F.lit("gross_premium_usd"), F.lit("net_premium_usd")))
    )


def source_tables() -> Column:
    """Evidence tables by intent; a portfolio question reads years and payers."""
    has = {name: _holds("intents", name) for name in (*INTENT_PHRASES, "portfolio")}
    contract, demographic = has["master_contract"], has["demographic"]
    listed = F.array_distinct(
        _chosen(
            [
                (F.lit(True), "summary"),
                ((has["economics"] | has["trend"]) & ~contract, "premium_by_year"),
                (has["payer"], "payer_review"),
                (has["adoption"] & ~demographic, "mobile_by_payer"),
                ((has["adoption"] | has["population"]) & ~demographic, "monthly_kpis"),
                (has["country"], "monthly_country_kpis"),
                (has["policy"] & ~contract, "policy_type_review"),
                (contract, "master_contract_network_premium"),
                (demographic, "age_bucket_review"),
            ]
        )
    )
    fallback = F.array(*[F.lit(t) for t in ("summary", "premium_by_year", "payer_review")])
    return F.when(F.size(listed) > 1, listed).otherwise(fallback)


def focus_label() -> Column:
    """The first label whose condition holds."""
    rules = [
        (_named("master_contracts"), "named_contract"),
        (_holds("intents", "master_contract"), "contract"),
        (_named("age_buckets"), "named_age"),
        (_holds("intents", "demographic"), "age"),
        (_named("payers") & _holds("intents", "adoption"), "payer_adoption"),
        (_named("payers"), "named_payer"),
        (_named("payer_countries"), "named_country"),
        (_named("policy_types"), "named_policy_type"),
        *[(_holds("intents", i), i) for i in ("adoption", "economics", "population", "policy")],
        (F.lit(True), "portfolio"),
    ]
    return F.coalesce(*[F.when(test, F.lit(FOCUS_LABELS[name])) for test, name in rules])


def primary_metric() -> Column:
    """The requested metric of highest priority, else one by intent."""
    ranked = F.filter(
        F.array(*[F.lit(m) for m in METRIC_PRIORITY]),
        lambda m: F.array_contains("requested_metrics", m),
    )
    return F.coalesce(
        F.try_element_at(ranked, F.lit(1)),
        F.when(_holds("intents", "adoption"), F.lit("app_penetration_rate")),
        F.when(_holds("intents", "population"), F.lit("active_population")),
        F.lit("gross_premium_usd"),
    )


def route_questions(
    questions: DataFrame, catalog: DataFrame, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Questions with everything that decides their evidence, and the columns of ``keep``."""
    matched = match_entities(normalize_questions(questions, keep), catalog)
    words = F.col("normalised")
    return (
        matched.withColumn("intents", intents())
        .withColumn("requested_metrics", requested_metrics())
        .withColumns(
            {
                "source_tables": source_tables(),
                "question_focus": focus_label(),
                "primary_metric": primary_metric(),
                "years": years_in(F.col("question")),
                "time_mode": F.when(has_any(words, TREND_WORDS), "trailing").otherwise("latest"),
                "direction": F.when(has_any(words, LOWEST_WORDS), "asc").otherwise("desc"),
                "rank_by": F.when(has_any(words, RANK_BY_ADOPTION_WORDS), "adoption")
                .when(has_any(words, RANK_BY_FEE_WORDS), "fee")
                .otherwise("gross"),
            }
        )
    )
