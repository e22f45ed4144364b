"""A batch of questions from end to end, over stored aggregates."""

from __future__ import annotations

import datetime
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covermart.plans import answers as an
from covermart.plans import evidence as ev
from covermart.plans import questions as qu
from covermart.sources.sinks import append_evaluations

# Evidence table -> frame of a snapshot. Tables are used whole, not their first rows.
EVIDENCE_FRAMES = {
    "summary": "summary",
    "monthly_kpis": "monthly_kpis",
    "monthly_country_kpis": "monthly_country_kpis",
    "premium_by_year": "premium_by_year",
    "payer_review": "payer_review_all",
    "master_contract_network_premium": "master_contract_network_premium",
    "age_bucket_review": "age_bucket_review",
    "policy_type_review": "policy_type_review_all",
    "mobile_by_payer": "mobile_by_payer_all",
}


def store_aggregates(snapshot: dict[str, DataFrame], options: DataFrame, folder: str) -> None:
    """Write the aggregates that questions read, and the filter options.

    Questions then never touch policies, and no aggregate is computed twice.
    """
    for name, frame in EVIDENCE_FRAMES.items():
        snapshot[frame].write.mode("overwrite").parquet(f"{folder}/{name}")
    store_values(options.sparkSession, folder)
    options.write.mode("overwrite").parquet(f"{folder}/filter_options")


def store_values(spark: SparkSession, folder: str) -> None:
    """Write the metrics of stored aggregates in long form, for questions to look up."""
    an.metric_values(read_aggregates(spark, folder)).write.mode("overwrite").parquet(
        f"{folder}/metric_values"
    )


def read_values(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/metric_values")


def read_aggregates(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in EVIDENCE_FRAMES}


def other_values(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """What records keep besides the nine tables: active members by month, the table sizes."""
    frames = read_aggregates(spark, folder)
    counts = [
        frame.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        for name, frame in frames.items()
    ]
    return {
        "active_population": frames["monthly_kpis"].select("month_end", "active_population"),
        "metadata": reduce(lambda a, b: a.unionByName(b), counts),
    }


def catalog_of(spark: SparkSession, folder: str) -> DataFrame:
    """The entity dictionary of stored aggregates."""
    frames = read_aggregates(spark, folder)
    return qu.entity_catalog(
        frames["payer_review"],
        frames["monthly_country_kpis"],
        frames["policy_type_review"],
        frames["master_contract_network_premium"],
        frames["age_bucket_review"],
        spark.read.parquet(f"{folder}/filter_options"),
    )


#: Columns of distinct questions that go along with them (:func:`questions.distinct_questions`).
ASKED = ("asked", "once")

#: A question that more than so many ask, or more than one in so many, is dealt to several tasks.
DEALT_ROWS, DEALT_SHARES = 1000, 1024


def store_questions(spark: SparkSession, questions: DataFrame, folder: str) -> None:
    """Write the questions, and those with different texts, which alone are answered.

    Routing and evidence then grow with the different questions, not with how often one is asked.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    qu.listed_questions(questions, tasks).write.mode("overwrite").parquet(f"{folder}/listed")
    listed = spark.read.parquet(f"{folder}/listed")
    qu.distinct_questions(listed).write.mode("overwrite").parquet(f"{folder}/distinct")
    _often_asked(qu.asked_questions(listed)).write.mode("overwrite").parquet(f"{folder}/often")


def _often_asked(every: DataFrame) -> DataFrame:
    """``(asked, deals)``: questions that many ask, with how many tasks share those who ask.

    At most `DEALT_SHARES` rows, and at most twice as many deals, whatever the questions are.
    """
    share = F.greatest(F.lit(DEALT_ROWS), every.agg(F.count(F.lit(1))).scalar() / DEALT_SHARES)
    deals = F.ceil(F.col("askers") / share).cast("int")
    return (
        every.groupBy("asked").agg(F.count(F.lit(1)).alias("askers"))
        .where(F.col("askers") > share).select("asked", deals.alias("deals"))
    )


def read_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/distinct")


def for_all_questions(spark: SparkSession, found: DataFrame, folder: str) -> DataFrame:
    """What was found for different questions, by ``asked``, for every question: its id first.

    The question itself comes along where ``found`` has none. What is found for a question that
    many ask (:func:`_often_asked`) is copied, and they are dealt over the copies: it is no hot key.
    """
    every = qu.asked_questions(spark.read.parquet(f"{folder}/listed"))
    if "question" in found.columns:
        every = every.drop("question")
    often, deals = F.broadcast(spark.read.parquet(f"{folder}/often")), F.coalesce("deals", F.lit(1))
    dealt = every.join(often, "asked", "left").withColumn("deal", F.pmod(F.xxhash64("question_id"), deals))
    copies = found.join(often, "asked", "left").withColumn("deal", F.explode(F.sequence(F.lit(0), deals - 1)))
    return dealt.drop("deals").join(copies.drop("deals"), ["asked", "deal"]).drop("asked", "deal")


def evidence_of(spark: SparkSession, routed: DataFrame, folder: str) -> DataFrame:
    """Evidence of routed questions from stored aggregates.

    The work per question is large for its few bytes, so questions are spread over all
    tasks instead of by size.
    """
    frames = read_aggregates(spark, folder)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return ev.question_evidence(
        routed.repartition(tasks, "question_id"),
        ev.shared_evidence(frames),
        ev.entity_evidence(frames),
    )


def _started(spark: SparkSession, folder: str) -> datetime.datetime:
    """When a batch began: written once, read by every later attempt."""
    path = f"{folder}/started"
    try:
        row = spark.read.schema("started timestamp").parquet(path).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        row = None
    if row is None:
        spark.range(1).select(F.current_timestamp().alias("started")).write.mode("overwrite").parquet(path)
        row = spark.read.parquet(path).first()
    return row["started"]


def answer_batch(
    spark: SparkSession,
    questions: DataFrame,
    aggregates: str,
    work: str,
    output: str,
    scope: str = "",
    scope_json: str = "{}",
    engine: str = "deterministic-cxo-engine-v1",
    batch: str | None = None,
) -> str:
    """Answer a table of questions, append the records to the evaluation dataset, return the batch.

    Each batch has a folder of its own under ``work``, so the values that its records name stay
    those of the batch. Questions, those with different texts routed, and their evidence are
    written there and read back: several steps start from them, and none has to be repeated after
    an executor is lost. Equal questions are answered once and recorded each. A
    batch that failed is run again under its name with the same questions; its records then
    replace those that an earlier attempt left.
    """
    batch = batch or uuid.uuid4().hex
    folder = f"{work}/batch-{batch}"
    started = _started(spark, folder)
    store_questions(spark, questions, folder)
    qu.route_questions(read_distinct(spark, folder), catalog_of(spark, aggregates), ASKED).write.mode(
        "overwrite"
    ).parquet(f"{folder}/routed")
    routed = spark.read.parquet(f"{folder}/routed")
    evidence_of(spark, routed, aggregates).write.mode("overwrite").parquet(f"{folder}/evidence")
    frames = read_aggregates(spark, aggregates)
    an.aggregate_rows({**frames, **other_values(spark, aggregates)}).write.mode("overwrite").parquet(
        f"{folder}/aggregate_rows"
    )
    answered = an.answer_questions(
        spark.read.parquet(f"{folder}/evidence"), read_values(spark, aggregates), frames["summary"]
    )
    each = for_all_questions(spark, an.with_context(answered, scope).where("once").drop("question_id"), folder)
    records = an.evaluation_records(
        each, scope, scope_json, f"{folder}/aggregate_rows", engine, batch, started
    )
    append_evaluations(records, output)
    return batch
