"""A corpus from raw documents to token ids, in five stages.

Each stage gets all that the stage before it kept, as a table written in the shared folder.
All stages but the last return the columns of `documents`. Rows without doc_id go through all
stages like others.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from covermart.llm import compression_quality, digest_index, minhash_dedup, raked_mixing, trie_bpe
from covermart.llm.common import Scratch, plain

#: Path of the vocabulary, the same on every executor.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counts and the compression bands."""
    return compression_quality.keep(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each normalised text, by an index that this run starts."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    index = digest_index.DigestIndex(spark, Scratch(spark, "index").folder, id_type=id_type)
    own, sha, first = (_free(docs, x) for x in ("own_sha256", "kept_sha256", "kept_id"))
    kept = index.add(docs).where("kept").select(
        F.col("doc_id").alias(first), F.col("text_sha256").alias(sha)
    )
    hashed = docs.withColumn(own, F.lower(F.hex(digest_index.text_digest(F.col("text")))))
    same = (F.col(own) == F.col(sha)) & F.col("doc_id").eqNullSafe(F.col(first))
    return hashed.join(kept, same, "left_semi").dropDuplicates([own]).select(*_columns(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id."""
    own = _free(docs, "node")
    # a text under an id is a node; those without id come after all given ids
    unnamed, number = F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    numbered = docs.withColumn(own, F.struct(unnamed.alias("a"), number.alias("b"), digest.alias("c")))
    verdicts = minhash_dedup.near_duplicates(spark, numbered, id_column=own)
    # a document without words is a group of its own
    kept = verdicts.where("kept").select(F.col("doc_id").alias(own)).distinct()
    return numbered.join(kept, own, "left_semi").select(*_columns(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of half the tokens, raked to the target shares of source, language and topic."""
    rows, mix = raked_mixing.mix(spark, docs)
    return rows.where(F.col(f"{mix}.kept")).select(*_columns(docs))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return trie_bpe.encode(docs, VOCABULARY, with_ids=True)


def _columns(docs: DataFrame) -> list[Column]:
    """The columns of the documents, dots in their names included."""
    return [F.col(plain(c)) for c in docs.columns]


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the documents do not have."""
    while name in docs.columns:
        name += "_"
    return name


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", mixing),
    ("BPE encoding and decoding", bpe),
]

#: SQL has neither zstandard nor BPE; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage for the documents of a folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = scratch.cut(f"stage-{at}", stage(spark, docs, sf_dir))
    return docs
