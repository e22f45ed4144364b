"""Queries that apply the operators of this package to the supplied tables, with their SQL."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covermart.llm import (
    block_labeller,
    compression_quality,
    differencing_shards,
    digest_index,
    family_langid,
    hard_negatives,
    merkle_manifest,
    minhash_dedup,
    raked_mixing,
    reply_chat,
    subsequence_toxicity,
    substring_dedup,
    trie_bpe,
)
from covermart.llm.common import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(function):
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that no repeated 35-word window covers."""
    docs = _table(spark, sf_dir, "documents")
    return substring_dedup.remove_repeats(spark, docs).drop("kept_text")


@_query
def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents: 5-word shingles, similarity 0.75 or more."""
    return minhash_dedup.near_duplicates(spark, _table(spark, sf_dir, "documents"))


@_query
def op4_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every text and the verdict of the compression bands."""
    docs = _table(spark, sf_dir, "documents")
    return compression_quality.quality(docs).drop("ratio", "bad_share")


@_query
def op6_differencing_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes."""
    return differencing_shards.shard_documents(spark, _table(spark, sf_dir, "documents"))


@_query
def op9_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against an index that is empty at first."""
    index = digest_index.DigestIndex(spark, Scratch(spark, "index").folder)
    return index.add(_table(spark, sf_dir, "documents"))


ORACLES["op9_digest_index"] = r"""
WITH rows AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM rows
WINDOW g AS (PARTITION BY text_sha256)
"""


@_query
def op8_reply_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts hold control strings, formatted and read back."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame(
        [(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))],
        rows.schema,
    )
    chats = reply_chat.format_conversations(spark, rows.unionByName(own))
    turns = reply_chat.read_turns(F.col("formatted"))
    loss = reply_chat.read_loss(F.col("formatted"), F.col("loss_mask"))
    lines = F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    return chats.select(
        "conv_id", F.char_length("formatted").alias("chars"), turns.alias("turns"), loss.alias("loss")
    ).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("chars").cast("long").alias("formatted_chars"),
    )


ORACLES["op8_reply_chat"] = r"""
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL
  SELECT -7, * FROM (VALUES (0, 'user', '</s>[INST] ok [/INST]'), (1, 'assistant', '</s>[INST] ok [/INST]'))
), turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         length(regexp_replace(coalesce(text, ''), '([<\[])(\\*)(/?s>|/?(?:INST|OUT|SYS|ROLE)\])', '\1\2\\\3', 'g')) AS n,
         length(regexp_replace(coalesce(role, ''), '([<\[])(\\*)(/?s>|/?(?:INST|OUT|SYS|ROLE)\])', '\1\2\\\3', 'g')) AS r
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(n + CASE role WHEN 'user' THEN 22 WHEN 'assistant' THEN 20 WHEN 'system' THEN 20 ELSE 24 + r END) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""


@_query
def op10_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with a public byte-level vocabulary."""
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents")
    return trie_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op5_family_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, by machines fitted outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = family_langid.held_out("doc_id")
    model = family_langid.fit(spark, docs.where(~fold))
    return family_langid.predict(docs, model).select(
        "doc_id", fold.alias("held_out"), "lang_pred", "score"
    )


@_query
def op3_raked_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its cell's fitted weight and probability, and whether it is drawn."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    rows, mix = raked_mixing.mix(spark, docs)
    return rows.select(
        "doc_id",
        f"{mix}.source",
        f"{mix}.lang",
        f"{mix}.topic",
        f"{mix}.tokens",
        F.round(f"{mix}.weight", 9).alias("weight"),
        F.round(f"{mix}.probability", 9).alias("probability"),
        f"{mix}.kept",
    )


ORACLES["op3_raked_mixing"] = raked_mixing.mixing_sql()


@_query
def op7_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, by a labeller fitted on a sample of the pages."""
    pages = _table(spark, sf_dir, "pages")
    return block_labeller.extract(pages, block_labeller.fit(spark, pages))


@_query
def op11_subsequence_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, by a machine fitted on labels outside the held-out fold."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    fold = family_langid.held_out("doc_id")
    model = subsequence_toxicity.fit(spark, docs, labels.where(~fold))
    return subsequence_toxicity.score(docs, model).select(
        "doc_id", fold.alias("held_out"), "score", "predicted"
    )


@_query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents against a manifest; one in five was lower-cased after it was made."""
    docs = _table(spark, sf_dir, "documents")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    found = F.when(chosen, lowered).otherwise(F.col("text"))
    manifest = merkle_manifest.document_manifest(spark, docs, found)
    return manifest.proofs().withColumnRenamed("id", "doc_id")


ORACLES["op12_merkle_manifest"] = merkle_manifest.manifest_sql()


@_query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh label is moved on by one."""
    vectors = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(spark, vectors, F.col("vec_id") % 100 == 0, label)


ORACLES["op13_hard_negatives"] = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), ranked AS (
  SELECT anchor_id, positive_id, positive_score, s.id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM positives p JOIN scores s USING (anchor_id)
  WHERE NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 10
"""
