"""Exact deduplication against a persistent index of digests.

The index is a table bucketed and sorted by the digest of the normalised text. New documents
are reduced to one row per digest, held against the index by a sort-merge anti-join that reads
the index in its buckets, without a shuffle, and appended. Entries are never rewritten.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from covermart.llm import common
from covermart.llm.common import Scratch


def text_digest(text: Column) -> Column:
    """SHA-256 of the text with each run of white space replaced by one space; NULL is empty."""
    normal = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return F.unhex(F.sha2(normal.cast("binary"), 256))


class DigestIndex:
    """An index in `path`, a folder that outlives the session.

    `buckets` is fixed by the first writer and must be given alike afterwards. One writer adds
    at a time; each addition is one committed write, so a job that dies leaves no half batch.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, id_type: str = "bigint"):
        self.spark = spark
        self.name = "digest_index_" + hashlib.sha1(path.encode()).hexdigest()
        self.buckets = buckets
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id {id_type}, n_rows BIGINT) "
            f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {int(buckets)} BUCKETS "
            f"LOCATION '{path}'"
        )

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(
        self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
    ) -> DataFrame:
        """Per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256; the index grows.

        Rows whose text is already indexed are dropped in favour of the indexed row. Of equal
        new texts the row with the smallest doc_id stays (a row without doc_id only if all are;
        of rows that repeat a doc_id, one). group_size counts the rows of this batch with the
        text and those counted when the text was indexed. NULL and empty texts are equal.
        Other columns are not read; an empty table changes nothing and returns no rows.
        """
        scratch = Scratch(self.spark, "digests")
        rows = scratch.cut(
            "rows",
            docs.select(
                F.col(common.plain(id_column)).alias("doc_id"),
                text_digest(F.col(common.plain(text_column))).alias("digest"),
            ).withColumn("seq", F.monotonically_increasing_id()),
        )
        first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "seq")).alias("first")
        groups = scratch.cut(
            "groups", rows.groupBy("digest").agg(first, F.count(F.lit(1)).alias("n"))
        )
        known = scratch.cut(
            "known",
            groups.join(self.entries().hint("merge"), "digest").select(
                "digest", "keep_id", (F.col("n") + F.col("n_rows")).alias("group_size"),
                F.lit(None).cast("bigint").alias("keep_seq"),
            ),
        )
        new = scratch.cut(
            "new",
            groups.join(self.entries().hint("merge"), "digest", "left_anti").select(
                "digest", F.col("first.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
                F.col("first.seq").alias("keep_seq"),
            ),
        )
        (
            new.select("digest", "keep_id", F.col("group_size").alias("n_rows"))
            .repartition(self.buckets, "digest")
            .sortWithinPartitions("digest")
            .write.insertInto(self.name)
        )
        settled = scratch.cut("settled", new.unionByName(known))
        return rows.join(settled, "digest").select(
            "doc_id",
            "keep_id",
            "group_size",
            F.coalesce(F.col("seq") == F.col("keep_seq"), F.lit(False)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
