"""Shards of near equal bytes by Karmarkar-Karp differencing.

Equal texts are one group, which no shard boundary cuts. A group that weighs at least
1 / (shards * GRAIN) of all bytes is an item of its own; lighter groups are pooled, by digest,
into shards * GRAIN items. So there are at most 2 * shards * GRAIN items whatever the input,
and one task differences them: it keeps partial partitions into `shards` sums, takes the two
with the largest spread, joins them in opposite order and puts the result back, until one is
left. Rows meet their shard again by joins on the digest.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from covermart.llm import common
from covermart.llm.common import Scratch

GRAIN = 1000
#: Rows that share one block of slots, about.
BLOCK = 4000


def shard_documents(
    spark: SparkSession,
    docs: DataFrame,
    shards: int = 8,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law `bytes`: sums of size (UTF-8 bytes plus 1) per shard are as near equal as whole groups
    of equal texts allow. `slot` numbers the rows of a shard from 0 without gaps. NULL and
    empty texts are one group of size 1 a row. Rows without doc_id and repeated rows are rows
    like others. `grown_shard` is NULL under this law. Other columns are not read.
    """
    scratch = Scratch(spark, "shards")
    body = common.blob(F.col(common.plain(text_column)))
    rows = scratch.cut(
        "rows",
        docs.select(
            F.col(common.plain(id_column)).alias("doc_id"),
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(body).alias("text_crc32"),
            F.unhex(F.sha2(body, 256)).alias("digest"),
        ).withColumn("seq", F.monotonically_increasing_id()),
    )
    groups = scratch.cut(
        "groups", rows.groupBy("digest").agg(F.sum("size").alias("weight"), F.count("*").alias("n"))
    )
    whole = groups.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("w"), F.sum("n").alias("n"))
    total, n_rows = whole.first()
    pools = shards * GRAIN
    heavy = F.col("weight") * F.lit(pools) >= F.lit(total)
    pool = F.pmod(F.xxhash64("digest"), F.lit(pools)).cast("string")
    placed = groups.select(
        "digest", "weight", F.when(heavy, F.hex("digest")).otherwise(pool).alias("item")
    )
    items = scratch.cut("items", placed.groupBy("item").agg(F.sum("weight").alias("weight")))
    shard_of = scratch.cut(
        "partition",
        items.coalesce(1).mapInPandas(lambda b: _partition(b, shards), "item string, shard int"),
    )
    # at most 2 * shards * GRAIN rows
    homes = placed.join(F.broadcast(shard_of), "item").select("digest", "shard")
    homes = scratch.cut("homes", homes)

    blocks = max(1, -(-(n_rows or 0) // (shards * BLOCK)))
    rows = scratch.cut(
        "placed",
        rows.join(homes, "digest").withColumn(
            "block", F.pmod(F.xxhash64("seq"), F.lit(blocks)).cast("int")
        ),
    )
    counts = rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = scratch.cut(
        "offsets",
        counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")),
    )
    within = Window.partitionBy("shard", "block").orderBy("seq")
    return (
        rows.withColumn("nth", F.row_number().over(within) - 1)
        .join(offsets, ["shard", "block"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("offset") + F.col("nth")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def _partition(batches: Iterator[pd.DataFrame], shards: int) -> Iterator[pd.DataFrame]:
    frames = [x for x in batches if len(x)]
    if not frames:
        return
    items = pd.concat(frames).sort_values(["weight", "item"], ascending=[False, True])
    homes = difference(items["weight"].tolist(), shards)
    yield pd.DataFrame({"item": items["item"].to_numpy(), "shard": pd.array(homes, "int32")})


def difference(weights: list[int], shards: int) -> list[int]:
    """The shard of each weight."""
    parents: list[tuple] = []  # a subset is -1 (none), an item, or len(weights) + place here

    def both(a: int, b: int) -> int:
        if a < 0 or b < 0:
            return max(a, b)
        parents.append((a, b))
        return len(weights) + len(parents) - 1

    heap = []
    for item, weight in enumerate(weights):
        parts = [(weight, item)] + [(0, -1)] * (shards - 1)
        heap.append((-weight, item, parts))
    heapq.heapify(heap)
    stamp = len(weights)
    while len(heap) > 1:
        (_, _, large), (_, _, small) = heapq.heappop(heap), heapq.heappop(heap)
        parts = [
            (a[0] + b[0], both(a[1], b[1])) for a, b in zip(large, reversed(small), strict=True)
        ]
        parts.sort(reverse=True)
        heapq.heappush(heap, (parts[-1][0] - parts[0][0], stamp, parts))
        stamp += 1
    homes = [0] * len(weights)
    for shard, (_, subset) in enumerate(heap[0][2] if heap else []):
        stack = [subset] if subset >= 0 else []
        while stack:
            at = stack.pop()
            if at < len(weights):
                homes[at] = shard
            else:
                stack.extend(parents[at - len(weights)])
    return homes
