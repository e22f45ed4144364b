"""Connected components of a table of links, by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covermart.llm.common import Scratch


def components(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """(node, label) for every node of `links` (u, v): label is the smallest node it reaches.

    Each round takes the smallest label among neighbours and then the label of that label,
    so rounds grow with the logarithm of a component's width. Labels of a round are written
    to the shared folder; only the number of changes comes back.
    """
    both = links.select("u", "v").unionByName(
        links.select(F.col("v").alias("u"), F.col("u").alias("v"))
    )
    both = scratch.cut(f"{name}-links", both.where("u != v").distinct())
    labels = scratch.cut(
        f"{name}-0",
        both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("near")).select(
            "node", F.least("node", "near").alias("label")
        ),
    )
    for step in range(1, 200):
        near = (
            both.join(labels.withColumnRenamed("node", "v"), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        hooked = labels.join(near, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        of_label = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        labels = scratch.cut(
            f"{name}-{step}",
            hooked.join(of_label, "label").select(
                "node", "old", F.least("label", "beyond").alias("label")
            ),
        )
        if labels.where("old != label").isEmpty():
            break
        labels = labels.select("node", "label")
    else:
        raise RuntimeError("labels did not settle")
    return labels.select("node", "label")
