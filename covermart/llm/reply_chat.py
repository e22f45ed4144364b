"""Chat text from reply trees.

Root-to-leaf paths are enumerated by self-joins that double the distance each time: pairs of a
leaf and an ancestor meet the table of jumps over 1, 2, 4, ... replies. Branches of a tree are
ranked by the score of their nodes, and each chosen path becomes one conversation. All steps
are DataFrame operations.

Template: `<s>[INST] user text [/INST]</s>`, `<s>[OUT] assistant text [/OUT]</s>`,
`<s>[SYS] system text [/SYS]</s>`, other roles `<s>[ROLE] role [/ROLE] text </s>`. A control
string inside a text gets one more backslash after its first character, which reading removes.
The loss mask holds the code points of assistant texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from covermart.llm import common
from covermart.llm.common import Scratch

TAGS = {"user": "INST", "assistant": "OUT", "system": "SYS"}
LOSS_ROLE = "assistant"
_CONTROL = r"(/?s>|/?(?:INST|OUT|SYS|ROLE)\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1$2\\$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)\\" + _CONTROL, "$1$2$3")


def reply_paths(spark: SparkSession, nodes: DataFrame, branches: int | None = None) -> DataFrame:
    """(tree, leaf, branch, position, node) for the paths of every tree.

    `nodes` has tree, node, parent (NULL or unknown: a root) and score (NULL: 0), one row per
    node. A path runs from a root to a leaf; branch ranks the paths of a tree from 1 by the
    sum of their scores, ties by leaf, and `branches` keeps the best of them. Nodes on a loop
    of replies have no root and no path.
    """
    scratch = Scratch(spark, "replies")
    nodes = nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("real"))
    nodes = scratch.cut(
        "nodes",
        nodes.join(known, ["tree", "parent"], "left").select(
            "tree", "node", F.when(F.col("real"), F.col("parent")).alias("parent"), "score"
        ),
    )
    largest = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 1
    jumps = nodes.where("parent IS NOT NULL").select("tree", "node", F.col("parent").alias("far"))
    replied = jumps.select("tree", F.col("far").alias("node")).distinct()
    leaves = nodes.join(replied, ["tree", "node"], "left_anti")
    pairs = scratch.cut(
        "pairs-0", leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("up"))
    )
    for step in range(math.ceil(math.log2(largest)) if largest > 1 else 0):
        beyond = pairs.join(jumps, ["tree", "node"]).select(
            "tree", "leaf", F.col("far").alias("node"), (F.col("up") + (1 << step)).alias("up")
        )
        pairs = scratch.cut(f"pairs-{step + 1}", pairs.unionByName(beyond))
        second = jumps.select("tree", F.col("node").alias("far"), F.col("far").alias("further"))
        jumps = scratch.cut(
            f"jumps-{step + 1}",
            jumps.join(second, ["tree", "far"]).select("tree", "node", F.col("further").alias("far")),
        )
    met = pairs.join(nodes, ["tree", "node"])
    paths = (
        met.groupBy("tree", "leaf")
        .agg(
            F.sum("score").alias("score"),
            F.max("up").alias("depth"),
            F.max(F.col("parent").isNull()).alias("rooted"),
        )
        .where("rooted")
    )
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
    paths = paths.select("tree", "leaf", "depth", rank.alias("branch"))
    if branches is not None:
        paths = paths.where(F.col("branch") <= branches)
    return pairs.join(paths, ["tree", "leaf"]).select(
        "tree", "leaf", "branch", (F.col("depth") - F.col("up")).alias("position"), "node"
    )


def format_paths(paths: DataFrame, texts: DataFrame) -> DataFrame:
    """One row per path: tree, leaf, branch, formatted, loss_mask (start, length in code points).

    `texts` has tree, node, role, text; NULL role and text are empty.
    """
    role, body = F.coalesce("role", F.lit("")), escaped(F.coalesce("text", F.lit("")))
    begin = F.concat(F.lit("<s>[ROLE] "), escaped(role), F.lit(" [/ROLE] "))
    end = F.lit(" </s>")
    for name, tag in TAGS.items():
        begin = F.when(role == name, F.lit(f"<s>[{tag}] ")).otherwise(begin)
        end = F.when(role == name, F.lit(f" [/{tag}]</s>")).otherwise(end)
    turns = paths.join(texts, ["tree", "node"]).select(
        "tree", "leaf", "branch", "position", role.alias("role"),
        begin.alias("begin"), body.alias("body"), end.alias("end"),
    )
    before = (
        Window.partitionBy("tree", "leaf", "branch")
        .orderBy("position")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    piece = F.concat("begin", "body", "end")
    turns = turns.select(
        "tree", "leaf", "branch", "position", piece.alias("piece"),
        (F.coalesce(F.sum(F.char_length(piece)).over(before), F.lit(0)) + F.char_length("begin"))
        .cast("int")
        .alias("start"),
        F.when(F.col("role") == LOSS_ROLE, F.char_length("body")).alias("length"),
    )
    rows = F.array_sort(F.collect_list(F.struct("position", "piece", "start", "length")))
    whole = turns.groupBy("tree", "leaf", "branch").agg(rows.alias("rows"))
    loss = F.filter("rows", lambda x: x["length"].isNotNull())
    return whole.select(
        "tree",
        "leaf",
        "branch",
        F.array_join(F.transform("rows", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(loss, lambda x: F.struct(x["start"], x["length"])).alias("loss_mask"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    pieces = F.split(formatted, "<s>")
    pieces = F.slice(pieces, F.lit(2), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        tag = F.regexp_extract(piece, r"^\[([A-Z]+)\] ", 1)
        other = tag == "ROLE"
        named = F.regexp_extract(piece, r"(?s)^\[ROLE\] (.*?) \[/ROLE\] ", 1)
        role = unescaped(named)
        for name, of in TAGS.items():
            role = F.when(tag == of, F.lit(name)).otherwise(role)
        text = F.when(
            other, F.regexp_extract(piece, r"(?s)^\[ROLE\] .*? \[/ROLE\] (.*) </s>$", 1)
        ).otherwise(F.regexp_extract(piece, r"(?s)^\[[A-Z]+\] (.*) \[/[A-Z]+\]</s>$", 1))
        return F.struct(role.alias("role"), unescaped(text).alias("text"))

    return F.transform(pieces, turn)


def read_loss(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, in order."""
    spans = F.transform(
        mask, lambda x: unescaped(F.substring(formatted, x["start"] + 1, x["length"]))
    )
    return F.array_join(spans, "")


def conversation_nodes(
    rows: DataFrame, conversation: str = "conv_id", turn: str = "turn"
) -> DataFrame:
    """Conversations as reply trees: each turn replies to the one before.

    Adds tree (a name for the conversation, NULL included), node (from 1 by turn, then role and
    text; NULLs first), parent and score; expects role and text beside the two columns named.
    """
    identity, order = F.col(common.plain(conversation)), F.col(common.plain(turn))
    tree = F.when(identity.isNull(), F.lit("")).otherwise(
        F.concat(F.lit("="), identity.cast("string"))
    )
    node = F.row_number().over(Window.partitionBy("tree").orderBy("at", "role", "text"))
    return (
        rows.select(tree.alias("tree"), identity.alias("conv_id"), order.alias("at"), "role", "text")
        .withColumn("node", node)
        .select(
            "tree", "conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
            F.lit(0.0).alias("score"), "role", "text",
        )
    )


def format_conversations(
    spark: SparkSession, rows: DataFrame, branches: int | None = None
) -> DataFrame:
    """Per conversation: conv_id, formatted, loss_mask. An empty table gives no rows."""
    nodes = Scratch(spark, "turns").cut("nodes", conversation_nodes(rows))
    paths = reply_paths(spark, nodes, branches)
    chats = format_paths(paths, nodes.select("tree", "node", "role", "text"))
    names = nodes.where("node = 1").select("tree", "conv_id")
    return chats.join(names, "tree").select("conv_id", "formatted", "loss_mask")
